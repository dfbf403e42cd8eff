"""Session defaults, table access and durable checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "docrisk", **conf: str) -> SparkSession:
    """A session with the engine's defaults; settings already given to Spark are kept."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local master
    without that setting gets a temporary folder; a cluster without it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"docrisk-checkpoints-{os.getuid()}"))
    return df.checkpoint(eager=True)


def small_enough_to_broadcast(rows: int, bytes_per_row: int, limit_bytes: int = 16 << 20) -> bool:
    """Whether a side of known row count may be broadcast."""
    return rows * bytes_per_row <= limit_bytes


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, unless their path or installation has it already."""
    root = Path(__file__).resolve().parent.parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or root.name in ("site-packages", "dist-packages") or getattr(spark.sparkContext, "_docrisk_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="docrisk-")) / "docrisk.zip"  # on the driver, which serves it to the workers
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "docrisk").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._docrisk_shipped = True
    return spark


def fenced(df: DataFrame) -> DataFrame:
    """Keep filters on computed columns above the projections that compute them.

    The optimizer would put a filter's whole definition, lambdas within lambdas, below them and have
    it worked out again for every element. It leaves a projection alone that isn't deterministic, which
    each column is made here; values pass through unchanged, and unused columns are still pruned.
    """
    return df.select(*[F.when(F.spark_partition_id() >= 0, F.col(c)).alias(c) for c in df.columns])
