"""Folders of documents and JSON lists as DataFrames of documents."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.session import durable
from docrisk.functions import text

FILES = "path string, modificationTime timestamp, length long, content binary, filename string"
EXTRACTED = "path string, filename string, candidates array<string>, error string"


def wanted(path: Column, legacy: bool = False) -> Column:
    """Whether a path is a document to read: suffix, no pruned folder, no lock file, no report of our own.

    The earlier profile takes all but ``.txt`` and neither prunes folders nor reports.
    """
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    if legacy:
        return suffix.isin(*lx.SUFFIXES[:-1])
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    pruned = F.exists(F.split(F.lower(path), "/"), lambda p: (p == "__pycache__") | p.endswith(lx.PRUNED_ENDS))
    return suffix.isin(*lx.SUFFIXES) & ~pruned & ~name.startswith("~$") & ~stem.rlike(lx.REPORT_NAMES)


def scan(spark: SparkSession, folder: str, recursive: bool = True, legacy: bool = False) -> DataFrame:
    """The documents of a folder with their bytes; a missing folder gives no rows.

    Names that begin with ``.`` or ``_`` are hidden by the reader.
    """
    if "://" not in folder and not Path(folder).exists():
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("path", F.expr("url_decode(replace(regexp_replace(path, '^file:/+', '/'), '+', '%2B'))")).where(wanted(F.col("path"), legacy))
    if not recursive:
        top = folder.rstrip("/") if "://" in folder else Path(folder).resolve().as_posix()
        files = files.where(F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)") == top)
    return files.withColumn("filename", F.substring_index("path", "/", -1))


def extract(files: DataFrame) -> DataFrame:
    """(path, filename, text, error): of several engines the best-scored text; ties keep the first engine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from docrisk.sources import codecs

        for f in frames:
            got = [codecs.extract(n, c) for n, c in zip(f["filename"], f["content"])]
            yield pd.DataFrame({"path": f["path"], "filename": f["filename"], "candidates": pd.Series([g[0] for g in got], dtype=object), "error": pd.Series([g[1] for g in got], dtype=object)})

    raw = files.select("path", "filename", "content").mapInPandas(run, EXTRACTED)
    scored = F.transform("candidates", lambda c, i: F.struct(text.quality_score(c).alias("score"), (-i).alias("engine"), c.alias("text")))
    return raw.select("path", "filename", text.clean(F.array_max(scored)["text"]).alias("text"), "error")


def documents(extracted: DataFrame, skip_failed: bool = False) -> DataFrame:
    """(doc_id, text, name, filename) in the order of the paths; the name is the file name's last part or its stem."""
    from docrisk.operators.reports import numbered

    # written once: numbering looks at the paths and the rows again, and extraction costs far more than writing
    kept = durable(extracted.where("error IS NULL") if skip_failed else extracted)
    name = F.coalesce(text.file_name_part(F.col("filename")), F.regexp_replace("filename", r"\.[^.]+$", ""))
    return numbered(kept, "path", "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", name.alias("name"), "filename")


def json_elements(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep..., item_no, text, name, filename) of JSON arrays or single objects; null for what isn't JSON gives no rows.

    The text is the key ``text`` if it is there at all, else ``content``, else empty; an element that is no
    object is its own text.
    """
    raw = F.btrim(F.col(column))
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = df.where(F.try_parse_json(column).isNotNull()).select(*keep, F.posexplode(items).alias("item_no", "_item"))
    keys = F.when(F.col("_item").startswith("{"), F.json_object_keys("_item"))
    get = lambda k: F.get_json_object("_item", f"$.{k}")
    found = F.when(keys.isNull(), F.col("_item")).when(F.array_contains(keys, "text"), get("text")).when(F.array_contains(keys, "content"), get("content"))
    return rows.select(*keep, "item_no", F.coalesce(found, F.lit("")).alias("text"), F.when(keys.isNotNull(), get("name")).alias("name"), F.when(keys.isNotNull(), get("filename")).alias("filename"))


def pdf_list(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of a flat folder's PDFs in the order of their paths: the list that the profile table starts from."""
    rows = extract(scan(spark, folder, recursive=False).where(F.lower("path").endswith(".pdf"))).where("error IS NULL")
    cleaned = F.replace(F.replace("text", F.lit("\n\n\n"), F.lit("\n")), F.lit("\r"), F.lit(""))
    return rows.orderBy("path").select(F.replace("filename", F.lit(".pdf"), F.lit("")).alias("name"), cleaned.alias("text"))


def json_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("name string, text string").json(path)
