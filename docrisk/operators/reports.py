"""Tables over screened records: overview, details, distributions, shortlists, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.operators.rules import label

LABELS = dict(lx.DIMENSIONS)
ORDINALS = {key: i for i, (key, _) in enumerate(lx.DIMENSIONS)}
ICONS = {"高": "🔴", "中": "🟡", "低": "🟢"}


def numbered(df: DataFrame, key: str, name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Add consecutive numbers from 1 in the order of a unique key, without bringing all rows to one task.

    Only the keys are divided by ranges and numbered; the sizes of the ranges are worked out in the same query
    (one row per range, a broadcast of at most ``partitions`` rows), and the numbers are joined back by key.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col(key).alias("_key")).repartitionByRange(n, "_key").withColumn("_range", F.spark_partition_id())
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select("_range", "_before")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    numbers = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range").select("_key", (F.col("_place") + F.col("_before")).alias(name))
    return df.join(numbers, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def overview(screened: DataFrame) -> DataFrame:
    """One row per document: number, name, file, quality, overall level, level per dimension, summary."""
    rows = screened.select(
        "doc_id", F.coalesce(F.nullif("name", F.lit("")), F.lit(lx.UNKNOWN)).alias("name"), "filename", F.col("parse_quality.text_length").alias("text_length"),
        F.col("parse_quality.quality").alias("quality"), label(F.col("overall")).alias("overall"), *[label(F.col("levels")[k]).alias(k) for k, _ in lx.DIMENSIONS], "summary",
    )
    return numbered(rows, "doc_id")


def detail(screened: DataFrame) -> DataFrame:
    """One row per finding, with its dimension's level."""
    ordinal = F.create_map(*[F.lit(x) for k, i in ORDINALS.items() for x in (k, i)])
    level = F.coalesce(*[F.when(F.col("f.dimension") == k, F.col("levels")[k]) for k, _ in lx.DIMENSIONS])
    named = F.create_map(*[F.lit(x) for kv in lx.DIMENSIONS for x in kv])
    return screened.select("doc_id", "name", "levels", F.posexplode("findings").alias("_k", "f")).select(
        "doc_id", "name", ordinal[F.col("f.dimension")].alias("dimension_no"), named[F.col("f.dimension")].alias("dimension"), label(level).alias("level"),
        F.col("f.code").alias("code"), F.col("f.flag").alias("flag"), F.col("f.evidence").alias("evidence"),
    )


def risk_distribution(screened: DataFrame) -> DataFrame:
    """(level, n, share) for every level; the share of an empty corpus is null. One aggregation to one row, no join."""
    row = screened.agg(F.count("*").alias("all"), *[F.count_if(F.col("overall") == i).alias(f"o{i}") for i in range(len(lx.LEVELS))])
    each = F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"o{i}").alias("n")) for i, x in enumerate(lx.LEVELS)])
    return row.select("all", F.explode(each).alias("r")).select("r.level", "r.n", F.round(F.col("r.n") / F.nullif("all", F.lit(0)), 6).alias("share"))


def shortlist(screened: DataFrame, overall: int) -> DataFrame:
    """(seq, name, summary) of the documents of a level, numbered from 1, the summary cut to 60 characters."""
    rows = screened.where(F.col("overall") == overall).select("doc_id", "name", F.substring("summary", 1, 60).alias("summary"))
    return numbered(rows, "doc_id").select("seq", "name", "summary")


def quality_distribution(screened: DataFrame) -> DataFrame:
    return screened.groupBy(F.coalesce("parse_quality.quality", F.lit(lx.UNKNOWN)).alias("quality")).agg(F.count("*").alias("n"))


def medium_by_dimension(screened: DataFrame) -> DataFrame:
    """(dimension, n, place): findings of the dimensions at medium level, most first, ties by first occurrence."""
    row = screened.agg(*_medium_counts())
    return row.select(F.posexplode(_ranked_dimensions(row)).alias("k", "x")).select("x.dimension", "x.n", (F.col("k") + 1).alias("place"))


def _medium_issue() -> Column:
    return (F.col("overall") == 1) & F.col("parse_quality.quality").isin(*lx.QUALITIES[1:])


def totals(screened: DataFrame) -> DataFrame:
    """One row: documents, documents per level, medium ones with a parse issue."""
    return screened.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("overall") == i).alias(k) for i, k in ((2, "high"), (1, "medium"), (0, "low"))], F.count_if(_medium_issue()).alias("medium_with_parse_issue")
    )


def top_medium(screened: DataFrame, n: int = 10) -> DataFrame:
    """The first medium documents, well parsed ones first (a top-n without a full sort)."""
    rank = F.when(F.col("parse_quality.quality") == lx.QUALITIES[0], 0).otherwise(1)
    rows = screened.where("overall = 1").withColumn("_rank", rank).orderBy("_rank", "doc_id").limit(n)
    return rows.select("doc_id", "name", "filename", "summary", F.col("parse_quality.quality").alias("quality"))


def _medium_counts() -> list[Column]:
    """Per dimension the findings of records in which it is at medium level, and the first such record; for one aggregate."""
    out = []
    for key, _ in lx.DIMENSIONS:
        n = F.when(F.col("levels")[key] == 1, F.size(F.filter("findings", lambda f: f["dimension"] == key))).otherwise(0)  # noqa: B023
        out += [F.sum(n).alias(f"n_{key}"), F.min(F.when(n > 0, F.col("doc_id"))).alias(f"first_{key}")]
    return out


def statistics(screened: DataFrame) -> DataFrame:
    """One row with all counts of a run: one aggregation over one parse of the texts."""
    quality = F.coalesce("parse_quality.quality", F.lit(lx.UNKNOWN))
    return screened.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("overall") == i).alias(f"o{i}") for i in range(len(lx.LEVELS))], F.count_if(_medium_issue()).alias("issue"),
        *[F.count_if(quality == q).alias(f"q{i}") for i, q in enumerate((*lx.QUALITIES, lx.UNKNOWN))], *_medium_counts(),
    )


def _ranked_dimensions(row: DataFrame) -> Column:
    """(n, dimension) of the dimensions with medium findings, most first, ties by first occurrence."""
    each = F.array(*[F.struct((-F.col(f"n_{k}")).alias("m"), F.col(f"first_{k}").alias("first"), F.lit(i).alias("i"), F.lit(v).alias("dimension")) for i, (k, v) in enumerate(lx.DIMENSIONS)])
    return F.transform(F.array_sort(F.filter(each, lambda x: x["m"] < 0)), lambda x: F.struct((-x["m"]).alias("n"), x["dimension"].alias("dimension")))


def summary_stats(screened: DataFrame) -> DataFrame:
    """(part, value): the run's statistics, each part of bounded size as JSON, from one aggregation."""
    row = statistics(screened)

    def pairs(entries: list[tuple[str, str]], least: int) -> Column:
        each = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("n")) for k, c in entries]), lambda x: x["n"] >= least)
        return F.to_json(F.map_from_entries(F.array_sort(each)))

    dimensions = F.to_json(F.map_from_entries(F.array_sort(F.transform(_ranked_dimensions(row), lambda x: F.struct(x["dimension"].alias("k"), x["n"].alias("n"))))))
    parts = {
        "risk_distribution": pairs([(x, f"o{i}") for i, x in enumerate(lx.LEVELS)], 0), "parse_quality_distribution": pairs([(x, f"q{i}") for i, x in enumerate((*lx.QUALITIES, lx.UNKNOWN))], 1),
        "medium_risk_by_dimension": dimensions, "medium_with_parse_issue": F.col("issue").cast("string"),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()])).alias("x")).select("x.part", "x.value")


def digest(screened: DataFrame) -> DataFrame:
    """One line per document: icon, name, summary."""
    icons = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    return screened.select("doc_id", F.concat(F.coalesce(icons[label(F.col("overall"))], F.lit("⚪")), F.lit(" "), "name", F.lit(" - "), "summary").alias("line"))


def reply(screened: DataFrame, report: str | None = None, debug: str | None = None) -> DataFrame:
    """One row: the text that sums a run up, with the dimensions that medium levels come from and, where given, the places of its files."""
    row = statistics(screened)
    names = F.transform(_ranked_dimensions(row), lambda x: F.concat(x["dimension"], F.lit(" "), x["n"].cast("string")))
    places = "".join(f"；{label_}：{place}" for label_, place in (("报告", report), ("调试文件", debug)) if place)
    return row.select(F.concat(
        F.format_string("共 %d 份；高风险 %d，中风险 %d，低风险 %d；解析正常 %d，需复核 %d，较差 %d；中风险中解析存疑 %d；主要中风险维度：", "n", "o2", "o1", "o0", "q0", "q1", "q2", "issue"),
        F.coalesce(F.nullif(F.array_join(names, "、"), F.lit("")), F.lit("无")), F.lit(places)).alias("reply"))
