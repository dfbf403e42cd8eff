"""Queries of the general data-preparation operators: packed values, timestamps, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.operators import intervals, packed_values, timestamps
from docrisk.session import table

#: Most rows of a reference list that may be read to the driver and made into one pattern (a tree of letters, whose cost doesn't grow with the list).
REFERENCE_ROWS = 100_000


def reference_names(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = table(spark, sf_dir, "ref_skills").select("skill_name").where("skill_name IS NOT NULL").distinct().limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError("the list of skills is too long for one pattern")
    return [r[0] for r in rows]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = packed_values.packed_cells(table(spark, sf_dir, "parsed_resumes"), "skills").unionByName(
        packed_values.packed_cells(table(spark, sf_dir, "profile_summary"), "技能特长")
    )
    keep = ["field_name", "doc_id", "line_no"]
    return packed_values.split_values(cells, "cell", reference_names(spark, sf_dir), keep).distinct()


def p4_values_per_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value occurs and in how many cells, over all packed fields."""
    return p4_found(spark, sf_dir).groupBy("item_text").agg(F.count("*").alias("n_values"), F.countDistinct("field_name", "doc_id", "line_no").alias("n_cells"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalised_dates(table(spark, sf_dir, "parsed_resumes"), ["education", "work_experience"], group="candidate_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["work_experience", "project_experience"]
    spans = intervals.experience_spans(timestamps.with_zone(table(spark, sf_dir, "parsed_resumes"), fields, "doc_id", "parsed_at", "candidate_no"), fields)
    return spans.select("field_name", "doc_id", "span_kind", "from_month", "to_month")


QUERIES = {"p4_found": p4_found, "p4_values_per_skill": p4_values_per_skill, "p6_found": p6_found, "p7_found": p7_found}
