"""Queries of the text-preparation operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docrisk.llm import canonical, mixing, mojibake, packing, personal, residue, scan_noise
from docrisk.operators import parsing
from docrisk.session import table


#: Settings are a handful of rows; a table of more is a mistake and is refused, not cut.
MOST_SETTINGS = 1000


def few(settings: DataFrame) -> list[Row]:
    rows = settings.limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"a table of settings has more than {MOST_SETTINGS} rows")
    return rows


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, doc_id, text) of both extractions of all résumés; a text delivered again under its id counts once, a changed one is read."""
    text = parsing.once(table(spark, sf_dir, "resumes_for_analysis"), ["doc_id"], ["doc_id", "text"], "text")
    raw = parsing.once(table(spark, sf_dir, "parsed_resumes"), ["doc_id"], ["doc_id", "raw_text"], "raw_text")
    return text.select(F.lit("text").alias("field_name"), "doc_id", "text").unionByName(raw.select(F.lit("raw_text").alias("field_name"), "doc_id", F.col("raw_text").alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = resume_texts(spark, sf_dir)
    found = scan_noise.find(texts, "doc_id", "text", ["field_name"], scan_noise.fit(texts, "text"))
    return found.select("field_name", "doc_id", "line_no", "noise_kind").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as continuous readable paragraphs."""
    texts = resume_texts(spark, sf_dir)
    return scan_noise.repair(texts, "doc_id", "text", ["field_name"], scan_noise.fit(texts, "text")).distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field have no entry in the reference list."""
    found = p2_found(spark, sf_dir)
    return found.groupBy("field_name", "part_no").agg(F.count("*").alias("n_parts"), F.count_if(F.col("ref_id") == 0).alias("n_unmatched"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "profile_summary")

    titles = profiles.select(F.lit("目标岗位").alias("field_name"), "doc_id", F.lit(1).alias("part_no"), F.col("目标岗位").alias("part")).distinct()
    parts = profiles.select("doc_id", F.posexplode(F.split("学历信息", r" \| ")).alias("k", "part"))
    schools = parts.select(F.lit("学历信息").alias("field_name"), "doc_id", (F.col("k") + 1).alias("part_no"), "part").distinct()
    title_entries = canonical.title_entries(table(spark, sf_dir, "ref_titles"), "title_id", "title", "title_en")
    school_entries = canonical.school_entries(table(spark, sf_dir, "ref_schools"), "school_id", ["school_name", "short_name"])
    by_title = canonical.map_values(titles, "part", title_entries, canonical.core_of_title)
    by_school = canonical.map_values(schools, "part", school_entries, canonical.core_of_school, True)
    return by_title.unionByName(by_school).select("field_name", "doc_id", F.col("part_no").cast("int").alias("part_no"), "ref_id", "part").drop("part").distinct()


def personal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, doc_id, text) of the résumé texts and the contact cells, surplus deliveries left out."""
    resumes, cells = table(spark, sf_dir, "resumes_for_analysis"), table(spark, sf_dir, "profile_summary")
    text = parsing.once(resumes, ["doc_id", "name", "filename"], ["doc_id", "text"])
    both = parsing.once(cells, ["doc_id", "手机", "邮箱"], ["doc_id", "手机", "邮箱"])
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("手机", "邮箱")]))
    return text.select(F.lit("text").alias("field_name"), "doc_id", "text").unionByName(both.select("doc_id", cell.alias("_c")).select("_c.field_name", "doc_id", "_c.text"))


CONTACT_CELLS = {"手机": "PHONE", "邮箱": "EMAIL"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal.find(personal_fields(spark, sf_dir), "doc_id", "text", "field_name", CONTACT_CELLS)
    return spans.select("field_name", "doc_id", "pii_kind", "char_no").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records with typed placeholders in place of personal information."""
    records = personal_fields(spark, sf_dir).where("text IS NOT NULL")
    return personal.find_and_mask(records, "doc_id", "text", "field_name", CONTACT_CELLS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = resume_texts(spark, sf_dir)
    return mojibake.affected(texts, "doc_id", "text", mojibake.fit(texts), ["field_name"])


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled records with their text as far as it can be restored."""
    texts = resume_texts(spark, sf_dir)
    return mojibake.restore(texts, "doc_id", "text", mojibake.fit(texts), ["field_name"]).distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text (or piece of an overlong one) for each capacity."""
    docs = table(spark, sf_dir, "documents")
    limits = [(r["limit_name"], r["capacity_tokens"]) for r in few(table(spark, sf_dir, "pack_limits"))]
    return packing.pack_items(packing.token_sizes(docs, "doc_id", "text"), "doc_id", "n_tokens", limits, n_items=docs.count())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their fill per capacity."""
    return packing.fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def _mix_targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in few(table(spark, sf_dir, "mix_targets"))}


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mix, each as often as it is drawn."""
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", _mix_targets(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(p9_drawn(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return residue.with_residue_kind(docs).where("residue_kind IS NOT NULL").select("doc_id").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents free of residue."""
    docs = table(spark, sf_dir, "documents")
    return residue.with_residue_kind(docs).where("residue_kind IS NULL").select("doc_id", F.length("text").alias("n_chars"))


QUERIES = {
    "p1_found": p1_found, "p1_repaired": p1_repaired, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p3_found": p3_found, "p3_masked": p3_masked,
    "p5_found": p5_found, "p5_restored": p5_restored, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_drawn": p9_drawn, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_clean": p10_clean,
}
ORACLE_SQL: dict[str, str] = {}
