"""Explainable screening rules over parsed records: findings with evidence, levels, summaries.

Each rule is one expression that gives a finding or null; a record's findings are one array, so that
flags and evidence belong together by construction. The clock is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import dates, text
from docrisk.operators.parsing import project_timeline_line
from docrisk.session import fenced

AS_OF = (2025, 6)
FINDING = "array<struct<dimension:string,code:string,level:int,flag:string,evidence:string>>"
ORDER = {key: i for i, (key, _) in enumerate(lx.DIMENSIONS)}


def finding(condition: Column, dimension: str, code: str, level: int, flag: Column, evidence: Column) -> Column:
    """A finding where the condition holds, else null; evidence is cut to 500 characters."""
    return F.when(condition, F.struct(
        F.lit(dimension).alias("dimension"), F.lit(code).alias("code"), F.lit(level).alias("level"), flag.alias("flag"),
        F.substring(F.coalesce(evidence, F.lit("")), 1, 500).alias("evidence")))


def _sum(words: tuple[str, ...], c: Column) -> Column:
    return reduce(lambda a, b: a + b, [text.occurrences(c, w) for w in words])


def _matching(pattern: str):
    return lambda line: line.rlike(pattern)


def screen(parsed: DataFrame, as_of: tuple[int, int] = AS_OF) -> DataFrame:
    """Add ``findings``, ``levels`` (per dimension), ``overall`` (0, 1, 2) and ``summary`` to parsed records."""
    work, raw, clean = F.col("work_experience"), F.col("raw_text"), F.col("clean_text")
    staged = (
        parsed.withColumn("_all", dates.ranges(work, as_of))
        .withColumn("_ranges", F.filter("_all", lambda r: ~project_timeline_line(r["line"])))
        .withColumn("_edu", F.array_join("education", " ")).withColumn("_skill", F.array_join("skills", " "))
        .withColumn("_head", F.substring("clean_text", 1, 500)).withColumn("_edu_head", F.substring("_edu", 1, 400))
        .withColumn("_vague", F.when(F.size(work) > 0, F.array_join(work, "\n")).otherwise(F.col("text_before_project")))
        .withColumn("_perfect", F.regexp_extract_all(clean, F.lit(PERFECT), F.lit(0)))
        .withColumn("strong", _sum(lx.STRONG_WORDS, clean)).withColumn("moderate", _sum(lx.MODERATE_WORDS, clean))
        .withColumn("_told", text.ascii_digits(text.capture(clean, rf"({text.DIGIT}{{1,2}})\+?{text.WS}*年(?:工作|经验)")).try_cast("int"))
        .withColumn("years", F.coalesce("_told", F.floor(dates.months_total(F.col("_ranges")) / 12).cast("int"), F.lit(0)))
        .withColumn("_projects", F.lower(F.array_join("project_experience", " ")))
        .withColumn("technologies", reduce(lambda a, b: a + b, [F.col("_projects").contains(t).cast("int") for t in lx.TECHNOLOGIES]))
        .withColumn("excess", 2 * F.greatest(F.lit(0), F.col("strong") - F.floor(F.col("years") / 2).cast("int"))
                    + F.greatest(F.lit(0), F.col("moderate") - F.floor(F.col("technologies") / 3).cast("int")))
        .withColumn("_overlap", dates.first_overlap(F.col("_ranges")))
        .withColumn("_major", F.try_element_at(F.filter(F.array(*[F.lit(m) for m in lx.OTHER_MAJORS]), lambda m: F.col("_head").contains(m) | F.col("_edu_head").contains(m)), F.lit(1)))
        .withColumn("_computing", F.col("_head").rlike(lx.COMPUTING_MAJORS) | F.col("_edu_head").rlike(lx.COMPUTING_MAJORS))
    )
    or_else = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    major, years = F.col("_major"), F.col("years")
    mismatch = major.isNotNull() & ~F.col("_computing")
    exaggerated = text.evidence(raw, lambda x: x.rlike("|".join(lx.STRONG_WORDS + lx.MODERATE_WORDS)))
    high = (F.col("excess") >= 6) & (years < 3)
    vague = F.when(F.col("_vague").rlike(lx.VAGUE_EMPLOYER), lx.VAGUE_EMPLOYER).when(F.col("_vague").rlike(lx.VAGUE_DUTY), lx.VAGUE_DUTY)
    vague_evidence = [or_else(text.evidence(F.col("_vague"), _matching(p)), F.regexp_extract("_vague", p, 0)) for p in (lx.VAGUE_EMPLOYER, lx.VAGUE_DUTY)]
    first_five = F.slice("_perfect", 1, 5)
    quoted = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    found = F.array_compact(F.array(
        finding(mismatch, "professional_match", "other_major", 1, quoted("专业“", major, "”离数据岗位较远"), or_else(text.evidence(raw, lambda x: x.contains(major)), F.substring("_edu", 1, 180))),
        finding(F.col("_overlap").isNotNull(), "timeline", "overlap", 1, quoted("任职时段重叠：", F.substring("_overlap", 1, 60)), F.col("_overlap")),
        finding(vague == lx.VAGUE_EMPLOYER, "vague_language", "vague_employer", 1, F.lit("雇主只有笼统称呼"), vague_evidence[0]),
        finding(vague == lx.VAGUE_DUTY, "vague_language", "vague_duty", 1, F.lit("职责只有笼统说法"), vague_evidence[1]),
        finding(F.size("_perfect") > 3, "skill_exaggeration", "perfect_numbers", 1, quoted("近乎完美的数字共", F.size("_perfect").cast("string"), "处"),
                text.evidence(raw, lambda x: F.exists(first_five, lambda p: x.contains(p)))),
        finding(high, "skill_exaggeration", "overstated", 2, quoted(years.cast("string"), "年经验，强词", F.col("strong").cast("string"), "处，中等词", F.col("moderate").cast("string"), "处"), exaggerated),
        finding(~high & (F.col("excess") >= 4) & (years < 5), "skill_exaggeration", "strong_wording", 1,
                quoted(years.cast("string"), "年经验，强词", F.col("strong").cast("string"), "处，中等词", F.col("moderate").cast("string"), "处，项目含技术", F.col("technologies").cast("string"), "项"), exaggerated),
        finding(F.size(work) == 0, "work_experience", "no_work", 1, F.lit("没有识别出任职记录"), or_else(F.array_join("parse_quality.warnings", "；"), F.substring(raw, 1, 180))),
        finding((F.size(work) > 0) & (F.size("_all") == 0) & (F.length(clean) > 1500), "work_experience", "no_dates", 1, F.lit("任职记录没有时段"), F.array_join(F.slice(work, 1, 3), " | ")),
        finding(F.size("education") == 0, "education", "no_education", 0, F.lit("没有识别出学历"), F.substring(raw, 1, 180)),
        finding((F.col("_skill") != "") & ~F.lower("_skill").rlike(lx.DATA_SKILLS) & ~mismatch, "professional_match", "no_data_skill", 1, F.lit("技能中没有数据类关键词"),
                F.array_join(F.slice("skills", 1, 3), " | ")),
    )).cast(FINDING)
    judged = staged.withColumn("findings", found)
    return fenced(summarised(judged.withColumn("levels", levels(F.col("findings")))))


# Fixed value: numbers that are too good.
PERFECT = rf"100%|99%|98%|97%|96%|95%|增长至?{text.WS}*{text.DIGIT}+%|提升至?{text.WS}*{text.DIGIT}+%"


def levels(findings: Column) -> Column:
    """Struct of the level per dimension, 0 without findings."""
    each = lambda key: F.aggregate(F.filter(findings, lambda f: f["dimension"] == key), F.lit(0), lambda a, f: F.greatest(a, f["level"])).alias(key)
    return F.struct(*[each(key) for key, _ in lx.DIMENSIONS])


def label(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in lx.LEVELS]), level + 1)


def summarised(df: DataFrame, labels: dict[str, str] | None = None, separator: str = ";") -> DataFrame:
    """Add ``overall`` and ``summary`` from ``findings`` and ``levels``."""
    named = labels or dict(lx.DIMENSIONS)
    flagged = lambda key: F.exists("findings", lambda f: f["dimension"] == key)
    keys = [key for key, _ in lx.DIMENSIONS if key in named]
    highest = F.greatest(*[F.col("levels")[k] for k in keys])
    n_flagged = reduce(lambda a, b: a + b, [flagged(k).cast("int") for k in keys])
    parts = [F.when(flagged(k), F.concat(F.lit(f"[{named[k]}]"), label(F.col("levels")[k]))) for k in keys]
    return df.withColumn("overall", F.when(highest >= 2, 2).when((highest == 1) | (n_flagged >= 3), 1).otherwise(0)).withColumn(
        "summary", F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), separator), F.lit("")), F.lit(lx.NO_FINDING))
    )
