"""The earlier rule profile: its own line cleaning, sections and six-dimension rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import text
from docrisk.operators import rules
from docrisk.session import fenced

LABELS = {key: key for key, _ in lx.DIMENSIONS if key != "professional_match"}
YEARS = r"201[5-9]|20[23]\p{Nd}"
PERFECT = rf"100%|99%|98%|97%|96%|95%|增长了{text.WS}*{text.DIGIT}+%|提升了{text.WS}*{text.DIGIT}+%"
EDUCATION = (
    rf"{text.DIGIT}{{4}}{text.WS}*[-–至]{text.WS}*(?:{text.DIGIT}{{4}}|{text.DIGIT}{{2}})[年.]?{text.WS}*[一-龥]{{2,10}}"
    "(?:大学|学院|学校|研究生|硕士|博士|本科|大专|中专)"
)
NAME_PATTERNS = (
    rf"姓{text.WS}*名[：:{text.WS_INNER}]*([一-龥]{{2,4}})", rf"([一-龥]{{2,3}}){text.WS}{{1,3}}{text.DIGIT}{{3}}[-\p{{Nd}}]{{7,}}",
    rf"^([一-龥]{{2,3}}){text.WS}+(?:个人简历|简历|求职)", rf"([一-龥]{{2,4}}){text.WS}{{0,3}}[_~\p{{Nd}}](?:{text.WS}|\z)",
)


def name_in_text(lines: Column, clean: Column) -> Column:
    """The first line's match in the order of the patterns, else the first Chinese characters of the cleaned text's beginning.

    ``lines`` still have the signs that the cleaning takes out, as two of the patterns ask for them.
    """
    each = F.transform(lines, lambda x: F.coalesce(*[text.capture(x, p) for p in NAME_PATTERNS]))
    named = F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(named, text.capture(F.substring(clean, 1, 200), "([一-龥]{2,4})"), F.lit(lx.UNKNOWN))


def _kinds(lines: Column, words: str, below: int) -> Column:
    """A letter per line: h heading, e empty, x other."""
    return F.array_join(F.transform(lines, lambda x: F.when(F.substring(x, 1, 8).rlike(words) & (F.length(x) < below), "h").when(x == "", "e").otherwise("x")), "")


def _inside(lines: Column, kinds: Column, least: int, cut: int) -> Column:
    """Lines under a heading up to an empty one, longer than ``least``, cut."""
    active = lambda x, i: (F.substring(kinds, i + 1, F.lit(1)) == "x") & F.substring(kinds, F.lit(1), i).rlike("h[^e]*$") & (F.length(x) > least)
    return F.transform(F.filter(lines, active), lambda x: F.substring(x, 1, cut))


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, name, clean_text, education, work_experience, skills) of the earlier profile."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return fenced(
        docs.withColumn("_stripped", F.filter(F.transform(F.split(body, "\n"), text.strip), lambda x: x != "")).withColumn("_lines", F.transform("_stripped", text.legacy_clean))
        .withColumn("clean_text", F.array_join("_lines", " "))
        .withColumn("_w", _kinds(F.col("_lines"), "工作经历|任职|职位|公司", 20)).withColumn("_s", _kinds(F.col("_lines"), "个人技能|专业技能|技术专长|擅长", 15))
        .withColumn("education", F.transform(F.filter("_lines", lambda x: x.rlike(EDUCATION)), lambda x: F.substring(x, 1, 80)))
        .withColumn("work_experience", _inside(F.col("_lines"), F.col("_w"), 10, 100)).withColumn("skills", _inside(F.col("_lines"), F.col("_s"), 0, 80))
        .select("doc_id", F.coalesce(F.nullif("name", F.lit("")), name_in_text(F.col("_stripped"), F.col("clean_text"))).alias("name"), "clean_text", "education", "work_experience", "skills")
    )


def screen(parsed: DataFrame) -> DataFrame:
    """Findings, levels, overall and summary by the earlier rules."""
    clean, work = F.col("clean_text"), F.col("work_experience")
    none = F.lit("")
    staged = (
        parsed.withColumn("_years", F.array_distinct(F.regexp_extract_all(clean, F.lit(YEARS), F.lit(0))))
        .withColumn("_counts", F.transform("_years", lambda y: ((F.length(clean) - F.length(F.replace(clean, y, F.lit("")))) / 4).cast("int")))
        .withColumn("perfect", F.regexp_count(clean, F.lit(PERFECT)))
        .withColumn("phrases", reduce(lambda a, b: a + b, [text.occurrences(clean, w) for w in lx.LEGACY_PHRASES]))
    )
    most, least = F.array_max("_counts"), F.array_min("_counts")
    vague = F.when(clean.rlike("某[知名大型热门]"), "vague_employer").when(clean.rlike(rf"{text.WORD}{{2,4}}互联网"), "broad_company").when(clean.rlike(lx.VAGUE_DUTY), "vague_duty")
    say = lambda s: F.lit(s)
    found = F.array_compact(F.array(
        rules.finding((F.size("_years") >= 4) & (most > 3) & (most.cast("double") / least > 2), "timeline", "year_counts", 1, say("年份出现次数异常"), none),
        *[rules.finding(vague == code, "vague_language", code, 1, say(code), none) for code in ("vague_employer", "broad_company", "vague_duty")],
        rules.finding(F.col("perfect") > 3, "skill_exaggeration", "perfect_numbers", 1, say("近乎完美的数字"), none),
        rules.finding(F.col("phrases") >= 6, "skill_exaggeration", "overstated", 2, say("夸大用词多"), none),
        rules.finding(F.col("phrases").between(4, 5), "skill_exaggeration", "strong_wording", 1, say("夸大用词较多"), none),
        rules.finding(F.size(work) == 0, "work_experience", "no_work", 1, say("没有任职记录"), none),
        rules.finding((F.size(work) > 0) & (F.size(work) < 3) & (F.length(clean) > 1500), "work_experience", "few_lines", 1, say("任职记录过少"), none),
        rules.finding(F.size("education") == 0, "education", "no_education", 0, say("没有学历"), none),
    )).cast(rules.FINDING)
    judged = staged.withColumn("findings", found).withColumn("levels", rules.levels(F.col("findings")))
    return fenced(rules.summarised(judged, LABELS, "；"))
