"""From a document's text to its structured record: sections, lines per section, name, quality.

Every step is a projection on one row: arrays of lines, higher-order functions over them, and per
document one string with a letter per line for what depends on the lines before (a regular
expression over its prefix says which section a line is in). No shuffle and no Python.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import dates, text
from docrisk.session import durable, fenced, small_enough_to_broadcast

# What is wrong with a parse, in the words of the reports.
RAW_SHORT, NO_WORK, NO_EDUCATION, NO_PROJECT = "文本抽取内容较短", "未识别到工作经历", "未识别到教育经历", "项目经历标题存在但未成功分区"


def once(df: DataFrame, by: list[str], columns: list[str], text: str | None = None) -> DataFrame | None:
    """``columns`` of a table of files without surplus deliveries, or null where the input has no places (file and row).

    Of the rows that agree in ``by`` (short columns, the first of them the key; rows with a null key are kept as they are)
    the first one stays. The surplus is found in a pass over these columns; the rows themselves are read once and not
    shuffled while the surplus measures small enough to be a broadcast.

    With ``text``, a long column among ``columns``, rows must agree in that, too, so that no text is left out unread. Texts
    are compared by their SHA-256 digests; as that pass reads them, the surplus is found once and kept (``durable``).
    """
    named = F.xxhash64(F.lit(0), *by[1:])
    if text is not None:
        named = F.struct(named, F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")))
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        placed = df.select(*dict.fromkeys([*columns, *by]), place.alias("_place"))
    except AnalysisException:
        return None
    ids = placed.where(F.col(by[0]).isNotNull()).select(F.col(by[0]).alias("_key"), named.alias("_named"), "_place")
    first = ids.groupBy("_key", "_named").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    surplus = ids.join(first, ["_key", "_named"]).where("_place > _first").select("_place")
    surplus = surplus if text is None else durable(surplus)
    n = surplus.count()
    if not n:
        return df.select(*columns)
    return placed.join(F.broadcast(surplus) if small_enough_to_broadcast(n, 48) else surplus, "_place", "left_anti").select(*columns)


def documents(df: DataFrame) -> DataFrame:
    """Distinct (doc_id, text, name, filename); rows delivered twice count once, rows without an id are kept as they are.

    In a table of files, rows of one id, name and file name are one document, and the first of them stays (``once``).
    Other inputs have no places; there, repeated ids are looked for and their rows, whole texts included, made distinct.
    """
    columns = ["doc_id", "text", "name", "filename"]
    rows = df.select(*columns)
    cores = df.sparkSession.sparkContext.defaultParallelism
    few_splits = rows.rdd.getNumPartitions() < cores  # then parsing costs more than moving the texts
    kept = once(df, ["doc_id", "name", "filename"], columns)
    if kept is not None:
        return kept.repartition(cores) if few_splits else kept
    rows = rows.repartition(cores, "doc_id") if few_splits else rows
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    return rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").distinct())


def section(starts: tuple[str, ...]) -> Column:
    """The lines between the first heading of ``starts`` and the next other heading; needs ``lines`` and ``compacts``."""
    compacts, rows = F.col("compacts"), F.col("lines")
    s = F.array_position(F.transform(compacts, lambda c: c.isin(*starts)), True).cast("int")
    later = F.slice(compacts, s + 1, F.size(compacts))
    end = F.array_position(F.transform(later, lambda c: c.isin(*lx.HEADINGS) & ~c.isin(*starts)), True).cast("int")
    stop = F.when(end == 0, F.size(rows) + 1).otherwise(s + end)
    # cut by position first: what stands in a lambda is worked out again for every line
    inside = F.filter(F.slice(rows, s + 1, F.greatest(stop - s - 1, F.lit(0))), lambda x: ~text.compact(x).isin(*starts))
    return F.when(s == 0, F.array().cast("array<string>")).otherwise(inside)


def employment_line(x: Column) -> Column:
    return dates.has_range(x) & ~x.rlike(lx.EDUCATION_WORDS + "|教育背景|教育经历") & x.rlike(lx.ORGANISATION_WORDS) & x.rlike(lx.JOB_WORDS)


def project_timeline_line(x: Column) -> Column:
    employer = x.rlike(lx.COMPANY_WORDS) & x.rlike(lx.ROLE_WORDS) & (F.length(x) < 45)
    return x.contains("项目") | (x.rlike(lx.PROJECT_WORDS) & ~employer)


def cut(lines: Column, n: int) -> Column:
    return F.array_distinct(F.transform(lines, lambda x: F.substring(x, 1, n)))


def name_from_lines(lines: Column) -> Column:
    patterns = (
        f"姓名[:{text.WS_INNER}]*([一-龥]{{2,4}})", f"^([一-龥]{{2,3}}){text.WS}+(?:个人简历|简历|求职)",
        rf"([一-龥]{{2,4}}){text.WS}{{1,3}}{text.DIGIT}{{3}}[-\p{{Nd}}]{{7,}}", rf"([一-龥]{{2,4}}){text.WS}{{0,3}}[_~\p{{Nd}}](?:{text.WS}|\z)",
    )
    each = F.transform(lines, lambda x: F.coalesce(*[text.capture(x, p) for p in patterns]))
    return F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1))


def parse(docs: DataFrame) -> DataFrame:
    """The structured record of each document (see the README for its columns)."""
    kinds = F.array_join(
        F.transform("compacts", lambda c: F.when(c.isin(*lx.PROJECT_HEADINGS), "p").when(c.isin(*lx.WORK_HEADINGS), "w").when(c.isin(*lx.HEADINGS), "o").otherwise("x")), ""
    )

    def inferred(x: Column, i: Column) -> Column:
        current = F.regexp_extract(F.substring(F.col("kinds"), F.lit(1), i), "([pwo])x*$", 1)
        return (F.substring(F.col("kinds"), i + 1, F.lit(1)) == "x") & (current != "p") & ((current == "w") | ~x.contains("项目")) & employment_line(x)

    staged = (
        docs.withColumn("raw_text", text.clean(F.col("text")))
        .withColumn("lines", text.lines(F.col("raw_text")))
        .withColumn("compacts", F.transform("lines", text.compact))
        .withColumn("kinds", kinds)
        .withColumn("clean_text", F.array_join("lines", " "))
        .withColumn("_education", section(lx.EDUCATION_HEADINGS)).withColumn("_work", section(lx.WORK_HEADINGS))
        .withColumn("project_experience", section(lx.PROJECT_HEADINGS)).withColumn("_skills", section(lx.SKILL_STARTS))
    )
    source = F.when(F.size("_education") > 0, F.col("_education")).otherwise(F.col("lines"))
    education = F.filter(source, lambda x: x.rlike(lx.EDUCATION_WORDS) & (dates.has_range(x) | x.rlike("统招|学历")))
    first = F.col("_first")
    work = F.filter("_work", lambda x, i: dates.has_range(x) | ((first > 0) & (i >= first) & x.rlike(lx.DUTY_WORDS)))
    before = F.instr("kinds", "p")
    given = F.nullif("name", F.lit(""))
    return fenced(
        staged.withColumn("education", cut(education, 120))
        .withColumn("_first", F.array_position(F.transform("_work", dates.has_range), True).cast("int")).withColumn("_dated", cut(work, 140)).withColumn("_inferred", cut(F.filter("lines", inferred), 140))
        .withColumn("work_experience", F.when(F.size("_dated") > 0, F.col("_dated")).otherwise(F.col("_inferred")))
        .withColumn("skills", F.array_distinct(F.filter("_skills", lambda x: F.length(x) <= 120)))
        .withColumn("text_before_project", F.when(before > 0, F.array_join(F.slice("lines", F.lit(1), before - 1), "\n")).otherwise(F.col("raw_text")))
        .withColumn("name_in_text", F.coalesce(name_from_lines(F.col("lines")), text.capture(F.substring("clean_text", 1, 200), "([一-龥]{2,4})"), F.lit(lx.UNKNOWN)))
        .withColumn("name", F.coalesce(given, text.file_name_part(F.col("filename")), F.col("name_in_text")))
        .withColumn("filename", F.coalesce("filename", F.lit("")))
        .withColumn("age", text.capture(F.col("raw_text"), rf"({text.DIGIT}{{2}}){text.WS}*(?:岁|年龄)"))
        .withColumn("work_years", text.capture(F.col("raw_text"), rf"({text.DIGIT}{{1,2}})\+?{text.WS}*年(?:工作|经验)"))
        .withColumn("warnings", F.array_compact(F.array(
            F.when(F.length("raw_text") < 300, RAW_SHORT), F.when(F.size("work_experience") == 0, NO_WORK), F.when(F.size("education") == 0, NO_EDUCATION),
            F.when(F.col("raw_text").contains("项目经历") & (F.size("project_experience") == 0), NO_PROJECT))))
        .withColumn("parse_quality", F.struct(
            F.when(F.size("warnings") >= 2, lx.QUALITIES[2]).when(F.size("warnings") == 1, lx.QUALITIES[1]).otherwise(lx.QUALITIES[0]).alias("quality"),
            F.col("warnings"), F.length("raw_text").alias("text_length"), F.size("work_experience").alias("work_experience_count"),
            F.size("project_experience").alias("project_experience_count"), F.size("education").alias("education_count")))
        .select("doc_id", "name", "name_in_text", "filename", "raw_text", "clean_text", "text_before_project", "age", "work_years", "lines", "education", "work_experience",
                "_inferred", "project_experience", "skills", "parse_quality")
    )
