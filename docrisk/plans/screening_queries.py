"""Queries of the screening engine over the extracted texts: parsing, rules, reports, profile table, earlier profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import dates, text
from docrisk.operators import legacy, parsing, profile, reports, rules
from docrisk.session import fenced, table
from docrisk.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.documents(table(spark, sf_dir, "resumes_for_analysis"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(docs(spark, sf_dir))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.screen(parsed(spark, sf_dir))


def joined(c: str) -> Column:
    return F.array_join(c, "\n").alias("lines")


@query
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("raw_text"))


@query
def line_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.lines(text.clean(F.col("text")))).alias("line_no", "line"))


@query
def heading_normalize(spark, sf_dir):
    rows = line_split(spark, sf_dir)
    return rows.select("doc_id", "line_no", text.heading(F.col("line")).alias("heading")).where("heading <> ''")


def _sections(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("lines", text.lines(text.clean(F.col("text")))).withColumn("compacts", F.transform("lines", text.compact))
    starts = {"education": lx.EDUCATION_HEADINGS, "work_experience": lx.WORK_HEADINGS, "project_experience": lx.PROJECT_HEADINGS, "skills": lx.SKILL_STARTS}
    each = F.array(*[F.struct(F.lit(k).alias("section"), parsing.section(v).alias("lines")) for k, v in starts.items()])
    return fenced(d.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.section", "s.lines")).where(F.size("lines") > 0)


@query
def section_extract(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section", joined("lines"))


@query
def section_counts(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n_docs"), F.sum(F.size("lines")).alias("n_lines"))


@query
def name_resolve(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "name")


@query
def name_in_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "name_in_text")


@query
def filename_name(spark, sf_dir):
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    return docs(spark, sf_dir).select("doc_id", F.coalesce(text.file_name_part(F.col("filename")), stem).alias("file_name"))


@query
def age_extract(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "age", "work_years")


@query
def experience_years(spark, sf_dir):
    return screened(spark, sf_dir).select("doc_id", "years")


def _lines_query(name: str, column: str) -> None:
    def run(spark, sf_dir):
        return parsed(spark, sf_dir).select("doc_id", F.size(column).alias("n"), joined(column)).where("n > 0")

    run.__name__ = name
    query(run)


for _name, _column in (("education_lines", "education"), ("work_lines", "work_experience"), ("work_fallback", "_inferred"), ("project_lines", "project_experience"), ("skill_lines", "skills")):
    _lines_query(_name, _column)


@query
def text_before_project(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "text_before_project")


@query
def parse_quality(spark, sf_dir):
    q = F.col("parse_quality")
    return parsed(spark, sf_dir).select(
        "doc_id", q["quality"].alias("quality"), F.array_join(q["warnings"], ",").alias("warnings"),
        *[q[c].alias(c) for c in ("text_length", "work_experience_count", "project_experience_count", "education_count")])


@query
def date_token(spark, sf_dir):
    rows = line_split(spark, sf_dir).where(dates.has_range(F.col("line")))
    a, b = (F.regexp_extract("line", dates.RANGE, k) for k in (1, 2))
    return rows.select("doc_id", "line_no", a.alias("start_token"), dates.month_ordinal(a, rules.AS_OF).alias("start_month"), b.alias("end_token"), dates.month_ordinal(b, rules.AS_OF).alias("end_month"))


@query
def date_ranges(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("doc_id", F.explode(dates.ranges(F.col("work_experience"), rules.AS_OF)).alias("r"))
    return rows.select("doc_id", F.col("r.i").alias("line_no"), F.col("r.s").alias("start_month"), F.col("r.e").alias("end_month"), F.col("r.line").alias("line"))


@query
def timeline_overlap(spark, sf_dir):
    return screened(spark, sf_dir).select("doc_id", F.col("_overlap").alias("line")).where("line IS NOT NULL")


@query
def project_timeline_filter(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("doc_id", F.posexplode("work_experience").alias("line_no", "line"))
    return rows.select("doc_id", "line_no", parsing.project_timeline_line(F.col("line")).alias("is_project"))


@query
def text_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(text.quality_score(F.col("text")), 6).alias("score"))


@query
def evidence_search(spark, sf_dir):
    words = "|".join(lx.STRONG_WORDS + lx.MODERATE_WORDS)
    return docs(spark, sf_dir).select("doc_id", text.evidence(text.clean(F.col("text")), lambda x: x.rlike(words)).alias("evidence"))


#: Texts with what the résumés at hand lack: (doc_id, text), beside the table's rows in the queries of the rules on wording and numbers.
CONSTRUCTED = (
    (-1, "工作经历\n2019.01-2021.06 某知名公司 数据工程师\n负责公司相关数据工作\n教育经历\n2010.09-2014.06 青石大学 计算机 本科"),
    (-2, "工作经历\n2019.01-2021.06 青石科技有限公司 数据工程师\n负责部门业务\n准确率达到99%，覆盖100%，提升至95%，增长至 96%，另有97%"),
    (-3, "工作经历\n2019.01-2021.06 青石科技有限公司 数据工程师\n覆盖100%，留存99%，准确率98%"),
    (-4, "项目经历\n某大型互联网企业项目\n增长至30%，提升至 40%，提升50%，增长20%，98%，97%"),
)


def with_constructed(spark, sf_dir):
    made = spark.createDataFrame([(*row, "周小舟", "a.pdf") for row in CONSTRUCTED], "doc_id long, text string, name string, filename string")
    return rules.screen(parsing.parse(docs(spark, sf_dir).unionByName(made)))


def _rule_query(name: str, *codes: str) -> None:
    def run(spark, sf_dir):
        source = with_constructed if name in ("rule_vague", "rule_perfect_numbers") else screened
        rows = source(spark, sf_dir).select("doc_id", F.explode("findings").alias("f")).where(F.col("f.code").isin(*codes))
        return rows.select("doc_id", F.col("f.code").alias("code"), F.col("f.level").alias("level"), F.col("f.flag").alias("flag"), F.col("f.evidence").alias("evidence"))

    run.__name__ = name
    query(run)


RULES = {
    "rule_professional_match": ("other_major", "no_data_skill"), "rule_timeline": ("overlap",), "rule_vague": ("vague_employer", "vague_duty"),
    "rule_perfect_numbers": ("perfect_numbers",), "rule_skill_exaggeration": ("overstated", "strong_wording"), "rule_work_experience": ("no_work", "no_dates"),
    "rule_education": ("no_education",),
}
for _name, _codes in RULES.items():
    _rule_query(_name, *_codes)


@query
def overall_risk(spark, sf_dir):
    return screened(spark, sf_dir).select("doc_id", "overall", *[F.col("levels")[k].alias(k) for k, _ in lx.DIMENSIONS])


@query
def risk_summary(spark, sf_dir):
    return screened(spark, sf_dir).select("doc_id", "summary")


@query
def skill_counts(spark, sf_dir):
    return screened(spark, sf_dir).select("doc_id", "strong", "moderate", "technologies", "excess")


@query
def report_overview(spark, sf_dir):
    return reports.overview(screened(spark, sf_dir))


@query
def report_detail(spark, sf_dir):
    return reports.detail(screened(spark, sf_dir)).select("doc_id", "name", "dimension", "level", "flag", "evidence")


@query
def risk_distribution(spark, sf_dir):
    return reports.risk_distribution(screened(spark, sf_dir))


@query
def high_risk_list(spark, sf_dir):
    return reports.shortlist(screened(spark, sf_dir), 2)


@query
def medium_risk_list(spark, sf_dir):
    return reports.shortlist(screened(spark, sf_dir), 1)


@query
def quality_distribution(spark, sf_dir):
    return reports.quality_distribution(screened(spark, sf_dir))


@query
def medium_by_dimension(spark, sf_dir):
    return reports.medium_by_dimension(screened(spark, sf_dir))


@query
def medium_parse_issue(spark, sf_dir):
    return reports.totals(screened(spark, sf_dir)).select("medium_with_parse_issue")


@query
def run_totals(spark, sf_dir):
    return reports.totals(screened(spark, sf_dir)).select("n", "high", "medium", "low")


@query
def top_medium_candidates(spark, sf_dir):
    return reports.top_medium(screened(spark, sf_dir))


@query
def summary_stats(spark, sf_dir):
    return reports.summary_stats(screened(spark, sf_dir))


@query
def console_digest(spark, sf_dir):
    return reports.digest(screened(spark, sf_dir))


@query
def run_reply(spark, sf_dir):
    return reports.reply(screened(spark, sf_dir))


@query
def safe_stem(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.safe_stem(F.col("filename"), F.concat(F.lit("document-"), F.col("doc_id").cast("string"))).alias("stem"))


@query
def deep_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.deep_clean(F.col("text")).alias("cleaned"))


PROFILE = {
    "profile_gender": "性别", "profile_age": "年龄", "profile_phone": "手机", "profile_email": "邮箱", "profile_years": "工作年限", "profile_position": "目标岗位",
    "profile_education": "学历信息", "profile_companies": "工作经历", "profile_skills": "技能特长", "profile_name": "姓名",
}


def _profile_query(name: str, column: str) -> None:
    def run(spark, sf_dir):
        return profile.extract(docs(spark, sf_dir)).select("doc_id", F.col(column).alias("value"))

    run.__name__ = name
    query(run)


for _name, _column in PROFILE.items():
    _profile_query(_name, _column)


@query
def profile_summary(spark, sf_dir):
    return profile.extract(docs(spark, sf_dir))


@query
def legacy_clean(spark, sf_dir):
    return legacy.parse(docs(spark, sf_dir)).select("doc_id", "clean_text")


@query
def legacy_sections(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("lines")) for c in ("education", "work_experience", "skills")])
    rows = legacy.parse(docs(spark, sf_dir)).select("doc_id", F.explode(each).alias("s")).where(F.size("s.lines") > 0)
    return rows.select("doc_id", F.col("s.section").alias("section"), F.size("s.lines").alias("n"), F.array_join("s.lines", "\n").alias("lines"))


def _legacy(spark, sf_dir):
    return legacy.screen(legacy.parse(docs(spark, sf_dir)))


@query
def legacy_findings(spark, sf_dir):
    rows = _legacy(spark, sf_dir).select("doc_id", F.explode("findings").alias("f"))
    return rows.select("doc_id", F.col("f.dimension").alias("dimension"), F.col("f.code").alias("code"), F.col("f.level").alias("level"))


@query
def legacy_overview(spark, sf_dir):
    six = [k for k, _ in lx.DIMENSIONS if k != "professional_match"]
    return _legacy(spark, sf_dir).select("doc_id", "name", rules.label(F.col("overall")).alias("overall"), *[rules.label(F.col("levels")[k]).alias(k) for k in six], "summary")


@query
def legacy_totals(spark, sf_dir):
    return _legacy(spark, sf_dir).groupBy(rules.label(F.col("overall")).alias("level")).agg(F.count("*").alias("n"))


@query
def path_prune(spark, sf_dir):
    folder = F.expr("CASE doc_id % 5 WHEN 0 THEN 'x_Extraction_debug' WHEN 1 THEN '__pycache__' ELSE 'in' END")
    lock = F.expr("CASE doc_id % 7 WHEN 0 THEN '~$' WHEN 1 THEN '风险评估报告-' ELSE '' END")
    rows = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/data/"), folder, F.lit("/"), lock, "filename").alias("path"))
    return rows.where(files.wanted(F.col("path")))


@query
def json_input(spark, sf_dir):
    as_text = F.to_json(F.array(F.struct("text", "name", "filename")))
    as_content = F.to_json(F.struct(F.col("text").alias("content"), "name", "filename"))
    rows = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, as_text).otherwise(as_content).alias("j"))
    return files.json_elements(rows, "j", ["doc_id"]).select("doc_id", "text", "name", "filename")
