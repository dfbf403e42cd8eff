"""Parsing, rules and reports on invented documents, and the queries against DuckDB."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docrisk.operators import legacy, parsing, profile, reports, rules

SCHEMA = "doc_id long, text string, name string, filename string"
FULL = (
    "工作经验：\n2018.01-2020.06 云上科技有限公司 数据开发工程师\n负责报表开发\n2020.02--至今 山海软件有限公司 数据分析师\n项目经历\n2019.01-2019.08 风控平台\n使用 spark 与 hive\n"
    "专业技能：\n精通SQL\n" + "长" * 121 + "\n教育背景\n2014.09-2018.06 青石大学 计算机 本科\n工作经历\n2010.01-2011.01 旧事集团 经理"
)


def parse(spark, *docs):
    return {r["doc_id"]: r for r in parsing.parse(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], SCHEMA)).collect()}


def test_sections(spark):
    r = parse(spark, (FULL, None, "简历-甲-周小舟.pdf"))[0]
    assert r["work_experience"] == ["2018.01-2020.06 云上科技有限公司 数据开发工程师", "负责报表开发", "2020.02--至今 山海软件有限公司 数据分析师"]  # the second section is left out
    assert r["project_experience"] == ["2019.01-2019.08 风控平台", "使用 spark 与 hive"] and r["skills"] == ["精通SQL"]
    assert r["education"] == ["2014.09-2018.06 青石大学 计算机 本科"] and r["name"] == "周小舟" and r["parse_quality"]["quality"] == "正常" or r["parse_quality"]["warnings"] == ["文本抽取内容较短"]


def test_rules(spark):
    parsed = parsing.parse(spark.createDataFrame([(1, FULL, "甲", None), (2, "技能栈\n精通茶艺 精通花艺 顶级剪纸\n", "乙", None), (3, None, None, None), (4, "", None, "")], SCHEMA))
    rows = {r["doc_id"]: r for r in rules.screen(parsed, (2025, 6)).collect()}
    codes = {k: {f["code"] for f in r["findings"]} for k, r in rows.items()}
    assert "overlap" in codes[1] and codes[2] == {"no_work", "no_education", "no_data_skill", "overstated"}
    assert rows[2]["overall"] == 2 and rows[1]["overall"] == 1 and codes[3] == codes[4] == {"no_work", "no_education"}
    assert rows[3]["summary"] == "[学历]低;[工作经历]中" and rows[3]["name"] == "未知"


def test_overlap_of_two_and_three_months(spark):
    docs = [(i, f"工作经历\n2018.01-2020.06 甲集团 经理\n2020.0{m}-2021.01 乙集团 经理", "n", None) for i, m in ((1, 4), (2, 3))]
    rows = {r["doc_id"]: {f["code"] for f in r["findings"]} for r in rules.screen(parsing.parse(spark.createDataFrame(docs, SCHEMA))).collect()}
    assert "overlap" not in rows[1] and "overlap" in rows[2]


def test_reports_of_nothing(spark):
    empty = rules.screen(parsing.parse(spark.createDataFrame([], SCHEMA)))
    assert [(r["level"], r["n"], r["share"]) for r in reports.risk_distribution(empty).collect()] == [("低", 0, None), ("中", 0, None), ("高", 0, None)]
    assert reports.overview(empty).count() == 0 and reports.shortlist(empty, 2).count() == 0


def test_numbered(spark):
    df = spark.range(0, 1000).selectExpr("1000 - id AS doc_id")
    rows = reports.numbered(df, "doc_id", partitions=7).collect()
    assert sorted((r["doc_id"], r["seq"]) for r in rows) == [(i, i) for i in range(1, 1001)]


def test_profile_and_legacy(spark):
    df = spark.createDataFrame([(1, "张 三 女 年龄：31\n手机 138-1234-5678 邮箱 a.b@c.example\n目标职能：数据开发工程师", None, "x.pdf"), (2, None, None, None)], SCHEMA)
    rows = {r["doc_id"]: r for r in profile.extract(df).collect()}
    assert (rows[1]["性别"], rows[1]["年龄"], rows[1]["手机"], rows[1]["目标岗位"], rows[1]["姓名"]) == ("女", "31", "13812345678", "数据开发工程师", "x") and rows[2]["邮箱"] == ""
    assert legacy.screen(legacy.parse(df)).count() == 2


LEGACY_NAMES = {
    "求职意向\n姓 名：　周小舟\n张三 13812345678": "周小舟",  # gap and wide colon; lines come before patterns
    "张三 138-1234-5678": "张三", "欧阳小舟 13812345678": "阳小舟", "李四　个人简历": "李四", "王小明~ 女": "王小明", "赵六 7": "赵六",
    "~`;(孙) 七\n钱八九十一": "钱八九十", "": "未知", None: "未知", "resume only": "未知", "x" * 200 + "吴九": "未知", "x" * 198 + "吴九": "吴九",
    "甲乙 个人简历\n丙丁 13812345678": "甲乙", "甲乙 个人简历 丙丁 13812345678": "丙丁",
}


def test_legacy_name(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "", None) for i, t in enumerate(LEGACY_NAMES)] + [(99, "姓名：周小舟", "甲", None)], SCHEMA)
    rows = {r["doc_id"]: r["name"] for r in legacy.parse(df).collect()}
    assert [rows[i] for i in range(len(LEGACY_NAMES))] == list(LEGACY_NAMES.values()) and rows[99] == "甲"


def legacy_name(text):
    """By Python's regular expressions, line by line."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    patterns = [r"姓\s*名[：:\s]*([一-龥]{2,4})", r"([一-龥]{2,3})\s{1,3}\d{3}[-\d]{7,}", r"^([一-龥]{2,3})\s+(?:个人简历|简历|求职)", r"([一-龥]{2,4})\s{0,3}[_~\d](?:\s|$)"]
    found = [m[1] for x in lines for m in [next(filter(None, (re.search(p, x) for p in patterns)), None)] if m]
    start = re.search("[一-龥]{2,4}", " ".join(re.sub("[~`();•–-]", "", x).strip() for x in lines)[:200])
    return found[0] if found else start[0] if start else "未知"


def test_legacy_name_of_all_texts(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = parsing.documents(spark.read.parquet(f"{sf}/resumes_for_analysis.parquet")).withColumn("name", F.lit(None).cast("string")).persist()
    want = sorted((r["doc_id"], legacy_name(r["text"])) for r in docs.collect())
    assert sorted((r["doc_id"], r["name"]) for r in legacy.parse(docs).collect()) == want


@pytest.mark.parametrize("name", ["section_extract", "work_lines", "overall_risk", "report_detail", "medium_by_dimension", "profile_summary", "legacy_findings", "summary_stats"])
def test_against_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r[c] for c in columns)) for r in __spark_entry__.queries()[name](spark, sf).collect())
    assert got == want


def test_documents_of_files_in_one_scan(spark, tmp_path):
    rows = [(1, "甲", "n", "f"), (1, "甲", "n", "f"), (2, "乙", None, None), (2, "乙", None, None), (2, "丙", "m", None), (None, "丁", "k", "f"), (None, "丁", "k", "f"), (3, None, None, "f")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, name string, filename string").withColumn("extra", F.lit(1))
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    got = parsing.documents(spark.read.parquet(str(tmp_path / "t")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = sorted([(1, "甲", "n", "f"), (2, "乙", None, None), (2, "丙", "m", None), (3, None, None, "f")] + [(None, "丁", "k", "f")] * 4, key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len([x for x in plan.split("ReadSchema") if "text:string" in x[:120]]) == 1  # texts are read once
    empty = spark.createDataFrame([], df.schema)
    empty.write.parquet(str(tmp_path / "e"))
    assert parsing.documents(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_reply_names_dimensions_and_places(spark):
    text = "工作经历\n2019.01-2021.06 甲科技有限公司 数据工程师\n2020.01-2022.03 乙科技有限公司 数据工程师\n教育经历\n2010.09-2014.06 青石大学 计算机 本科"
    df = spark.createDataFrame([(1, text, "甲", "a.pdf"), (2, text, "乙", "b.pdf")], "doc_id long, text string, name string, filename string")
    row = reports.reply(rules.screen(parsing.parse(parsing.documents(df))), "out.xlsx", "debug").first()["reply"]
    assert row.startswith("共 2 份；高风险 0，中风险 2") and "主要中风险维度：" in row and row.endswith("；报告：out.xlsx；调试文件：debug")
    none = reports.reply(rules.screen(parsing.parse(df.where("false")))).first()["reply"]
    assert none.endswith("主要中风险维度：无")
