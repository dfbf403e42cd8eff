"""Contact and profile fields of a document, one row of strings per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk import lexicon as lx
from docrisk.functions import text
from docrisk.functions.text import DIGIT, WS, WS_INNER

FIELDS = ("姓名", "性别", "年龄", "工作年限", "手机", "邮箱", "目标岗位", "学历信息", "工作经历", "技能特长")
COMPANY = rf"{DIGIT}{{4}}[./-]{DIGIT}{{1,2}}[-~–]{DIGIT}{{4}}[./-]?{DIGIT}{{0,2}}[一-龥a-zA-Z0-9（）()]{{4,30}}(?:{lx.PROFILE_COMPANY_ENDS})"


def _first(lines: Column, n: int, cut: int, separator: str) -> Column:
    return F.array_join(F.transform(F.slice(lines, 1, n), lambda x: F.substring(x, 1, cut)), separator)


def extract(docs: DataFrame, name_prefix: str = "") -> DataFrame:
    """(doc_id, ten fields); what isn't found is an empty string. ``name_prefix`` is cut from file names."""
    t, packed = F.col("_text"), F.col("_packed")
    empty = F.lit("")
    find = lambda p, k=1, c=t: F.coalesce(text.capture(c, p, k), empty)
    kinds = F.array_join(F.transform(packed, lambda x: F.when(F.substring(x, 1, 8).rlike(lx.PROFILE_SKILL_STARTS) & (F.length(x) < 20), "h")
                                     .when(F.substring(x, 1, 6).rlike(lx.PROFILE_SKILL_STOPS) & (F.length(x) < 15), "s").otherwise("x")), "")
    education = F.filter(packed, lambda x, i: x.rlike(lx.PROFILE_EDUCATION) & (F.length(x) > 6) & ((i == 0) | ~F.coalesce(F.get(packed, i - 1).rlike(lx.PROFILE_NOT_AFTER), F.lit(False))))
    skills = F.filter(packed, lambda x, i: (F.substring(F.col("_kinds"), i + 1, F.lit(1)) == "x") & F.substring(F.col("_kinds"), F.lit(1), i).rlike("^[^h]*h[^s]*$") & (F.length(x) > 5))
    top = F.transform(F.slice("_lines", 1, 15), lambda x: F.substring(x, 1, 30))
    file_name = F.replace(F.coalesce("filename", empty), F.lit(".pdf"), empty)
    years = text.capture(t, rf"(?:工作|从业){WS}*年{WS}*限[：:{WS_INNER}]*({DIGIT}+){WS}*年")
    return (
        docs.withColumn("_text", text.deep_clean(F.col("text"))).withColumn("_lines", F.split("_text", "\n"))
        .withColumn("_packed", F.transform("_lines", text.without_space)).withColumn("_kinds", kinds)
        .select(
            "doc_id",
            (F.replace(file_name, F.lit(name_prefix), empty) if name_prefix else file_name).alias("姓名"),
            F.when(F.exists(top, lambda x: x.contains("男")), "男").when(F.exists(top, lambda x: x.contains("女")), "女").otherwise("").alias("性别"),
            F.coalesce(text.capture(t, rf"年龄[：:{WS_INNER}]*({DIGIT}{{2}})"), text.capture(F.substring(t, 1, 300), rf"({DIGIT}{{2}}){WS}*岁"), empty).alias("年龄"),
            F.coalesce(F.concat(years, F.lit("年")), empty).alias("工作年限"),
            F.translate(find(rf"1[3-9]{DIGIT}[{WS_INNER}-]?{DIGIT}{{4}}[{WS_INNER}-]?{DIGIT}{{4}}", 0), " -", "").alias("手机"),
            find(r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", 0).alias("邮箱"),
            F.substring(text.without_space(find(rf"目标职能[：:{WS_INNER}]*([^\n]{{5,40}})")), 1, 40).alias("目标岗位"),
            _first(education, 2, 50, " | ").alias("学历信息"),
            _first(F.filter(packed, lambda x: x.rlike(COMPANY)), 3, 70, " | ").alias("工作经历"),
            _first(skills, 10, 45, " ").alias("技能特长"),
        )
    )
