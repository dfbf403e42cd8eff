"""Month ordinals (year * 12 + month) and date ranges of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk.functions.text import DIGIT, WS, ascii_digits, capture

TOKEN = rf"{DIGIT}{{4}}(?:[./-]{DIGIT}{{1,2}})?"
RANGE = rf"({TOKEN}){WS}*(?:--|—|–|-|~|至){WS}*({TOKEN}|至今|现在)"
RANGE_TYPE = "array<struct<s:int,i:int,e:int,line:string>>"


def month_ordinal(token: Column, as_of: tuple[int, int]) -> Column:
    t = ascii_digits(token)
    year, month = (capture(t, r"^([0-9]{4})(?:[./-]([0-9]{1,2}))?$", k).try_cast("int") for k in (1, 2))
    return F.when(token.isin("至今", "现在", "今"), F.lit(as_of[0] * 12 + as_of[1])).otherwise(year * 12 + F.coalesce(month, F.lit(1)))


def has_range(line: Column) -> Column:
    return line.rlike(RANGE)


def ranges(lines: Column, as_of: tuple[int, int]) -> Column:
    """The first range of each line that has one, as (s, i, e, line); reversed bounds are swapped."""

    def one(line: Column, i: Column) -> Column:
        a, b = (month_ordinal(F.regexp_extract(line, RANGE, k), as_of) for k in (1, 2))
        return F.struct(F.least(a, b).alias("s"), i.cast("int").alias("i"), F.greatest(a, b).alias("e"), line.alias("line"))

    return F.filter(F.transform(lines, one), lambda r: r["line"].rlike(RANGE) & r["s"].isNotNull())


def first_overlap(found: Column, months: int = 3) -> Column:
    """The line of the first range, by start, that begins ``months`` or more before an earlier one ended."""
    start = F.struct(F.lit(None).cast("int").alias("latest"), F.lit(None).cast("string").alias("line"))

    def step(acc: Column, r: Column) -> Column:
        hit = acc["line"].isNull() & (acc["latest"] - r["s"] >= months)
        return F.struct(F.greatest(acc["latest"], r["e"]).alias("latest"), F.when(hit, r["line"]).otherwise(acc["line"]).alias("line"))

    return F.aggregate(F.array_sort(found), start, step)["line"]


def months_total(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, r: a + r["e"] - r["s"])
