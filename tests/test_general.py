"""Packed values, timestamps and intervals on small fixtures with results worked out by hand."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docrisk.operators import intervals, packed_values, timestamps

NAMES = ["CI/CD", "Spark SQL", "Go", "Google Sheets", "C++", "Hive"]


def split(spark, cells):
    df = spark.createDataFrame([(i, c, "extra") for i, c in enumerate(cells)], "doc_id long, cell string, item_text string")
    rows = packed_values.split_values(df.select("doc_id", "cell"), "cell", NAMES, ["doc_id"]).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["item_no"])):
        out.setdefault(r["doc_id"], []).append(r["item_text"])
    return [out.get(i, []) for i in range(len(cells))]


def test_split_values(spark):
    cells = {
        "CI/CD/Hive": ["CI/CD", "Hive"], "Hive Go": ["Hive", "Go"], "Spark SQL": ["Spark SQL"], "熟悉Hive、Go 和 C++": ["熟悉Hive", "Go", "C++"],
        '"a,b；c"；Hive': ["a,b；c", "Hive"], "①Hive ②Go": ["Hive", "Go"], "(1)Hive\t(2)C++": ["Hive", "C++"], ",,Hive,,": ["Hive"], "": [], " 　": [],
        "Google Sheets  Go": ["Google Sheets", "Go"], "Hive, my tool": ["Hive", "my tool"],
    }
    assert split(spark, list(cells)) == list(cells.values())
    assert split(spark, [None, "Hive"]) == [[], ["Hive"]]


def test_split_values_long_and_empty(spark):
    assert split(spark, ["、".join(["Hive"] * 500)]) == [["Hive"] * 500]
    assert split(spark, [None]) == [[]]


DATES = [
    ("2018-2022", []), ("2016.08—2017/9", ["2016-08", "2017-09"]), ("1999-09-16T23:30:00 ~ 至今", ["1999-09-16T15:30:00Z"]),
    ("1988-07-01 12:00:00", ["1988-07-01T03:00:00Z"]),  # summer time
    ("2001-02-03 10:00:00 CST", ["2001-02-03T02:00:00Z"]), ("Fri, 03 Jun 2011 08:45:00 +0100", ["2011-06-03T07:45:00Z"]),
    ("Sep 1, 2002 - Jun 2005", ["2002-09-01", "2005-06"]), ("二〇一五年十二月", ["2015-12"]), ("一九九九年十月 至 二〇〇一年十一月二十三日", ["1999-10", "2001-11-23"]),
    ("13/06/2014 – 06/25/2015", ["2014-06-13", "2015-06-25"]), ("１９９８．０９", ["1998-09"]), ("20190901T020500Z", ["2019-09-01T02:05:00Z"]),
    ("1536595200661 → 1379084442", ["2018-09-10T16:00:00Z", "2013-09-13T15:00:42Z"]), ("2009年9月7日 下午10:05", ["2009-09-07T14:05:00Z"]),
    ("7 Sep 1994 12:15 AM", ["1994-09-06T16:15:00Z"]), ("2012-09-07 22:45 America/New_York", ["2012-09-08T02:45:00Z"]), ("累计 16419174425 条", []), ("无日期", []),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, [None, line], None) for i, (line, _) in enumerate(DATES)] + [(99, None, None)], "doc_id long, lines array<string>, parsed_at timestamp")
    rows = timestamps.normalised_dates(df, ["lines"]).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["bound_no"])):
        assert r["line_no"] == 1
        got.setdefault(r["doc_id"], []).append(r["norm_value"])
    for i, (line, want) in enumerate(DATES):
        assert got.get(i, []) == want, line


def test_local_times_twice_and_skipped(spark):
    df = spark.createDataFrame([(1, ["1986-09-14 00:30:00", "1986-05-04 02:30:00"])], "doc_id long, lines array<string>")
    rows = {r["line_no"]: r["norm_value"] for r in timestamps.normalised_dates(df, ["lines"], zone="America/New_York").collect()}
    assert len(rows) == 2
    twice = spark.createDataFrame([(1, ["2024-11-03 01:30:00", "2024-03-10 02:30:00"])], "doc_id long, lines array<string>")
    rows = {r["line_no"]: r["norm_value"] for r in timestamps.normalised_dates(twice, ["lines"], zone="America/New_York").collect()}
    assert rows == {0: "2024-11-03T05:30:00Z", 1: "2024-03-10T07:30:00Z"}


def test_zone_estimate_finds_another_history(spark):
    # local times of Tokyo beside the same instants in UTC: only the right history gives no reversed pairs
    rows = [(i, [f"2020-01-{d:02d} 09:30:00 ~ 2020-01-{d:02d}T00:31:00Z", f"2020-02-{d:02d}T00:29:00Z ~ 2020-02-{d:02d} 09:30:00"]) for i, d in enumerate(range(1, 29))]
    df = spark.createDataFrame(rows, "doc_id long, lines array<string>").withColumn("at", F.lit(None).cast("timestamp"))
    zone, counts = timestamps.estimate_zone(timestamps.date_tokens(df, ["lines"], ["doc_id", "at"]), ["doc_id", "line_no"], "at")
    assert zone == "Asia/Tokyo" and counts["Asia/Tokyo"] == 0
    empty = df.where("false")
    assert timestamps.estimate_zone(timestamps.date_tokens(empty, ["lines"], ["doc_id", "at"]), ["doc_id", "line_no"], "at")[0] == "Asia/Shanghai"


def brute(spans):
    months = {m for a, b in spans for m in range(min(a, b), max(a, b) + 1)}
    out, run = [], None
    for m in sorted(months):
        if run and m == run[1] + 1:
            run[1] = m
        else:
            run = [m, m]
            out.append(run)
    gaps = [("gap", a[1] + 1, b[0] - 1) for a, b in zip(out, out[1:])]
    return sorted([("period", a, b) for a, b in out] + gaps)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_intervals_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(k, a := rng.randrange(200), a + rng.randrange(-3, 9)) for k in [0] * 300 + list(range(1, 15)) * 5]
    df = spark.createDataFrame(rows + [(0, None, None), (0, None, 500), (None, 3, 4)], "k int, a int, b int")
    merged = intervals.merge_intervals(df, ["k"], "a", "b", fan_in=8, levels=levels)
    got = {}
    for r in intervals.periods_and_gaps(merged, ["k"], "a", "b").collect():
        got.setdefault(r["k"], []).append((r["span_kind"], r["a"], r["b"]))
    want = {}
    for k, a, b in rows + [(0, 500, 500), (None, 3, 4)]:
        want.setdefault(k, []).append((a, b))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(v) for k, v in want.items()}


def test_experience_spans(spark):
    df = spark.createDataFrame([(1, ["2001.03-2001.01 甲", "2001.05–至今 乙", "无"]), (2, None), (3, [])], "doc_id long, work array<string>")
    rows = {(r["doc_id"], r["span_kind"], r["from_month"], r["to_month"]) for r in intervals.experience_spans(df, ["work"]).collect()}
    y = 2001 * 12
    assert rows == {(1, "period", y + 1, y + 3), (1, "gap", y + 4, y + 4), (1, "period", y + 5, 2025 * 12 + 6)}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_final_merge_in_any_batches(size):
    """One linear pass over sorted rows, whatever batches they come in, keys being strings, numbers and nulls."""
    rng = random.Random(size)
    keys = [("a", 1), ("a", None), ("b", 1), (None, 2)]
    rows = [(*k, a := rng.randrange(-30, 60), a + rng.randrange(6)) for k in keys for _ in range(rng.randrange(1, 25))]
    rows.sort(key=lambda r: (keys.index(r[:2]), r[2]))
    schema = pa.schema([("k", pa.string()), ("n", pa.int64()), ("_s", pa.int32()), ("_e", pa.int32())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), schema.types)], schema=schema) for i in range(0, len(rows), size)]
    got = [((k, n), [("period", x["s"], x["e"]) for x in spans]) for b in intervals._final(2, ["k", "n", "spans"])(iter(batches)) for k, n, spans in zip(*(c.to_pylist() for c in b.columns))]
    want = {k: [x for x in brute([(s, e) for *q, s, e in rows if tuple(q) == k]) if x[0] == "period"] for k in keys}
    assert len(got) == len(keys) and dict(got) == want
    assert list(intervals._final(2, ["k", "n", "spans"])(iter([]))) == []


def test_merging_is_linear():
    times = []
    for n in (500_000, 4_000_000):  # both beyond the processor's caches
        s, group, took = np.arange(n, dtype=np.int64) * 3, np.zeros(n, np.int64), []
        for _ in range(3):
            began = time.process_time()
            intervals.disjoint(group, s, s + 1)
            took.append(time.process_time() - began)
        times.append(min(took))
    assert times[1] < 8 * 4 * times[0]  # eight times the intervals; a quadratic merge takes 64 times as long


def test_skeletons_are_few_and_names_are_protected(spark):
    assert len(packed_values.rules()) == 65 and dict(packed_values.rules())["bd"] == "dwn" and dict(packed_values.rules())["b"] == "dwnb"
    many = ["a/b" + str(i) for i in range(3000)] + ["A-B", "A-BC", "x+"]
    df = spark.createDataFrame([(1, "a/b7/a/b2999、A-BC A-B"), (2, "A-BCD、x+/y"), (3, "a/b12 a/b1")], "doc_id long, cell string")
    got = {}
    for r in sorted(packed_values.split_values(df, "cell", many, ["doc_id"]).collect(), key=lambda r: (r["doc_id"], r["item_no"])):
        got.setdefault(r["doc_id"], []).append(r["item_text"])
    assert got == {1: ["a/b7", "a/b2999", "A-BC A-B"], 2: ["A-BCD", "x+", "y"], 3: ["a/b12", "a/b1"]}


def test_zones_of_groups_within_one_table(spark):
    """Accounts whose local times follow Tokyo, New York and the declared zone, each told by its own lines."""
    clock = {"Asia/Tokyo": ("09:30", "00:31"), "Asia/Shanghai": ("08:30", "00:31"), "America/New_York": ("19:30", "00:31")}
    rows = []
    for account, zone in ((1, "Asia/Tokyo"), (2, "Asia/Shanghai"), (3, "America/New_York"), (None, "Asia/Tokyo")):
        local, utc = clock[zone]
        for d in range(2, 28):
            day = d - (zone == "America/New_York")
            lines = [f"2020-01-{day:02d} {local} ~ 2020-01-{d:02d}T{utc}:00Z", f"2020-01-{d:02d}T00:29:00Z ~ 2020-01-{day:02d} {local}"]
            rows.append((100 * (account or 9) + d, account, lines))
    rows.append((7, 4, ["2020-01-02 09:30 ~ 2020-01-02T00:31:00Z"]))  # too little to tell
    df = spark.createDataFrame(rows, "doc_id long, account int, lines array<string>").withColumn("at", F.lit(None).cast("timestamp"))
    zoned = {r["account"]: r["_home"] for r in timestamps.with_zone(df, ["lines"], "doc_id", "at", "account").select("account", "_home").distinct().collect()}
    assert zoned == {1: "Asia/Tokyo", 2: "Asia/Shanghai", 3: "America/New_York", 4: "Asia/Shanghai", None: "Asia/Shanghai"}
    got = {(r["doc_id"], r["line_no"], r["bound_no"]): r["norm_value"] for r in timestamps.normalised_dates(df, ["lines"], ingested_at="at", group="account").collect()}
    assert got[102, 0, 1] == got[202, 0, 1] == got[302, 0, 1] == "2020-01-02T00:30:00Z" and got[902, 0, 1] == "2020-01-02T01:30:00Z"
    late = spark.createDataFrame([(i, 1, [f"2020-0{4 + i % 6}-01 00:30 ~ 2020-0{4 + i % 6}-01T04:31:00Z", f"2020-0{4 + i % 6}-01T04:29:00Z ~ 2020-0{4 + i % 6}-01 00:30"]) for i in range(30)], "doc_id long, account int, lines array<string>")
    late = timestamps.with_zone(late.withColumn("at", F.lit(None).cast("timestamp")), ["lines"], "doc_id", "at", "account")
    assert late.first()["_home"] == "America/New_York"  # four hours behind only by its summer time
    assert timestamps.normalised_dates(df.where("false"), ["lines"], ingested_at="at", group="account").count() == 0
