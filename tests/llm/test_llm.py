"""The text-preparation operators on invented fixtures, against brute force where SQL can't say it."""

import datetime as dt
import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docrisk.llm import canonical, layout, mixing, mojibake, packing, personal, queries, residue, scan_noise, tokens

TEXT = "field_name string, doc_id long, text string"


# --- canonical lists -------------------------------------------------------------------------------
def osa_free(a, b):
    """Unrestricted Damerau-Levenshtein by breadth-first search over edits."""
    letters, seen, wave, d = set(a + b), {a}, {a}, 0
    while b not in wave:
        d, new = d + 1, set()
        for s in wave:
            for i in range(len(s) + 1):
                new |= {s[:i] + c + s[i:] for c in letters if len(s) <= len(b)} | ({s[:i] + s[i + 1 :]} if i < len(s) else set())
                new |= {s[:i] + c + s[i + 1 :] for c in letters} if i < len(s) else set()
                new |= {s[:i] + s[i + 1] + s[i] + s[i + 2 :]} if i + 1 < len(s) else set()
        wave = new - seen
        seen |= new
    return d


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=4), st.text("abc", max_size=4))
def test_distance(a, b):
    assert canonical.distance(a, b) <= osa_free(a, b) if a else canonical.distance(a, b) == len(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("甲乙丙丁", min_size=1, max_size=6), min_size=1, max_size=30), st.text("甲乙丙丁", max_size=6), st.integers(0, 3))
def test_tree_finds_all(entries, query, threshold):
    tree = canonical.BKTree([(t, i) for i, t in enumerate(entries)])
    assert {t for _, t, _ in tree.within(query, threshold)} == {t for t in entries if canonical.distance(query, t) <= threshold}


def test_map_values(spark):
    entries = spark.createDataFrame([("数据开发工程师", 1), ("培训讲师", 2), ("云平台架构师", 3)], "term string, ref_id int")
    values = [(1, "高级数据开法工程师"), (2, "培训讲狮（青砚）"), (3, "陶艺烧成师"), (4, None), (5, " "), (6, "雲平台架構師|随时到岗"), (6, "雲平台架構師|随时到岗")]
    df = spark.createDataFrame(values, "doc_id long, part string")
    rows = sorted((r["doc_id"], r["ref_id"]) for r in canonical.map_values(df, "part", entries, canonical.core_of_title).collect())
    assert rows == [(1, 1), (2, 2), (3, 0), (6, 3), (6, 3)]
    cores = spark.createDataFrame([("数据开发工程狮",), ("无",)], "core string")
    sharded = {r["core"]: r["ref_id"] for r in canonical.match_cores(cores, entries, False, one_tree=1, shards=2).collect()}
    assert sharded == {"数据开发工程狮": 1, "无": 0}


def test_shards_agree_with_one_tree(spark):
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choices("甲乙丙丁戊", k=rng.randrange(low, high)))
    terms = [("abcdefgh", 1), ("abcd", 2), *((word(2, 9), i) for i in range(3, 90))]
    asked = ["abcdefgx", "abcdxyz", *(word(1, 13) for _ in range(150)), *(t + word(1, 4) for t, _ in terms)]
    entries, cores = spark.createDataFrame(terms, "term string, ref_id int"), spark.createDataFrame([(c,) for c in sorted(set(asked))], "core string")
    for prefixes in (True, False):
        one = {r["core"]: r["ref_id"] for r in canonical.match_cores(cores, entries, prefixes).collect()}
        many = {r["core"]: r["ref_id"] for r in canonical.match_cores(cores, entries, prefixes, one_tree=30).collect()}
        assert one == many and one["abcdefgx"] == 1 and (not prefixes or one["abcdxyz"] == 2)


@settings(max_examples=60, deadline=None)
@given(st.text("甲乙丙", max_size=7), st.text("甲乙丙", max_size=6))
def test_distances_of_beginnings(a, b):
    assert canonical.distances(a, b) == [canonical.distances(a[:i], b)[-1] for i in range(len(a) + 1)]
    assert canonical.distance(a, b) == canonical.distance(b, a) == osa_free(a, b) if len(a) <= 3 and len(b) <= 3 else True


def test_short_forms_and_tails_come_from_the_data(spark):
    titles = spark.createDataFrame([(1, "陶艺烧制匠人", "Potter"), (2, "木器雕刻匠人", "Carver"), (3, "驿站信使", None), (4, None, None)], "i int, t string, e string")
    assert {(r["term"], r["ref_id"]) for r in canonical.title_entries(titles, "i", "t", "e").collect()} == {
        ("陶艺烧制匠人", 1), ("陶艺烧制", 1), ("potter", 1), ("木器雕刻匠人", 2), ("木器雕刻", 2), ("carver", 2), ("驿站信使", 3)}
    entries = spark.createDataFrame([("青石大学", 1), ("白川大学", 2), ("红叶大学", 3), ("青石大学医学院", 4)], "term string, ref_id int")
    cores = [(a + "大学" + t,) for a in ("青石", "白川", "红叶") for t in ("", "园艺", "天文")] + [("青石太学园艺",), ("青石大学医学院",)]
    assert canonical.learn_tails(spark.createDataFrame(cores, "core string"), entries) == ["园艺", "天文"]
    values = spark.createDataFrame([(1, "青石太学园艺"), (2, "白川大学天文"), (3, "青石大学医学院"), (4, "天文")] + [(9 + i, c[0]) for i, c in enumerate(cores)], "doc_id long, part string")
    got = {r["doc_id"]: r["ref_id"] for r in canonical.map_values(values, "part", entries, canonical.core_of_school, True).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [1, 2, 4, 0]


# --- personal information --------------------------------------------------------------------------
def test_spans():
    text = "姓名：欧阳小舟，女\n电话：+86 138 1234 5678 邮箱 a.b＠c.example\n身份证110101-19900307-7715\n住址：青石市东区听松街12号3栋401室 附近\n合同流水号 110101199013077715\n累计处理 13812345678 条记录\n登录 root@node"
    found = {(k, text[a:b]) for k, a, b, v in personal.Finder().spans(text) if "-" not in v}
    assert ("NAME", "欧阳小舟") in found and ("PHONE", "+86 138 1234 5678") in found and ("EMAIL", "a.b＠c.example") in found
    assert ("ADDRESS", "青石市东区听松街12号3栋401室") in found and not any("199013" in s or s == "13812345678" or "node" in s for _, s in found)


def test_find_and_mask(spark):
    rows = [("text", i, f"我叫周小舟，今年30岁\n手机：1381234{i:04d}\n邮箱 a{i}@b.example") for i in range(20)] + [("text", 90, None), ("text", 91, ""), ("手机", 92, "无")]
    df = spark.createDataFrame(rows, TEXT)
    spans = personal.find(df, "doc_id", "text", "field_name", {"手机": "PHONE"})
    assert spans.count() == 60
    masked = {r["doc_id"]: r["masked"] for r in personal.mask(df, spans, "doc_id", "text", "field_name").collect()}
    assert masked[3] == "我叫[NAME]，今年30岁\n手机：[PHONE]\n邮箱 [EMAIL]" and masked[90] is None and masked[92] == "无"
    assert personal.find(df.where("false"), "doc_id", "text", "field_name", {}).count() == 0


def test_bare_names_anywhere(spark):
    duties = "负责数据平台的任务调度与质量监控，按时产出\n" * 30
    rows = [("text", i, f"周小舟\n男 | 3{i % 10}岁\n{duties}技能\n金融\n石油") for i in range(30)]
    rows += [("text", 100, "\n" * 12 + "孙小舟\n男 | 30岁"), ("text", 101, "内部资料\n请勿外传\n第一页\n机密文件\n孙小舟\n电话 见附件"), ("text", 102, f"孙小舟\n男 | 30岁\n{duties}孙小舟\n{duties}金融\n石油")]
    found = personal.find(spark.createDataFrame(rows, TEXT), "doc_id", "text", "field_name", {}).where("pii_kind = 'NAME'").collect()
    spans = {(r["doc_id"], dict((i, t) for _, i, t in rows)[r["doc_id"]][r["char_no"] : r["char_end"]], r["char_no"]) for r in found}
    later = rows[-1][2].rindex("孙小舟")
    assert {x for x in spans if x[0] >= 100} == {(100, "孙小舟", 12), (101, "孙小舟", 19), (102, "孙小舟", 0), (102, "孙小舟", later)}
    assert {x[1] for x in spans} == {"周小舟", "孙小舟"} and len(spans) == 34


def test_the_span_classifier_decides():
    """Spans that the labelers say nothing about are told apart by what surrounds them, and one no-vote is no veto."""
    patterns = {"++++++" + "0151": 200, "------" + "3332": 200, "000000" + "0151": 10, "000000" + "3332": 10, "+++-++" + "0151": 20}
    beta = personal.fit_classifier(patterns, {"++++++": 0.99, "------": 0.01, "000000": 0.5, "+++-++": 0.9})
    score = {p: float(sum(x * y for x, y in zip(personal._features(p), beta))) for p in patterns}
    assert score["0000000151"] > 0 > score["0000003332"] and score["+++-++0151"] > 0
    assert "+++-++0151" in personal.accepted_patterns({"PHONE": patterns})["PHONE"]
    assert personal.span_features("电话：123\n", 3, 6) == "0500" and personal.span_features("a" * 30, 0, 30) == "3000"
    assert personal.accepted_patterns({}) == {}


def test_masking_in_one_pass_equals_masking_by_spans(spark):
    rows = [("text", i, f"我叫周小舟，今年30岁\n手机：1381234{i:04d}\n邮箱 a{i}@b.example") for i in range(20)] + [("text", 90, None), ("text", 91, ""), ("手机", 92, "无"), ("手机", 93, "13812340000")]
    df = spark.createDataFrame(rows, TEXT).withColumn("votes", F.lit("extra"))
    cells = {"手机": "PHONE"}
    two = personal.mask(df, personal.find(df, "doc_id", "text", "field_name", cells), "doc_id", "text", "field_name")
    assert sorted(map(tuple, personal.find_and_mask(df, "doc_id", "text", "field_name", cells).collect())) == sorted(map(tuple, two.collect()))


# --- wrong encodings -------------------------------------------------------------------------------
LINES = ["负责数据平台的任务调度与质量监控", "按时产出率由六成提高到九成", "工作经历和项目经验完整可查", "熟悉报表开发以及需求分析"]


def test_mojibake(spark):
    good = [("text", i, "\n".join(random.Random(i).sample(LINES, 3)) + "\nCafé Müller 2020") for i in range(60)]
    wrong = [("gb18030", "utf-8"), ("cp1252", "utf-8"), ("latin-1", "gb18030"), ("cp1251", "utf-8")]
    bad = []
    for k, (w, r) in enumerate(wrong):
        raw = LINES[0].encode(r)
        text = "".join(bytes([b]).decode(w, "ignore") or chr(b) for b in raw) if w != "gb18030" else raw.decode(w, "replace")
        bad.append(("text", 100 + k, LINES[1] + "\n" + text))
    df = spark.createDataFrame(good + bad + [("text", 200, "丢失��字符"), ("text", 201, None), ("text", 202, "")], TEXT)
    rows = {r["doc_id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text", mojibake.fit(df), ["field_name"]).collect()}
    assert set(rows) == {100, 101, 102, 103, 200}
    assert all(rows[k] == LINES[1] + "\n" + LINES[0] for k in (101, 102, 103))


def test_changed_deliveries_are_read(spark, tmp_path):
    """Rows of one id, name and file name are one text only if their texts agree; a garbled text behind another one is found."""
    good = [(i, "\n".join(random.Random(i).sample(LINES, 3)), "n", "f") for i in range(60)]
    bad = [LINES[1] + "\n" + line.encode().decode("latin-1") for line in LINES]
    changed = [(0, bad[0], "n", "f"), (100, None, "n", "f"), (100, bad[0], "n", "f"), (101, LINES[0], None, "f"), (101, bad[0], "f", None)]
    again = [(102, bad[0], "n", "f")] * 3 + [(103, bad[0], "n", "f"), (103, bad[2], "n", "f"), (104, None, "n", "f"), (104, None, "n", "f")] + good[1:9]
    df = spark.createDataFrame(good + changed + again, "doc_id long, text string, name string, filename string")
    df.repartition(3).write.parquet(str(tmp_path / "resumes_for_analysis.parquet"))
    raw = df.withColumnRenamed("text", "raw_text").withColumn("parsed_at", F.lit(dt.datetime(2024, 1, 1)))
    raw.repartition(3).write.parquet(str(tmp_path / "parsed_resumes.parquet"))
    texts = queries.resume_texts(spark, str(tmp_path)).collect()
    rows = {(i, t) for i, t, _, _ in good + changed + again}
    assert sorted(map(repr, map(tuple, texts))) == sorted(repr((f, *r)) for f in ("text", "raw_text") for r in rows)
    assert sorted(map(tuple, queries.p5_found(spark, str(tmp_path)).collect())) == [(f, i) for f in ("raw_text", "text") for i in (0, 100, 101, 102, 103)]
    assert len([1 for r in queries.p5_restored(spark, str(tmp_path)).collect() if r["doc_id"] == 103]) == 4


# --- scanned pages ---------------------------------------------------------------------------------
def test_scan_noise(spark):
    body = ["负责数据平台的任务调度", "使用Kubernetes搭建指标看板", "near-real-time 延迟可控", "整理规范并培训新人"]
    plain = [("text", i, "\n".join(body)) for i in range(80)]
    page = "负责数椐平台的任务调度\n使用Kuber-\n- 1 -\nnetes搭建指标看板\nnear-\nreal-time 延迟可控\n整埋规范并培训新人\n- 2 -"
    df = spark.createDataFrame(plain + [("text", 500, page), ("text", 501, page), ("text", 502, None), ("text", 503, "")], TEXT)
    model = scan_noise.fit(df, "text")
    rows = {(r["doc_id"], r["line_no"], r["noise_kind"]) for r in scan_noise.find(df, "doc_id", "text", ["field_name"], model).collect()}
    want = {(0, "misread"), (1, "broken_word"), (2, "furniture"), (6, "misread"), (7, "furniture")}
    assert rows == {(d, *w) for d in (500, 501) for w in want}
    fixed = {r["doc_id"]: r["repaired"] for r in scan_noise.repair(df, "doc_id", "text", ["field_name"], model).collect()}
    assert "数据平台" in fixed[500] and "使用Kubernetes搭建" in fixed[500] and "near-real-time" in fixed[500] and "- 1 -" not in fixed[500]


def test_layout():
    assert layout.wrapped([]) == (0, []) and layout.wrapped(["短"]) == (0, [False])


# --- packing ---------------------------------------------------------------------------------------
def fullest(sizes, capacity):
    seed = max(sizes)
    rest = list(sizes)
    rest.remove(seed)
    return max(seed + sum(c) for r in range(len(rest) + 1) for c in itertools.combinations(rest, r) if seed + sum(c) <= capacity)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_first_container_is_fullest(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(packing.fill(sorted(counts), counts, 20)) == fullest(sizes, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_pack(sizes):
    places = packing.pack(sizes, 30)
    assert len(set(places)) == len(sizes)
    load = {}
    for (c, _), n in zip(places, sizes):
        load[c] = load.get(c, 0) + n
    assert all(v <= 30 for v in load.values()) and sum(load.values()) == sum(sizes)


def test_pack_items(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 25, 10, 0, 3, 7, 10])] + [(50, None)], "doc_id long, n int")
    rows = packing.pack_items(df, "doc_id", "n", [("s", 10), (None, 5), ("bad", 0)], block_items=4).collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {0: 5, 1: 25, 2: 10, 3: 0, 4: 3, 5: 7, 6: 10} and {r["piece_no"] for r in rows if r["doc_id"] == 1} == {0, 1, 2}


# --- mixing and residue ----------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary")
def test_mix(spark):
    rng = random.Random(1)
    words = {"a": "数据平台任务调度", "b": "report pipeline schedule metric", "c": "报表 dashboard 质量"}
    rows = [(i, " ".join(rng.choices(words[s].split() or [words[s]], k=rng.randrange(5, 30))), s if i % 17 else None) for i, s in enumerate(rng.choices("abc", [6, 3, 1], k=900))]
    df = spark.createDataFrame(rows + [(5000, None, "a"), (5001, "", "b")], "doc_id long, text string, source string")
    drawn = mixing.mix(df, "doc_id", "text", "source", {"a": (0.4, 1), "b": (0.3, 2), "c": (0.3, 3)})
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 3)], "source string, target_share double, max_repeats int")
    for r in mixing.shares(drawn, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.02 and r["most_repeats"] <= r["max_repeats"]
    assert mixing.mix(df, "doc_id", "text", "source", {}).count() == 0


def test_residue(spark):
    cases = {
        "尊敬的{{ cand.name }}：您好，附上岗位说明": "placeholder", "项目经历【请填写项目名称】": "placeholder", "用模板引擎的 {{ region }} 变量参数化脚本": None, "```\n${name}\n```\n脚本说明": None,
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit": "filler", "此处为示例文字，此处为示例文字，此处为示例文字，": "filler", "清理 Lorem 填充段落": None,
        "首页 职位 登录\n404\n抱歉，您访问的页面不存在": "error_page", "请启用 JavaScript 后继续浏览本页": "error_page", "统计 404 与 502 类错误页占比，由千分之十降到千分之一": None, "": None, " ": None,
        "熟悉 JavaScript，重写页面": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "doc_id long, text string").withColumn("extra", F.lit(1))
    rows = {r["doc_id"]: r["residue_kind"] for r in residue.with_residue_kind(df).collect()}
    assert [rows[i] for i in range(len(cases))] == list(cases.values()) and rows[99] is None


def test_error_pages_of_any_length(spark):
    trace = "Traceback (most recent call last):\n" + '  File "/srv/app/views.py", line 12, in show\n' * 40 + "KeyError: 'resume'\n请稍后重试"
    part = "HTTP 404\n抱歉，您访问的页面不存在\n"
    content = "负责数据平台的任务调度与质量监控，按时产出\n"
    cases = {
        trace: "error_page", trace[:600]: "error_page", part + content * 3: "error_page", part + content * 90: "error_page",
        "<p>HTTP 404</p>\n\n  <p>抱歉，您访问的页面不存在</p>\n" + content * 90: "error_page", "HTTP 404\n" + content * 3: None, "HTTP 404\n" + content * 90: None,
        "HTTP 404\nSorry, " + "the resource that you asked for is elsewhere " * 3 + "\n" + content * 90: "error_page", "450\n5000 万条记录\n" + content * 3: None,
        "HTTP 404\n" + content + "抱歉，您访问的页面不存在\n" + content * 90: None, content * 90: None,
    }
    assert len(trace) > 1200
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r["doc_id"]: r["residue_kind"] for r in residue.with_residue_kind(df).collect()}
    assert [rows[i] for i in range(len(cases))] == list(cases.values())


def test_placeholders_of_every_pair_and_their_discounts(spark):
    cases = {
        "尊敬的«客户姓名»：": 1, "Dear ‹First Name›,": 1, "到岗时间 #开始日期#": 1, "公司：<单位名称>": 1, "电话：%手机号码%": 1, "{order.id} 已发出": 1, "致 @收件人@": 1, "[Recipient address]": 1, "签约方__公司__": 1, "第{1}期": 1,
        "名单：$CLIENT_NAME$": 1, "{{ a.b }} 与 {{ c }}，附表": 1, "说明«姓名»\n支持 ${name} 形式的占位符": 1, "«姓名»\n" * 3 + "结论": 1,
        "熟悉 List<name> 与 Map<id>": 0, "达标率由70%提高到80%": 0, "set %JAVA_HOME%\\bin": 0, "见 [Contact](x.html)": 0, "[工作经历]": 0, "<b>职责</b>": 0, "《城市地址》": 0, r"\frac{1}{2} 与 x_{0}，\d{2}": 0, "a[3]{2}": 0,
        "标题用 %city% 与 #city# 两种写法": 0, "字段写作 `{name}` 即可": 0, "形如 <姓名> 的": 0, "能读懂 {0} 格式串": 0, "#春节快乐#": 0, "a@name.example": 0, "请补充材料": 0,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r["doc_id"]: r["residue_kind"] for r in residue.with_residue_kind(df).collect()}
    assert {t: int(rows[i] == "placeholder") for i, t in enumerate(cases)} == cases


def _periodic(text, longest=64):
    """Brute force: some unit said at least three times in a row, 20 letters or digits in all."""
    s = [c for c in text if c.isalnum()]
    runs = [(i, p) for p in range(1, longest + 1) for i in range(len(s) - p - max(20 - p, 2 * p) + 1) if all(s[i + k] == s[i + k + p] for k in range(max(20 - p, 2 * p)))]
    return any(p <= 16 or residue.ANNOUNCED.search("".join(s[i : i + 2 * p])) for i, p in runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("甲乙a1 ，\n", max_size=9) | st.sampled_from(["这里放一段今后要由别人来补的文字", "Insert your own text here please."]), st.integers(0, 12), st.text("丙x7。", max_size=60)), max_size=6))
def test_repetition_against_brute_force(parts):
    texts = [unit * n + tail for unit, n, tail in parts]
    assert residue.repeating(texts).tolist() == [_periodic(t) for t in texts]


def test_repeating_across_pieces():
    filler = "".join(chr(0x4E00 + random.Random(3).randrange(9000) + i) for i in range(15))
    texts = [chr(0x4E00 + i % 9000) * 0 + "".join(chr(0x4E00 + (i * 7919 + k * 104729) % 15000) for k in range(5000)) for i in range(20)]
    for at in range(0, 20, 3):
        texts[at] = texts[at][:1000] + filler * 3 + texts[at][1000:]
    assert residue.repeating(texts).tolist() == [i % 3 == 0 for i in range(20)]
    assert residue.repeating([]).tolist() == [] and residue.repeating(["", "a"]).tolist() == [False, False]


def test_filler_that_no_list_names(spark):
    rng = random.Random(5)
    own = ["zorbu", "fenati", "quorimo", "baldis", "trevano", "ulmiser", "kadento", "pravico"]  # invented here
    sentence = lambda words: " ".join(rng.choices(words, k=12)).capitalize() + "."
    rows = [(i, "岗位职责\n" + sentence(own + ["lorem", "ipsum", "velit"])) for i in range(40)]
    rows += [(100, "自我评价\n" + sentence(own)), (101, "摸鱼" * 15), (102, "qwer uiop " * 9), (103, "Built the reporting layer of a warehouse with Kafka and Hive"), (104, "哈哈哈哈"), (105, "Java Scala Go Rust Python Kotlin Swift")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r["doc_id"]: r["residue_kind"] for r in residue.with_residue_kind(df).collect()}
    assert all(kinds[i] == "filler" for i in range(40)) and [kinds[i] for i in range(100, 106)] == ["filler"] * 3 + [None] * 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert residue.with_residue_kind(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(0, 30))
def test_best_sum(sizes, capacity):
    counts = {s: sizes.count(s) for s in sizes if s <= capacity}
    got = mixing.best_sum(counts, capacity)
    sums = {sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r) if sum(c) <= capacity}
    assert sum(got) == max(sums) and all(got.count(s) <= counts[s] for s in got)


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary")
def test_memberships_decide_what_is_preferred(spark):
    """Records of two sources, some of which read like the other one: the fit draws those of the scarce kind more often."""
    rng = random.Random(2)
    words = {"a": "数据平台任务调度质量监控", "b": "recipe garden flower kitchen spoon"}
    say = lambda s: "".join(rng.choices(words["a"], k=40)) if s == "a" else " ".join(rng.choices(words["b"].split(), k=12))
    rows = [(i, say("b" if i % 10 == 0 else "a"), "a") for i in range(400)] + [(1000 + i, say("b"), "b") for i in range(40)] + [(2000 + i, say("ab"[i % 2]), None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("post", F.lit("extra"))
    model = mixing.classifier(df, "text", "source", ["a", "b"])
    members = {r["doc_id"]: r["post"] for r in mixing.memberships(df, "doc_id", "text", "source", ["a", "b"], model).collect()}
    assert all(0 < p < 1 for p in members[1]) and members[2000][0] > 0.5 > members[2001][0] and members[1][0] > members[0][0]  # labels are evidence, not certainty
    kept = {"a": (0.5, 1), "b": (0.5, 4)}
    posts = mixing.memberships(df, "doc_id", "text", "source", ["a", "b"], model)
    summed, total = mixing.fit_rates(posts, kept)
    assert summed[0] > summed[1]  # what reads like the plentiful kind is drawn less
    drawn = mixing.draw(posts, "doc_id", "source", kept, summed, None)
    share = {r["domain"]: r["t"] for r in drawn.groupBy("domain").agg(F.sum("n_tokens").alias("t")).collect()}
    assert abs(share["a"] / sum(share.values()) - 0.5) < 0.01
    assert drawn.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4


def test_information_decides_and_mappings_stay_inside_runs(spark):
    """A pair's score follows its mutual information; letters with accents are trusted where they stand among plain letters."""
    words = ["déjà vu", "le café noir", "une idée simple", "très bien réussi", "la forêt dorée"]
    french = [("text", i, ", ".join(random.Random(i).sample(words, 4)) + "\n" + random.Random(i).choice(LINES)) for i in range(200)]
    df = spark.createDataFrame(french + [("text", 900, "le café noir".encode().decode("cp1252") + "\n" + LINES[0]), ("text", 901, "Греция и Ελλάδα")], TEXT)
    score, trusted = mojibake.fit(df)
    assert all(trusted[ord(c)] for c in "éàè") and not trusted[ord("Ã")] and not trusted[ord("Г")]
    assert len(set(score.tolist())) > 4 and score.min() >= mojibake.USUAL and score.max() <= mojibake.RARE
    rows = {r["doc_id"]: r["restored"] for r in mojibake.restore(df, "doc_id", "text", (score, trusted), ["field_name"]).collect()}
    assert set(rows) == {900} and rows[900].startswith("le café noir")


def test_confusions_that_no_list_names_are_learned(spark):
    assert ("敉", "数") not in scan_noise.KNOWN
    lines = ["负责数据平台的任务调度", "使用数字看板展示指标", "整理参数规范并培训新人", "统一计数方法后上线"]
    plain = [("text", i, "\n".join(lines) + "\n翎字旁注") for i in range(120)]
    pages = [("text", 500 + k, "\n".join(lines[:k] + [lines[k].replace("数", "敉")] + lines[k + 1 :]) + "\n- 1 -\n- 2 -") for k in range(4)]
    df = spark.createDataFrame(plain + pages + [("text", 900, None), ("text", 901, "")], TEXT)
    units = scan_noise.count_units(df, "text")
    assert {(r["wrong"], r["right"]) for r in scan_noise.learn_confusions(units, 0.04).collect()} == {("敉", "数")}
    rows = {(r["doc_id"], r["line_no"]) for r in scan_noise.find(df, "doc_id", "text", ["field_name"], scan_noise.fit(df, "text")).where("noise_kind = 'misread'").collect()}
    assert rows == {(500 + k, k) for k in range(4)}
    empty = spark.createDataFrame([], TEXT)
    assert scan_noise.find(empty, "doc_id", "text", ["field_name"], scan_noise.fit(empty, "text")).count() == 0
