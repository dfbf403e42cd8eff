"""Freely typed values mapped to the closest entry of a reference list.

Values are reduced to their distinct cores; the cores are looked up in a BK-tree over the entries
and their short forms under the unrestricted Damerau-Levenshtein distance, which is a metric, so
that the triangle inequality prunes branches and every entry within the threshold is found. A list
of bounded size makes one tree, sent to all tasks; a longer one is divided into shards, each with
its own tree. Winners are found in two steps, first for whole values, then, for values that have no
close one, for their beginnings; both steps take the least over all shards, so that the answers do not
depend on the division. A core whose best distance is shared by two entries has no meaning that could
be told and is reported as unmatched (0).

Short forms of entries come from the list itself (endings that several entries share), words behind
an entry that belong to no name (subjects and the like) from the values (``learn_tails``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk.session import durable

#: Entries up to which one tree is sent to all tasks.
ONE_TREE = 20_000

# Traditional characters, each before its simplified form.
TRADITIONAL = (
    "數数 據据 開开 發发 倉仓 庫库 師师 業业 機机 學学 習习 薦荐 語语 識识 別别 處处 覺觉 視视 計计 實实 時时 網网 絡络 滲渗 測测 試试 顧顾 問问 雲云 構构 "
    "決决 術术 項项 經经 專专 員员 戶户 設设 體体 驗验 長长 內内 編编 輯辑 電电 應应 鏈链 劃划 購购 尋寻 財财 務务 會会 審审 風风 險险 貸贷 稅税 籌筹 夥伙 "
    "績绩 訓训 講讲 規规 產产 權权 銷销 氣气 製制 結结 藝艺 頻频 證证 圖图 臨临 遊游 戲戏 動动 軟软 質质 護护 維维 運运 營营 優优 區区 資资 線线 農农 範范 "
    "職职 聯联 關关 澗涧 單单 達达 進进 遠远 團团 隊队 級级 歷历 門门 間间 陽阳 陸陆 馬马 鳥鸟 魚鱼 龍龙 總总 調调 導导 島岛 橋桥 "
)
LEVELS = "高级|资深|初级|中级|实习|急聘|助理|见习|Senior|Junior|Intern(?!al)"
DEGREES = "本科|硕士|博士|大专|专科|研究生|学士|中专"
#: A tail is learned from at least so many values with different entries, and from this share of all distinct values, so that at most
#: a thousand tails are learned from any number of values.
TAIL_ENTRIES, TAIL_SHARE = 3, 0.001
#: Endings of this share of the entries (so of bounded number) count as misspelt if a tail differs from them by one edit.
ENDING_SHARE = 0.005
#: Edits beyond which no entry is taken.
MOST_EDITS = 3


def _simplify() -> dict[int, str]:
    return {ord(pair[0]): pair[1] for pair in TRADITIONAL.split()}


def distances(a: str, b: str) -> list[int]:
    """Unrestricted Damerau-Levenshtein distances (a metric) of ``b`` from every beginning of ``a``, the empty one first."""
    n, m = len(a), len(b)
    big = n + m
    last: dict[str, int] = {}
    d = [[big] * (m + 2) for _ in range(n + 2)]
    d[1][1:] = range(m + 1)
    for i in range(1, n + 1):
        match, row, above, ca = 0, d[i + 1], d[i], a[i - 1]
        row[1] = i
        for j in range(1, m + 1):
            cb = b[j - 1]
            best = above[j] + (ca != cb)
            if row[j] < best:
                best = row[j] + 1
            if above[j + 1] < best:
                best = above[j + 1] + 1
            if match and (k := last.get(cb, 0)) and (moved := d[k][match] + i - k + j - match - 1) < best:
                best = moved
            row[j + 1] = best
            if ca == cb:
                match = j
        last[ca] = i
    return [row[m + 1] for row in d[1:]]


def distance(a: str, b: str) -> int:
    return 0 if a == b else distances(a, b)[-1]


@dataclass
class Node:
    term: str
    ids: set[int]
    children: dict[int, Node] = field(default_factory=dict)


class BKTree:
    """Entries by their distances from each other."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.root: Node | None = None
        self.exact: dict[str, set[int]] = {}
        for term, ref_id in entries:
            self._add(term, ref_id)

    def _add(self, term: str, ref_id: int) -> None:
        self.exact.setdefault(term, set()).add(ref_id)
        if self.root is None:
            self.root = Node(term, {ref_id})
            return
        node = self.root
        while (d := distance(term, node.term)) != 0:
            if d not in node.children:
                node.children[d] = Node(term, {ref_id})
                return
            node = node.children[d]
        node.ids.add(ref_id)

    def within(self, query: str, threshold: int) -> list[tuple[int, str, set[int]]]:
        """Every entry no farther than ``threshold``."""
        return [(d, term, ids) for d, _, term, ids in self.beginnings_within(query, threshold, range(len(query), len(query) + 1))]

    def beginnings_within(self, query: str, threshold: int, sizes: range) -> list[tuple[int, int, str, set[int]]]:
        """(distance, size, term, ids) of every entry no farther than ``threshold`` from the query's beginnings of these sizes; one walk serves them all."""
        found, stack = [], [self.root] if self.root and len(sizes) else []
        while stack:
            node = stack.pop()
            d = distances(query, node.term)
            found += [(d[n], n, node.term, node.ids) for n in sizes if d[n] <= threshold]
            near = {k for n in sizes for k in range(d[n] - threshold, d[n] + threshold + 1)}
            stack += [c for k, c in node.children.items() if k in near]
        return found


def threshold_of(term: str) -> int:
    """Edits allowed for an entry of this length: one in three characters, three at most."""
    return min(3, max(0, (len(term) - 1) // 2 if len(term) <= 4 else len(term) // 3 + (len(term) == 5)))


Winner = tuple[int, int, list[int]]  # distance, size of the beginning, entries
NONE: Winner = (99, 0, [])


def _least(query: str, hits: list[tuple[int, int, str, set[int]]]) -> Winner:
    near = [(d, -n, ids) for d, n, term, ids in hits if d <= min(threshold_of(term), threshold_of(query[:n]))]
    if not near:
        return NONE
    d, n = min((d, n) for d, n, _ in near)
    return d, -n, sorted(set().union(*(ids for x, y, ids in near if (x, y) == (d, n))))


def whole(tree: BKTree, query: str) -> Winner:
    if query in tree.exact:
        return 0, len(query), sorted(tree.exact[query])
    return _least(query, [(d, len(query), term, ids) for d, term, ids in tree.within(query, MOST_EDITS)])


def unsettled(query: str, found: Winner) -> bool:
    """Whether beginnings are looked at: the whole value has no close entry, or several."""
    return len(query) > 4 and (found[0] > 1 or len(found[2]) != 1)


def beginnings(tree: BKTree, query: str, longest: int) -> Winner:
    """The closest entries of the query's beginnings, of equally close ones those of the longest; none needs to be longer than the longest entry and the edits."""
    return _least(query, tree.beginnings_within(query, MOST_EDITS, range(3, min(len(query) - 1, longest + MOST_EDITS) + 1)))


def best(tree: BKTree, query: str, prefixes: bool, longest: int) -> tuple[int, list[int]]:
    """(distance, ids) of the closest entries; with ``prefixes`` also of the query's beginnings where they are closer than the whole."""
    found = whole(tree, query)
    if prefixes and unsettled(query, found):
        found = min(found, beginnings(tree, query, longest), key=lambda w: w[0])
    return found[0], found[2]


def core_of_title(value: str) -> str:
    """A position without level, pay, place, start and inserted signs, in simplified characters."""
    v = narrow_all(value).translate(_SIMPLE)
    v = re.sub(r"^[^:：]{1,6}[:：]", "", v)
    v = re.sub(r"[\s·・•]", "", v) if not v.isascii() else v
    v = re.sub(r"[|/｜(（].*$|\d+(?:\.\d+)?[kK万千]?[-~–]\d+(?:\.\d+)?[kK万千].*$", "", v)
    if not v.isascii():
        v = re.sub(r"-[一-龥]{2,3}$", "", v)
    v = re.sub(rf"^(?:{LEVELS})\s*(?=.)", "", v)
    v = re.sub("岗位?$", "", v)
    return re.sub(r"[^A-Za-z]", "", v).lower() if v.isascii() else re.sub("[A-Za-z]+", lambda m: m[0].lower(), v)


def core_of_school(value: str) -> str:
    """A school without dates, degree and branch, in simplified characters."""
    v = narrow_all(value).translate(_SIMPLE)
    v = re.sub(r"[(（][^)）]*[)）]?", "", v)
    v = re.sub(rf"^(?:\d+[年月]?|[./~至 –—-]|(?:{DEGREES})[·・])+", "", v)
    v = re.sub(rf"(?:{DEGREES}|统招|\s)+$", "", v)
    return re.sub(r"[\s·・]|-.*$|继续教育(?:学院|部)$", "", v)


def narrow_all(s: str) -> str:
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" and c not in "（），：；｜" else " " if c == "　" else c for c in s)


_SIMPLE = _simplify()


def _mapped(df: DataFrame, column: str, core_of: Callable[[str], str]) -> DataFrame:
    """The rows with ``core`` in place of ``column``, by Arrow batches."""
    kept = [c for c in df.columns if c != column]
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in kept), "core string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[kept].assign(core=[core_of(v) for v in f[column]])

    return df.select(*kept, column).mapInPandas(run, schema)


def title_entries(titles: DataFrame, ref_id: str, title: str, english: str) -> DataFrame:
    """(term, ref_id): the titles, their short forms without an ending that several titles share, their English letters.

    An ending counts if two titles have it and no longer ending is as frequent; at least two characters must be left.
    """
    cores = _mapped(titles.select(F.col(ref_id).cast("int").alias("ref_id"), F.col(title).alias("_t")).where("_t IS NOT NULL"), "_t", core_of_title).distinct()
    cut = cores.select("ref_id", "core", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).where("length(core) > k + 1").select(
        "ref_id", "core", F.expr("right(core, k)").alias("ending"), F.expr("left(core, length(core) - k)").alias("term"))
    ends = cut.groupBy("ending").agg(F.countDistinct("core").alias("n")).where("n > 1")
    longer = ends.where("length(ending) > 1").select(F.expr("substring(ending, 2)").alias("ending"), F.col("n").alias("m")).groupBy("ending").agg(F.max("m").alias("m"))
    shared = ends.join(longer, "ending", "left").where("m IS NULL OR m < n").where("length(ending) < 5").select("ending")
    short = cut.join(shared, "ending").select("term", "ref_id")
    letters = titles.select(F.lower(F.regexp_replace(english, "[^A-Za-z]", "")).alias("term"), F.col(ref_id).cast("int").alias("ref_id"))
    return cores.select(F.col("core").alias("term"), "ref_id").unionByName(short).unionByName(letters).where("term <> ''").distinct()


def school_entries(schools: DataFrame, ref_id: str, names: list[str]) -> DataFrame:
    """(term, ref_id) of all names of the schools, in simplified characters."""
    named = schools.select(F.col(ref_id).cast("int").alias("ref_id"), F.explode(F.array(*names)).alias("_n")).where("_n IS NOT NULL")
    return _mapped(named, "_n", lambda n: n.translate(_SIMPLE)).select(F.col("core").alias("term"), "ref_id").where("term <> ''").distinct()


def learn_tails(cores: DataFrame, entries: DataFrame) -> list[str]:
    """What follows whole entries in values with enough different entries, the longest first: subjects and the like.

    A value's head is the longest entry it begins with, found by an equi-join for each length an entry has; what
    entries themselves end with is no tail. ``TAIL_SHARE`` bounds the number of tails.
    """
    sizes = [r[0] for r in entries.select(F.length("term").alias("n")).distinct().where("n >= 2").collect()]
    n_values = cores.count()
    if not sizes or not n_values:
        return []
    cut = cores.select("core", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("k")).where("length(core) >= k").withColumn("term", F.expr("left(core, k)"))
    heads = cut.join(entries, "term").groupBy("core").agg(F.max(F.struct("k", "term", "ref_id")).alias("h")).select(
        F.expr("substring(core, h.k + 1)").alias("tail"), "h.term", "h.ref_id")
    known = heads.where(F.length("tail") > 1).groupBy("tail").agg(F.countDistinct("ref_id").alias("n_entries"), F.countDistinct("term").alias("n"))
    ends = entries.select(F.explode(F.sequence(F.lit(2), F.lit(max(sizes)))).alias("k"), "term").where("length(term) > k").select(F.expr("right(term, k)").alias("tail"))
    rows = known.where((F.col("n_entries") >= TAIL_ENTRIES) & (F.col("n") >= TAIL_SHARE * n_values)).join(ends.select("tail").distinct(), "tail", "left_anti").select("tail").collect()
    common = ends.groupBy("tail").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") >= ENDING_SHARE * entries.count())).select("tail").collect()
    tails = {r[0] for r in rows if all(distance(r[0], e[0]) > 1 for e in common)}  # no misspelt ending of an entry
    return sorted((t for t in tails if not any(t[k:] in tails for k in range(1, len(t)))), key=lambda t: (-len(t), t))


def without_tail(core: str, tails: dict[int, set[str]]) -> str:
    """The core without the longest tail it ends with, unless nothing of it would be left."""
    for n in sorted(tails, reverse=True):
        if len(core) > n and core[-n:] in tails[n]:
            return core[:-n]
    return core


def _matches(cores: pd.Series, got: list[Winner]) -> pd.DataFrame:
    # lists stay objects in a frame without rows, too
    numbers = {c: pd.Series([g[i] for g in got], dtype="int32") for i, c in enumerate(("d", "n"))}
    return pd.DataFrame({"core": cores.reset_index(drop=True), **numbers, "ids": pd.Series([g[2] for g in got], dtype=object)})


SCHEMA = "core string, d int, n int, ids array<int>"


def _over_shards(cores: DataFrame, entries: DataFrame, shards: int, look: Callable[[BKTree, str], Winner]) -> DataFrame:
    """The least winner of each core over the trees of all shards: every core goes to every shard, in as many parts as there are cores of the cluster."""
    parts = max(1, cores.sparkSession.sparkContext.defaultParallelism)
    left = cores.select("core", F.pmod(F.xxhash64("core"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = entries.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def shard(queries: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        tree = BKTree(sorted(zip(listed["term"], listed["ref_id"].astype(int))))
        return _matches(queries["core"], [look(tree, c) for c in queries["core"]])

    found = left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInPandas(shard, SCHEMA)
    rank = F.struct("d", -F.col("n"))  # the closest, then the longest beginning
    least = found.withColumn("_r", rank).withColumn("_low", F.min(rank).over(Window.partitionBy("core"))).where("_r = _low")
    return least.groupBy("core").agg(F.first("d").alias("d"), F.first("n").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # at most one row per shard and core


def match_cores(cores: DataFrame, entries: DataFrame, prefixes: bool, one_tree: int = ONE_TREE, shards: int | None = None) -> DataFrame:
    """(core, ref_id) for distinct ``core``s; ``entries`` has (term, ref_id). 0 where no entry is the one meant.

    More than ``one_tree`` entries are divided into shards of about half that size; the answers are the same.
    """
    size = entries.agg(F.count("*"), F.max(F.length("term"))).first()
    n_entries, longest = size[0], size[1] or 0
    spread = cores.repartition(2 * cores.sparkSession.sparkContext.defaultParallelism)  # looking up costs far more than moving
    if n_entries <= one_tree:
        pairs = sorted((r["term"], r["ref_id"]) for r in entries.collect())

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = BKTree(pairs)
            for f in frames:
                yield _matches(f["core"], [(d, 0, ids) for d, ids in (best(tree, c, prefixes, longest) for c in f["core"])])

        winners = spread.mapInPandas(run, SCHEMA)
    else:
        shards = shards or -(-2 * n_entries // one_tree)
        winners = _over_shards(cores, entries, shards, whole)
        if prefixes:
            open_ = (F.length("core") > 4) & ((F.col("d") > 1) | (F.size("ids") != 1))
            first = durable(winners)
            begun = _over_shards(first.where(open_).select("core"), entries, shards, lambda tree, c: beginnings(tree, c, longest))
            both = first.select("core", F.struct("d", "ids").alias("a")).join(begun.select("core", F.struct("d", "ids").alias("b")), "core", "left")
            closer = F.col("b.d") < F.col("a.d")
            winners = both.select("core", F.when(closer, F.col("b.ids")).otherwise(F.col("a.ids")).alias("ids"))
    return winners.select("core", F.when(F.size("ids") == 1, F.col("ids")[0]).otherwise(0).alias("ref_id"))


def map_values(values: DataFrame, value: str, entries: DataFrame, core_of: Callable[[str], str], prefixes: bool = False) -> DataFrame:
    """Add ``ref_id`` to the rows with a non-blank ``value``; rows with null, empty and blank values are left out.

    Distinct values are pre-aggregated before they are looked up, so that a value that a third of
    all rows share costs one lookup; the result is joined back, skew being AQE's to split. With
    ``prefixes``, tails that follow entries in many values are learned and taken off first.
    """
    typed = values.where(F.col(value).rlike(r"[^\s　]"))
    distinct = typed.select(F.col(value).alias("_value"), F.col(value).alias("_v")).distinct()
    cored = _mapped(distinct, "_v", core_of)
    if prefixes:
        cored = durable(cored)
        by_size: dict[int, set[str]] = {}
        for t in learn_tails(cored.select("core").distinct(), entries):
            by_size.setdefault(len(t), set()).add(t)
        cored = _mapped(cored.withColumnRenamed("core", "_c"), "_c", lambda c: core_of(without_tail(c, by_size)))
    matched = match_cores(cored.select("core").distinct(), entries, prefixes)
    lookup = cored.join(matched, "core").select("_value", "ref_id")
    return typed.join(lookup, typed[value] == lookup["_value"]).drop("_value")
