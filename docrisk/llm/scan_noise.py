"""Noise in text from scanned pages: words cut by hyphens, misrecognised characters, page furniture.

(1) One pass over the whole corpus counts, apart for texts with and without traces of pages
(wrapped lines, page numbers), the words, all windows of three characters around a Chinese one,
hyphenated and cut words, and the edge lines of pages.
(2) Which characters scanning confuses is learned: a window that comes with traces of pages only, in
a context whose usual character is another one, is evidence for that pair, and pairs with evidence from
enough different contexts are kept beside a list of known ones (``learn_confusions``). Every unit has an
anagram hash (the sum of its characters' fifth powers). A confusion changes it by a fixed difference, so
that an equi-join in SQL on hash plus difference brings together rare units with their frequent variants.
The ranked best variant is a correction if it is many times as frequent and the unit is not just as usual
in texts without traces of pages (where it would be the author's own).
(3) A cut word is one whose joined form has more evidence than its hyphenated form.
(4) Lines whose form stands at page edges across the corpus are furniture. (5) A second pass applies
all this to every line; ``repair`` also joins the lines to paragraphs.

Null and empty texts give no rows; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm import codepoints as cp
from docrisk.llm import layout
from docrisk.session import durable

# Characters (right form, then the forms that scanning makes of it).
CONFUSIONS = (
    "理埋 程桯 目日 务夯 责贵 司可 本木 公么 次欠 标际 据椐 成戍 台合 师帅 表衷 方万 时吋 测侧 个亇 统纨 间问 并井 建律 大太犬 主王 集隼 由甶 发友 用甩 千干 期朋 任仟 作怍 脚胸 库厍 管菅营 日曰 产严 部郜 析忻柝 名各 件仵 "
    "量童 推椎 参叁 检捡 线绒钱 定疋 负贞 人入 输榆 户卢尸 报扱 末未"
)
LETTER_CONFUSIONS = (("e", "c"), ("o", "0"), ("O", "0"), ("i", "!"), ("l", "1"), ("I", "1"), ("S", "5"), ("cl", "d"), ("m", "rn"))
PAGE_NUMBER = re.compile(r"\s*(?:[-—–·~] ?\d{1,3} ?[-—–·~]|第 ?\d{1,3} ?页(?:[ ,，/]*共 ?\d{1,3} ?页)?|[Pp]age \d{1,3}(?: of \d{1,3})?|\d{1,3} / \d{1,3}|P\.? ?\d{1,3})\s*")
TRAILING_NUMBER = re.compile(r"\s{2,}\d{1,3}\s*$")
MODULUS = (1 << 61) - 1

KNOWN = [(w, group[0]) for group in CONFUSIONS.split() for w in group[1:]]
#: A pair of characters is learned from so many different contexts, and from this share of the windows of scanned texts,
#: so that at most 1 / LEARNED_SHARE pairs are learned from any number of texts; and if it explains this share of the wrong character's evidence.
LEARNED_CONTEXTS, LEARNED_SHARE, LEARNED_PART = 3, 1e-6, 0.2
WORD = re.compile(r"(?<![A-Za-z0-9!@._-])[A-Za-z0-9][A-Za-z0-9!]{2,19}(?![A-Za-z0-9!@])|(?<![A-Za-z0-9@._-])[A-Za-z!][A-Za-z0-9!]{2,19}(?![A-Za-z0-9!@])")
SUSPECT_WORD = re.compile("[cd015!]|rn")
HYPHENED = re.compile(r"(?<![A-Za-z])([A-Za-z]+)-(?=([A-Za-z]+))")
DIGIT, LETTER = re.compile("[0-8]"), re.compile("[A-Za-z]")

#: A variant must be so many times as frequent: windows of three, of two, words.
RATIO = {"3": 6.0, "L": 25.0, "R": 25.0, "W": 8.0}
FLUSH = 400_000  # distinct units that a task holds before it passes its partial counts on


def anagram(unit: str) -> int:
    return sum(pow(ord(c), 5, MODULUS) for c in unit) % MODULUS


def masked(s: str) -> str:
    return LETTER.sub("A", DIGIT.sub("9", s))


def edge_form(line: str) -> str:
    """What a header or footer keeps from page to page and document to document: its last characters, numbers and letters masked."""
    s = TRAILING_NUMBER.sub("", line.strip())
    return re.sub("[A-Z]", "A", re.sub(r"\d+", "9", s))[-7:]


class Page:
    """A text's lines with their parts: furniture, wrapped ends, the joined text and where its characters come from."""

    def __init__(self, text: str, edges: frozenset[str] = frozenset()):
        self.lines = lines = text.split("\n")
        self.width, ends = layout.wrapped(lines)
        numbers = [PAGE_NUMBER.fullmatch(x) is not None for x in lines]
        forms = Counter(edge_form(x) for x in lines if 4 <= len(x.strip()) <= 40)
        self.furniture = list(numbers)
        expected = 1
        for i, x in enumerate(lines):
            s = x.strip()
            if s.isascii() and s.isdigit() and len(s) <= 3:
                if int(s) == expected:
                    self.furniture[i] = True
                    expected += 1
            elif edges and 4 <= len(s) <= 40 and edge_form(x) in edges:
                self.furniture[i] = True
        self.numbered = any(numbers) or expected > 2
        self.forms = forms
        self.scanned = self.width > 0 or self.numbered or any(f and not n for f, n in zip(self.furniture, numbers))
        kept = [i for i, f in enumerate(self.furniture) if not f and lines[i] != ""]
        self.cuts: list[tuple[int, str, str]] = []  # line, word before the hyphen, word after it
        pieces: list[str] = []
        self.starts: list[int] = []
        self.rows: list[int] = []
        at = 0
        for k, i in enumerate(kept):
            line = lines[i]
            nxt = lines[kept[k + 1]] if k + 1 < len(kept) else ""
            self.starts.append(at)
            self.rows.append(i)
            joined = bool(nxt) and (ends[i] or self.width and i + 1 < len(lines) and self.furniture[i + 1] and len(line) >= self.width - 8)
            if len(line) > 1 and line[-1] == "-" and line[-2].isascii() and line[-2].isalpha() and nxt and nxt[0].isascii() and nxt[0].isalpha():
                before = re.search(r"[A-Za-z]+$", line[:-1])
                after = re.match(r"[A-Za-z]+", nxt)
                assert before and after
                self.cuts.append((i, before[0], after[0]))
                line, joined = line + "\n", True
            elif not joined:
                line += "\n"
            pieces.append(line)
            at += len(line)
        self.flat = "".join(pieces)

    def row(self, at: int) -> int:
        """The line that a character of the joined text stands in."""
        return self.rows[bisect_right(self.starts, at) - 1]


def _count(page: Page, c: Counter[str]) -> None:
    for w in WORD.findall(page.flat):
        if sum(map(str.isalpha, w)) >= 2:
            c["W" + w] += 1
    for a, b in HYPHENED.findall(page.flat):
        c[f"Y{a}-{b}"] += 1
    for _, a, b in page.cuts:
        c[f"H{a}-{b}"] += 1


@lru_cache(1)
def _mask() -> np.ndarray:
    """Digits (but 9) and letters of ASCII as one digit and one letter, other code points as they are."""
    table = np.arange(0x110000, dtype=np.int64)
    table[48:57], table[65:91], table[97:123] = 57, 65, 65
    return table


def window_counts(flats: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of three characters around a Chinese one, packed into 63 bits, and their counts; within one text each."""
    codes = _mask()[cp.code_points(flats)]
    before, center, after = codes[:-2], codes[1:-1], codes[2:]
    ok = (center >= 0x4E00) & (center <= 0x9FFF) & (before != cp.BREAK) & (after != cp.BREAK)
    return np.unique(before[ok] << 42 | center[ok] << 21 | after[ok], return_counts=True)


def _windows(packed: np.ndarray) -> list[str]:
    three = np.column_stack([packed >> 42, packed >> 21 & 0x1FFFFF, packed & 0x1FFFFF]).astype("<u4")
    text = three.tobytes().decode("utf-32-le", "surrogatepass")
    return ["3" + text[i : i + 3] for i in range(0, len(text), 3)]


def count_units(texts: DataFrame, text: str) -> DataFrame:
    """(unit, n_plain, n_scan) over all texts; a unit's first character is its kind. Each task pre-aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            units = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(units, pa.string()), *(pa.array([c[u] for u in units], pa.int64()) for c in counts)], ["unit", "n_plain", "n_scan"]
            )
            for c in counts:
                c.clear()
            return out

        def windows(flats: list[str], scanned: bool) -> pa.RecordBatch:
            packed, n = window_counts(flats)
            none = pa.array(np.zeros(len(n), np.int64))
            both = [none, pa.array(n.astype(np.int64))] if scanned else [pa.array(n.astype(np.int64)), none]
            return pa.RecordBatch.from_arrays([pa.array(_windows(packed), pa.string()), *both], ["unit", "n_plain", "n_scan"])

        waiting: tuple[list[str], list[str]] = ([], [])
        held = [0, 0]
        for batch in batches:
            for t in batch.column(0).to_pylist():
                page = Page(t)
                c = counts[page.scanned]
                waiting[page.scanned].append("\n" + page.flat.replace(chr(cp.BREAK), " "))
                held[page.scanned] += len(page.flat)
                if held[page.scanned] > FLUSH * 10:
                    yield windows(waiting[page.scanned], page.scanned)
                    waiting[page.scanned].clear()
                    held[page.scanned] = 0
                _count(page, c)
                c["#texts"] += 1
                filled = [x for x in page.lines if x.strip()]
                edge = {edge_form(x) for x in filled[:1] + filled[-1:] if 4 <= len(x.strip()) <= 40}
                for f in edge:
                    c["E" + f] += 1
                for f, n in page.forms.items():
                    c["D" + f] += 1
                    if n > 1:
                        c["F" + f] += 1
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield flush()
        for scanned in (False, True):
            if waiting[scanned]:
                yield windows(waiting[scanned], scanned)
        yield flush()

    partial = texts.where(F.length(text) > 0).select(text).mapInArrow(run, "unit string, n_plain long, n_scan long")
    return partial.groupBy("unit").agg(F.sum("n_plain").alias("n_plain"), F.sum("n_scan").alias("n_scan"))


def edge_forms(units: DataFrame, least_share: float = 0.0002, edge_share: float = 0.5, again_share: float = 0.02) -> frozenset[str]:
    """Forms that mostly stand at the edge of texts and come again within some: running headers and footers.

    Of the texts with the form, at least ``edge_share`` have it in their first or last line and
    ``again_share`` have it more than once. Only forms at the edge of ``least_share`` of all texts
    count, so that there are at most 2 / least_share of them.
    """
    n = units.where("unit = '#texts'").select(F.col("n_plain") + F.col("n_scan")).first()
    least = max(2.0, least_share * (n[0] if n else 0))
    by = units.where("unit RLIKE '^[DEF]'").select(F.substring("unit", 1, 1).alias("k"), F.expr("substring(unit, 2)").alias("form"), (F.col("n_plain") + F.col("n_scan")).alias("n"))
    counts = by.groupBy("form").pivot("k", ["D", "E", "F"]).agg(F.sum("n")).na.fill(0)
    kept = counts.where((F.col("E") >= least) & (F.col("E") >= edge_share * F.col("D")) & (F.col("F") >= 2) & (F.col("F") >= again_share * F.col("D")))
    return frozenset(r["form"] for r in kept.select("form").collect())


def learn_confusions(units: DataFrame, scale: float) -> DataFrame:
    """(wrong, right, contexts): pairs of characters that scanning confuses, by what the corpus shows.

    In every context (the characters before and after) the most frequent character is the usual one; a window
    with another character that is far rarer, and that comes in scanned texts out of proportion, is evidence for
    (this character, the usual one), if this character as a whole is out of proportion there. One aggregation and one equi-join by context; no pairs are formed within one.
    """
    w = F.expr("substring(unit, 2)")
    n = F.col("n_plain") + F.col("n_scan")
    three = units.where("unit LIKE '3%'").select(F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1)).alias("context"), F.substring(w, 2, 1).alias("c"), "n_plain", "n_scan", n.alias("n"))
    usual = three.groupBy("context").agg(F.max(F.struct("n", "c")).alias("top")).select("context", F.col("top.c").alias("right"), F.col("top.n").alias("n_right"))
    # the wrong character itself comes with traces of pages, too: a name's or an author's character comes without them as well
    of_pages = three.groupBy("c").agg(F.sum("n_plain").alias("p"), F.sum("n_scan").alias("s")).where(F.col("p") * F.lit(float(scale)) * 4 < F.col("s")).select("c")
    odd = three.join(of_pages, "c").where((F.col("n_scan") > 0) & (F.col("n_plain") * F.lit(float(scale)) * 4 < F.col("n_scan")))
    pairs = odd.join(usual, "context").where((F.col("c") != F.col("right")) & (F.col("n_right") >= RATIO["3"] * F.col("n")))
    evidence = pairs.groupBy(F.col("c").alias("wrong"), "right").agg(F.countDistinct("context").alias("contexts"))
    whole = evidence.groupBy("wrong").agg(F.sum("contexts").alias("all"))
    least = LEARNED_SHARE * (three.agg(F.sum("n_scan").alias("n")).first()["n"] or 0)
    kept = (F.col("contexts") >= LEARNED_CONTEXTS) & (F.col("contexts") >= least) & (F.col("contexts") >= LEARNED_PART * F.col("all"))
    return evidence.join(whole, "wrong").where(kept).select("wrong", "right", "contexts")


def _differences(spark, learned: list[tuple[str, str]]) -> DataFrame:
    """The confusions with their hash differences (from the form read to the right form)."""
    rows = [(w, r, (anagram(r) - anagram(w)) % MODULUS, True) for w, r in sorted({*KNOWN, *learned})]
    rows += [(w, r, (anagram(r) - anagram(w)) % MODULUS, False) for r, w in LETTER_CONFUSIONS]
    return spark.createDataFrame(rows, "wrong string, right string, difference long, wide boolean")


def corrections(units: DataFrame) -> DataFrame:
    """(unit, right_unit, right, wrong, strict): of every unit that is a misreading, the best-ranked variant.

    ``strict``: the unit hardly comes without traces of pages, so that it counts even there.
    Windows of two are added up from the windows of three. Join and ranking are SQL; the join's key is the
    anagram hash, which no single value dominates.
    """
    spark = units.sparkSession
    three = units.where("unit LIKE '3%'").select(F.expr("substring(unit, 2)").alias("w"), "n_plain", "n_scan")
    two = (
        three.select(F.explode(F.array(F.struct(F.lit("L").alias("k"), F.expr("substring(w, 1, 2)").alias("w")), F.struct(F.lit("R").alias("k"), F.expr("substring(w, 2, 2)").alias("w")))).alias("x"), "n_plain", "n_scan")
        .groupBy(F.concat("x.k", "x.w").alias("unit")).agg(F.sum("n_plain").alias("n_plain"), F.sum("n_scan").alias("n_scan"))
    )
    every = units.where("unit RLIKE '^[3W]'").unionByName(two)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict[str, int] = {}
        for batch in batches:
            out = []
            for u in batch.column(0).to_pylist():
                h = 0
                for ch in u[1:]:
                    p = powers.get(ch)
                    if p is None:
                        p = powers[ch] = pow(ord(ch), 5, MODULUS)
                    h += p
                out.append(h % MODULUS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["unit", "n_plain", "n_scan", "hash"])

    table = durable(every.mapInArrow(hashed, "unit string, n_plain long, n_scan long, hash long"))
    scale = table.where("unit LIKE '3%'").agg((F.sum("n_scan") / F.greatest(F.sum("n_plain"), F.lit(1))).alias("s")).first()["s"] or 0.0
    learned = [(r["wrong"], r["right"]) for r in learn_confusions(table, scale).collect()]  # bounded by LEARNED_SHARE
    u, kind = F.col("unit"), F.substring("unit", 1, 1)
    center = F.when(kind == "R", F.substring(u, 2, 1)).otherwise(F.substring(u, 3, 1))
    differences = F.broadcast(_differences(spark, learned))
    letters = F.array(*[F.lit(w) for w in sorted({w for _, w in LETTER_CONFUSIONS})])
    read = (
        table.where("n_scan > 0").withColumn("kind", kind)
        .withColumn("wrong", F.explode(F.when(F.col("kind") == "W", F.filter(letters, lambda w: F.instr(u, w) > 0)).otherwise(F.array(center))))
        .withColumn("wide", F.col("kind") != "W")
        .join(differences, ["wrong", "wide"])
        .withColumn("target", F.pmod(F.col("hash") + F.col("difference"), F.lit(MODULUS)))
    )
    right = table.select(F.col("unit").alias("right_unit"), F.col("hash").alias("target"), F.substring("unit", 1, 1).alias("kind"), (F.col("n_plain") + F.col("n_scan")).alias("n_right"))
    place = F.when(F.col("kind") == "R", 2).otherwise(3)
    exact = F.when(F.col("wide"), F.col("right_unit") == F.overlay(u, F.col("right"), place, F.lit(1))).otherwise(
        F.expr("exists(sequence(2, length(unit)), i -> substring(unit, i, length(wrong)) = wrong AND right_unit = overlay(unit PLACING right FROM i FOR length(wrong)))")
    )
    n_read = F.col("n_plain") + F.col("n_scan")
    ratio = F.create_map(*[F.lit(x) for kv in RATIO.items() for x in kv])[F.col("kind")]
    joined = read.join(right, ["target", "kind"]).where(exact & (F.col("n_right") >= ratio * n_read)).withColumn("strict", F.col("n_plain") * F.lit(float(scale)) * 8 < F.col("n_scan"))
    # of the occurrences in scanned texts, fewer than half would be there if scanning did nothing
    own = F.col("n_plain") * F.lit(float(scale)) * 2 < F.col("n_scan")
    return (
        joined.where(own).groupBy("unit").agg(F.max_by(F.struct("right_unit", "right", "wrong", "strict"), F.struct("n_right", "right_unit")).alias("b"))
        .select("unit", "b.right_unit", "b.right", "b.wrong", "b.strict")
    )


def cut_words(units: DataFrame) -> DataFrame:
    """(a-b) of the words cut by a hyphen that isn't theirs: the joined form has more evidence than the hyphenated one."""
    n = F.col("n_plain") + F.col("n_scan")
    cut = units.where("unit LIKE 'H%'").select(F.expr("substring(unit, 2)").alias("pair"))
    whole = units.where("unit LIKE 'W%'").select(F.expr("substring(unit, 2)").alias("whole"), n.alias("n_whole"))
    hyphened = units.where("unit LIKE 'Y%'").select(F.expr("substring(unit, 2)").alias("pair"), n.alias("n_hyphened"))
    joined = (
        cut.withColumn("whole", F.regexp_replace("pair", "-", "")).join(whole, "whole", "left").join(hyphened, "pair", "left").na.fill(0, ["n_whole", "n_hyphened"])
    )
    return joined.where("n_whole >= n_hyphened").select("pair")


class Noise:
    """What the corpus says, applied to one text."""

    def __init__(self, edges: frozenset[str], fixes: dict[str, tuple[str, str, bool]], cuts: frozenset[str]):
        self.edges, self.fixes, self.cuts = edges, fixes, cuts
        wrong = sorted({f[1] for u, f in fixes.items() if u[0] != "W"})
        self.wrong_at = re.compile(f"[{''.join(map(re.escape, wrong))}]" if wrong else r"(?!)")

    def misread(self, page: Page) -> list[tuple[int, int, str]]:
        """(start, end, right form) in the joined text."""
        flat = "\n" + page.flat
        m, fixes, out = masked(flat), self.fixes, []
        for hit in self.wrong_at.finditer(flat):
            i = hit.start()
            if i + 1 < len(m):
                fix = fixes.get("3" + m[i - 1 : i + 2]) or fixes.get("L" + m[i - 1 : i + 1]) or fixes.get("R" + m[i : i + 2])
                if fix:
                    out.append((i - 1, i, fix[0], fix[2]))
        for hit in WORD.finditer(page.flat):
            w = hit[0]
            if SUSPECT_WORD.search(w) and (fix := fixes.get("W" + w)):
                whole, wrong = fix[0], fix[1]  # the word meant, what was read wrongly in it
                at = next((k for k in range(len(w)) if w[k : k + len(wrong)] == wrong and w[:k] == whole[:k]), 0)
                k = next((k for k, (x, y) in enumerate(zip(w, whole)) if x != y), at)
                out.append((hit.start() + k, hit.start() + k + len(wrong), whole[k : len(whole) - (len(w) - k - len(wrong))], fix[2]))
        # without traces of pages only what hardly comes there counts
        return [x[:3] for x in out if page.scanned or x[3]]

    def kinds(self, text: str) -> list[tuple[int, str]]:
        """(line, kind of noise), distinct."""
        page = Page(text, self.edges)
        found = {(i, "furniture") for i, f in enumerate(page.furniture) if f}
        found |= {(i, "broken_word") for i, a, b in page.cuts if f"{a}-{b}" in self.cuts}
        found |= {(page.row(a), "misread") for a, _, _ in self.misread(page)}
        return sorted(found)

    def repair(self, text: str) -> str:
        """The text without furniture, its cut words and wrapped lines joined, its misread characters put right."""
        page = Page(text, self.edges)
        out, at = [], 0
        for a, b, right in sorted(set(self.misread(page))):
            if a >= at:
                out += [page.flat[at:a], right]
                at = b
        flat = "".join([*out, page.flat[at:]])
        for _, a, b in page.cuts:
            flat = flat.replace(f"{a}-\n{b}", f"{a}{b}" if f"{a}-{b}" in self.cuts else f"{a}-{b}")
        return flat.rstrip("\n")


def fit(texts: DataFrame, text: str, limit: int = 2_000_000) -> tuple[frozenset[str], dict[str, tuple[str, str, bool]], frozenset[str]]:
    """Edge forms, corrections and cut words of a corpus, checked against ``limit`` rows before they reach the driver.

    Corrections and cut words are sets of types, not of occurrences: they grow with the vocabulary.
    """
    units = durable(count_units(texts, text))
    fixes, cuts = durable(corrections(units)), durable(cut_words(units))
    if fixes.count() + cuts.count() > limit:
        raise ValueError("more corrections than may be sent to the tasks; raise limit with the memory for it")
    found = {r["unit"]: (r["right_unit"][1:] if r["unit"][0] == "W" else r["right"], r["wrong"], r["strict"]) for r in fixes.toLocalIterator()}
    return edge_forms(units), found, frozenset(r["pair"] for r in cuts.toLocalIterator())


def _apply(df: DataFrame, key: str, text: str, keep: list[str], model, schema: str, rows_of) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [*keep, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = Noise(*sent.value)
        for batch in batches:
            index, rows = [], []
            for i, t in enumerate(batch.column(len(names)).to_pylist()):
                for r in rows_of(noise, t):
                    index.append(i)
                    rows.append(r)
            kept = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_pydict({n: kept.column(j) for j, n in enumerate(names)} | {"_r": pa.array(rows, ROW)})

    types = dict(df.dtypes)
    return df.where(F.length(text) > 0).select(*names, text).mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + ", _r " + schema)


ROW = pa.struct([("line_no", pa.int32()), ("value", pa.string())])
ROW_SQL = "struct<line_no:int,value:string>"


def find(df: DataFrame, key: str, text: str, keep: list[str], model) -> DataFrame:
    """(keep..., key, line_no, noise_kind) of every noisy line."""
    rows = _apply(df, key, text, keep, model, ROW_SQL, lambda noise, t: [{"line_no": i, "value": k} for i, k in noise.kinds(t)])
    return rows.select(*keep, key, F.col("_r.line_no").alias("line_no"), F.col("_r.value").alias("noise_kind"))


def repair(df: DataFrame, key: str, text: str, keep: list[str], model) -> DataFrame:
    """(keep..., key, repaired) of every non-empty text."""
    rows = _apply(df, key, text, keep, model, ROW_SQL, lambda noise, t: [{"line_no": 0, "value": noise.repair(t)}])
    return rows.select(*keep, key, F.col("_r.value").alias("repaired"))
