"""Texts as arrays of code points, and corpus statistics of characters and adjacent pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Adjacent pairs are counted in this many buckets, so that the table's size doesn't depend on the corpus.
PAIR_BUCKETS = 1 << 21
BREAK = 0x1E  # stands between texts


def code_points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, a ``BREAK`` after each."""
    joined = chr(BREAK).join(texts) + chr(BREAK)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF
    return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - PAIR_BUCKETS.bit_length() + 1)


def character_shares(texts: DataFrame, text: str, sides_of: tuple[int, int] = (0, 0)) -> tuple[dict[str, float], dict[str, float]]:
    """Share of non-null texts that hold a character and, for those in the range ``sides_of``, the share of their sides (two an occurrence) that are plain letters.

    Partial counts per task, at most one row per character of Unicode to the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        sides, plain = np.zeros(sides_of[1] + 1, np.int64), np.zeros(sides_of[1] + 1, np.int64)
        n = 0
        for batch in batches:
            rows = [t for t in batch.column(0).to_pylist() if t is not None]
            n += len(rows)
            for t in rows:
                seen.update(set(t))
            codes = np.concatenate([[BREAK], code_points(rows)])
            at = np.flatnonzero((codes >= sides_of[0]) & (codes < sides_of[1]))
            np.add.at(sides, codes[at], 2)
            for side in (at - 1, at + 1):
                low = codes[side] | 32
                np.add.at(plain, codes[at], (codes[side] < 128) & (low >= 97) & (low <= 122))
        keys = [-1, *map(ord, seen)]
        two = [(int(sides[k]), int(plain[k])) if 0 <= k < len(sides) else (0, 0) for k in keys]
        columns = [pa.array(keys, pa.int32()), *(pa.array(c, pa.int64()) for c in ([n, *seen.values()], [a for a, _ in two], [b for _, b in two]))]
        yield pa.RecordBatch.from_arrays(columns, ["c", "n", "sides", "plain"])

    sums = [F.sum(c).alias(c) for c in ("n", "sides", "plain")]
    rows = texts.select(text).mapInArrow(partial, "c int, n long, sides long, plain long").groupBy("c").agg(*sums).collect()
    n = max([1, *(r["n"] for r in rows if r["c"] == -1)])
    known = [r for r in rows if r["c"] >= 0]
    return {chr(r["c"]): r["n"] / n for r in known}, {chr(r["c"]): r["plain"] / r["sides"] for r in known if r["sides"]}


def pair_counts(texts: DataFrame, text: str, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of adjacent pairs (in buckets) and of characters over all texts, both characters being ``trusted``.

    ``trusted``: a flag per code point. Each task adds up its own table; at most ``PAIR_BUCKETS`` rows reach the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(0x110000, np.int64)
        for batch in batches:
            rows = [t for t in batch.column(0).to_pylist() if t]
            if not rows:
                continue
            codes = code_points(rows)
            ok = trusted[codes]
            both = ok[:-1] & ok[1:]
            np.add.at(chars, codes[ok], 1)
            pairs += np.bincount(pair_bucket(codes[:-1][both], codes[1:][both]), minlength=PAIR_BUCKETS)
        p, c = np.flatnonzero(pairs), np.flatnonzero(chars)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([p, -1 - c]).astype(np.int64)), pa.array(np.concatenate([pairs[p], chars[c]]))], ["k", "n"]
        )

    rows = texts.select(text).mapInArrow(partial, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = rows.column("k").to_numpy(), rows.column("n").to_numpy()
    pairs, chars = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(0x110000, np.int64)
    pairs[k[k >= 0]], chars[-1 - k[k < 0]] = n[k >= 0], n[k < 0]
    return pairs, chars
