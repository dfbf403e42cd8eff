"""Filling fixed-capacity containers with items: minimum bin slack over blocks of items.

Items are spread over blocks of bounded size by a hash of their key, so that no block depends on a
hot value. In a block, container after container is filled: the longest item left is the seed, and
a bitset subset-sum over the lengths available (multiplicities split into powers of two) finds the
fullest combination for the rest, which is then removed. An item longer than the capacity is cut
into full containers and a remainder, which is packed like any other item; no other item is cut.

Null items are no items. Items of length 0 go into their block's last container (or one of their
own). Ties between items of one length are broken by key. Unused space per block is less than what
its last container leaves, plus the slack of the subset sums.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm import tokens

BLOCK_ITEMS = 20_000


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest container that holds the longest item. ``lengths``: the distinct ones, ascending."""
    seed = lengths[-1]
    rest = capacity - seed
    reach, steps = 1, []
    limit = (1 << (rest + 1)) - 1
    for k in range(bisect_right(lengths, rest) - 1, -1, -1):
        length = lengths[k]
        left, part = min(counts[length] - (length == seed), rest // length), 1
        while left > 0:
            take = min(part, left)
            more = (reach | reach << (take * length)) & limit
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            left -= take
            part *= 2
        if reach >> rest:
            break
    total, chosen = reach.bit_length() - 1, [seed]
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(container, place), both from 0, of each item; sizes must not exceed the capacity."""
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    empty = waiting.pop(0, [])
    counts = {length: len(items) for length, items in waiting.items()}
    lengths: list[int] = []
    for length in counts:
        insort(lengths, length)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    container, place = 0, 0
    while lengths:
        for place, length in enumerate(fill(lengths, counts, capacity)):
            out[waiting[length].pop()] = (container, place)
            counts[length] -= 1
            if not counts[length]:
                del counts[length]
                lengths.pop(bisect_right(lengths, length) - 1)
        container += 1
    for k, i in enumerate(reversed(empty)):
        out[i] = (max(0, container - 1), (place + 1 if container else 0) + k)
    return out


def token_sizes(df: DataFrame, key: str, text: str, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of all non-null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens int")


def pack_items(items: DataFrame, key: str, size: str, limits: list[tuple[str, int]], block_items: int = BLOCK_ITEMS, n_items: int | None = None) -> DataFrame:
    """(limit_name, key, piece_no, container_no, place, n_tokens) for every item and each named capacity.

    ``container_no`` is unique per limit; ``piece_no`` counts the pieces of a cut item from 0.
    ``n_items`` sets the number of blocks and is counted if not given.
    """
    limits = [(name, int(c)) for name, c in limits if name is not None and c is not None and c > 0]
    schema = f"limit_name string, `{key}` {dict(items.dtypes)[key]}, piece_no int, container_no long, place int, n_tokens int"
    if not limits:
        return items.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-(items.count() if n_items is None else n_items) // block_items))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity")) for n, c in limits])).alias("_l")
    spread = (
        items.where(F.col(size).isNotNull())
        .select(F.col(key), F.col(size).cast("int").alias("n_tokens"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), named)
        .select(key, "n_tokens", "_block", "_l.limit_name", "_l.capacity")
        .repartition(min(4096, blocks * len(limits)), "limit_name", "_block")
    )

    def block(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(key, kind="stable")
        capacity, number, limit_name = int(f["capacity"].iloc[0]), int(f["_block"].iloc[0]), f["limit_name"].iloc[0]
        keys, pieces, sizes, whole = [], [], [], []
        for k, n in zip(f[key], f["n_tokens"]):
            full = n // capacity if n > capacity else 0
            for p in range(full):
                whole.append((k, p))
            rest = n - full * capacity
            if rest or not full:
                keys.append(k)
                pieces.append(full)
                sizes.append(rest)
        places = pack(sizes, capacity)
        first = 1 + max((c for c, _ in places), default=-1)
        rows = [(limit_name, k, p, c, at, n) for k, p, (c, at), n in zip(keys, pieces, places, sizes)]
        rows += [(limit_name, k, p, first + i, 0, capacity) for i, (k, p) in enumerate(whole)]
        out = pd.DataFrame(rows, columns=["limit_name", key, "piece_no", "container_no", "place", "n_tokens"])
        out["container_no"] = out["container_no"] * blocks + number
        return out

    return spread.groupBy("limit_name", "_block").applyInPandas(block, schema)


def fill_report(packed: DataFrame, limits: DataFrame, name: str = "limit_name", capacity: str = "capacity_tokens") -> DataFrame:
    """(limit_name, n_containers, n_pieces, n_tokens, fill) of each limit; salted by container, so pre-aggregated."""
    per = packed.groupBy(name, "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    totals = per.groupBy(name).agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return totals.join(F.broadcast(limits.select(name, capacity)), name).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col(capacity)))
