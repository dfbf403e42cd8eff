"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

A mergeable aggregate whose state is a sorted list of disjoint closed intervals. Every task first
reduces its rows to such lists (so that rows that overlap never travel), salted levels of a reduction
tree combine the lists of entities with very many, and the last level merges the sorted lists of each
entity in one linear pass that keeps only the interval at hand. Lists travel as rows (key, start, end),
so that no level holds the rows of an entity at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.operators import timestamps as ts

LIST = "array<struct<s:int,e:int>>"


def _groups(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """A number per row: equal keys (nulls, too) have equal numbers."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(n_keys):
        column = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def disjoint(group: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and start: the first row of each continuous run, and the run's end. Linear.

    A running maximum of the ends does it for all groups at once, as each group's values are lifted above those of the group before.
    """
    if not len(s):
        return np.zeros(0, np.int64), e
    low = int(min(s.min(), e.min()))
    step = int(max(s.max(), e.max())) - low + 3  # so that neighbouring groups never touch
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * step
    top = np.maximum.accumulate(rank + e - low)
    first = np.flatnonzero(np.concatenate([[True], rank[1:] + s[1:] - low > top[:-1] + 1]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    return first, top[last] - rank[last] + low


def _partial(n_keys: int):
    """Each batch of rows (key..., s, e) reduced to the disjoint intervals of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, s, e = _groups(batch, n_keys), batch.column(n_keys).to_numpy().astype(np.int64), batch.column(n_keys + 1).to_numpy().astype(np.int64)
            order = np.lexsort((s, group))
            first, ends = disjoint(group[order], s[order], e[order])
            kept = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(ends, pa.int32())], schema=batch.schema)

    return run


def _final(n_keys: int, names: list[str]):
    """Rows sorted by key and start, to one list per key; what passes from batch to batch is the last key's list so far."""
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def row(key: pa.RecordBatch, chunks: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        s, e = (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
        value = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["s", "e"]))
        return pa.RecordBatch.from_arrays([*key.columns[:n_keys], value.cast(spans)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: pa.RecordBatch | None = None
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group, s, e = _groups(batch, n_keys), batch.column(n_keys).to_numpy().astype(np.int64), batch.column(n_keys + 1).to_numpy().astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            if key is not None and all(batch.column(i)[0].as_py() == key.column(i)[0].as_py() for i in range(n_keys)):
                a, b = done[-1][0][-1:], done[-1][1][-1:]  # the interval at hand goes on
                done[-1] = (done[-1][0][:-1], done[-1][1][:-1])
                s, e, group = np.concatenate([a, s]), np.concatenate([b, e]), np.concatenate([group[:1], group])
                heads = np.concatenate([[0], heads[1:] + 1])
                shift = 1
            else:
                if key is not None:
                    yield row(key, done)
                done, shift = [], 0
            first, ends = disjoint(group, s, e)
            cuts = np.searchsorted(first, heads)
            bounds = np.concatenate([cuts, [len(first)]])
            starts = s[first]
            if len(heads) > 1:
                # the first key may have a list from before; the last one may go on
                done.append((starts[: bounds[1]], ends[: bounds[1]]))
                yield row(batch.slice(0, 1), done)
                if len(heads) > 2:
                    a, b = bounds[1], bounds[-2]
                    value = pa.ListArray.from_arrays(pa.array(bounds[1:-1] - a, pa.int32()), pa.StructArray.from_arrays([pa.array(starts[a:b], pa.int32()), pa.array(ends[a:b], pa.int32())], ["s", "e"]))
                    whole = batch.take(pa.array(heads[1:-1] - shift))
                    yield pa.RecordBatch.from_arrays([*whole.columns[:n_keys], value.cast(spans)], names)
                done = []
            done.append((starts[bounds[-2] :], ends[bounds[-2] :]))
            key = batch.slice(batch.num_rows - 1, 1)
        if key is not None:
            yield row(key, done)

    return run


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, fan_in: int = 64, levels: int = 1) -> DataFrame:
    """One row per key with ``spans``: its sorted disjoint closed intervals; neighbours that touch are joined.

    Reversed bounds are swapped, a null bound takes the other one, rows with two null bounds are
    dropped, null keys form a group of their own. ``levels`` salted levels of ``fan_in`` groups each
    come before the last one; none is needed where an entity's disjoint list is short, however many its rows.
    """
    s, e = F.coalesce(F.col(start), F.col(end)).cast("int"), F.coalesce(F.col(end), F.col(start)).cast("int")
    rows = df.where(s.isNotNull()).select(*key, F.least(s, e).alias("_s"), F.greatest(s, e).alias("_e"))
    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in key)
    state = rows.mapInArrow(_partial(len(key)), f"{kinds}, _s int, _e int")
    for level in range(levels, 0, -1):
        salt = F.pmod(F.xxhash64("_s"), F.lit(fan_in**level)).cast("int")
        state = state.repartition(*key, salt).mapInArrow(_partial(len(key)), f"{kinds}, _s int, _e int")
    state = state.repartition(*key).sortWithinPartitions(*key, "_s")
    return state.mapInArrow(_final(len(key), [*key, "spans"]), f"{kinds}, spans {LIST}")


def periods_and_gaps(merged: DataFrame, key: list[str], start: str = "from_month", end: str = "to_month") -> DataFrame:
    """Rows (key..., span_kind, start, end) of the periods and of the gaps between neighbours."""
    spans = F.col("spans")
    gaps = F.transform(
        F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))),
        lambda x, i: F.struct(F.lit("gap").alias("k"), (F.element_at(spans, (i + 1).cast("int"))["e"] + 1).alias("s"), (x["s"] - 1).alias("e")),
    )
    periods = F.transform(spans, lambda x: F.struct(F.lit("period").alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return merged.select(*key, F.explode(F.concat(periods, gaps)).alias("_x")).select(
        *key, F.col("_x.k").alias("span_kind"), F.col("_x.s").alias(start), F.col("_x.e").alias(end)
    )


def line_intervals(df: DataFrame, fields: list[str], key: str, as_of: tuple[int, int] = (2025, 6), zone: str = ts.CANDIDATE_ZONES[0]) -> DataFrame:
    """(field_name, key, from_month, to_month) of each dated line, months being those of ``zone``; an open end is ``as_of``.

    A column ``_home`` (``timestamps.with_zone``) gives the zone of times without one.
    """
    now = as_of[0] * 12 + as_of[1]
    dated = ts.normalise(ts.date_tokens(df, fields, [key, *(["_home"] if "_home" in df.columns else [])]), zone)
    # the dates of a line are neighbours in one task: partial aggregation leaves one row per line before the shuffle
    lines = dated.groupBy("field_name", key, "line_no").agg(
        F.min(F.when(F.col("bound_no") == 1, F.col("month"))).alias("a"),
        F.max(F.when(F.col("bound_no") == F.col("n_bounds"), F.col("month"))).alias("b"),
        F.max("n_bounds").alias("n"),
        F.max("open_end").alias("o"),
    )
    return lines.select("field_name", key, F.col("a").alias("from_month"), F.when(F.col("o") & (F.col("n") == 1), F.lit(now)).otherwise(F.col("b")).alias("to_month"))


def experience_spans(df: DataFrame, fields: list[str], key: str = "doc_id", as_of: tuple[int, int] = (2025, 6), zone: str = ts.CANDIDATE_ZONES[0]) -> DataFrame:
    """Distinct (field_name, key, span_kind, from_month, to_month) of the dated lines of array columns."""
    merged = merge_intervals(line_intervals(df, fields, key, as_of, zone), ["field_name", key], "from_month", "to_month", levels=0)  # a list of months is short
    return periods_and_gaps(merged, ["field_name", key])
