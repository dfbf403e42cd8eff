"""Mixing sources to target weights by soft membership.

(1) A classifier (multinomial naive Bayes over hashed pairs of characters, its tables summed over all
labelled records) gives every record posteriors of the sources; a record's own label is evidence of
a stated reliability, not certainty. (2) Nonnegative rates per record are fitted by projected gradient
descent on the least squares between the expected tokens of each source and its target: every step is
one distributed aggregation over all records, and one number per source passes the driver. Steps are
summed before they are projected (lazy projection), so that a record's rate is one expression of the
sum, whatever the number of steps. (3) The largest total that the caps allow is mixed unless a smaller
one is given. (4) A labelled record is drawn for its own source; one factor per source brings the
tokens its records supply to the target, so that what is reported is exact, while the fit says which of
them are preferred. (5) Rates become whole draws: the whole part for all, and one more for the records
below a threshold of a hash, chosen per source from histograms of fixed size; what then is missing is
filled by the best sum of sizes of all records left (a subset sum over their histogram of sizes).

Records without tokens are never drawn. Null and unknown sources count as unlabelled. Repeated keys
are records of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.llm import codepoints as cp
from docrisk.llm import packing, tokens
from docrisk.session import durable

FEATURES = 4096
BINS = 1024
#: Probability that a record's label names the source it belongs to.
LABEL_TRUST = 0.95


def features(texts: list[str]) -> np.ndarray:
    """Counts (text x feature) of hashed pairs of neighbouring characters; one pass over all texts' code points."""
    codes = cp.code_points(texts)
    ends = codes == cp.BREAK
    pair = cp.pair_bucket(codes[:-1], codes[1:]) % FEATURES
    owner = (np.cumsum(ends) - ends)[:-1]
    ok = ~(ends[:-1] | ends[1:])
    return np.bincount(owner[ok] * FEATURES + pair[ok], minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def _slices(texts: list[str], most: int = 256) -> Iterator[list[str]]:
    """Texts a few hundred at a time, so that their dense counts stay small; the marks between texts are taken out of them."""
    for i in range(0, len(texts), most):
        yield [t.replace(chr(cp.BREAK), " ") for t in texts[i : i + most]]


def classifier(df: DataFrame, text: str, source: str, names: list[str]) -> np.ndarray:
    """Log-probabilities (source x feature) and, in the last column, log-priors; from all labelled records, one partial table per task."""
    index = {n: i for i, n in enumerate(names)}
    schema = "s int, docs long, row binary"

    def rows(table: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(docs, pa.int64()), pa.array([r.tobytes() for r in table], pa.binary())], ["s", "docs", "row"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros((len(names), FEATURES), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            labels = np.array([index[s] for s in batch.column(1).to_pylist()], np.int64)
            docs += np.bincount(labels, minlength=len(names))
            at = 0
            for some in _slices(batch.column(0).to_pylist()):
                np.add.at(table, labels[at : at + len(some)], features(some))
                at += len(some)
        yield rows(table, docs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros((len(names), FEATURES), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for s, n, row in zip(*(c.to_pylist() for c in batch.columns)):
                table[s] += np.frombuffer(row, np.int64)
                docs[s] += n
        yield rows(table, docs)

    counts, docs = np.ones((len(names), FEATURES)), np.ones(len(names))
    labelled = df.where((F.length(text) > 0) & F.col(source).isin(names)).select(text, source)
    for r in labelled.mapInArrow(count, schema).coalesce(8).mapInArrow(add, schema).toLocalIterator():
        counts[r["s"]] += np.frombuffer(r["row"], np.int64)
        docs[r["s"]] += r["docs"]
    return np.column_stack([np.log(counts / counts.sum(1, keepdims=True)), np.log(docs / docs.sum())])


def posteriors(texts: list[str], labels: list[str | None], names: list[str], model: np.ndarray) -> np.ndarray:
    """(text x source) probabilities.

    The evidence of a text is its mean log-likelihood times the square root of its length: neighbouring
    pairs aren't independent, and whole sums would make every posterior 0 or 1. A label multiplies it
    by the probability of that label under each source.
    """
    out = []
    for some in _slices(texts):
        x = features(some)
        out.append(x @ model[:, :-1].T / np.sqrt(np.maximum(1, x.sum(1, keepdims=True))) + model[:, -1])
    score = np.concatenate(out) if out else np.zeros((0, len(names)))
    other = math.log((1 - LABEL_TRUST) / max(1, len(names) - 1))
    for i, s in enumerate(labels):
        if s in names and len(names) > 1:
            score[i] += other
            score[i, names.index(s)] += math.log(LABEL_TRUST) - other
    e = np.exp(score - score.max(1, keepdims=True, initial=-np.inf))
    return e / e.sum(1, keepdims=True)


def memberships(df: DataFrame, key: str, text: str, source: str, names: list[str], model: np.ndarray, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, source, n_tokens, post) of every record with tokens: one pass that counts tokens and classifies."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, m = tokens.encoder(vocabulary).encode_ordinary, sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(encode(t)) for t in texts]
            post = posteriors(texts, batch.column(2).to_pylist(), names, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(post.tolist(), pa.list_(pa.float64()))], [key, source, "n_tokens", "post"])

    rows = df.where(F.length(text) > 0).select(F.col(key).cast("long").alias(key), text, source)
    return rows.mapInArrow(run, f"`{key}` long, `{source}` string, n_tokens long, post array<double>").where("n_tokens > 0")


def _dot(post: Column, values: list[float]) -> Column:
    return F.aggregate(F.zip_with(post, F.array(*[F.lit(float(v)) for v in values]), lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def _rate(post: Column, steps: list[float], caps: list[float]) -> Column:
    """A record's rate after the sum of all steps, projected on [0, cap]."""
    return F.greatest(F.lit(0.0), F.least(_dot(post, caps), 1 - _dot(post, steps)))


def fit_rates(members: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, steps: int = 40, tolerance: float = 1e-4) -> tuple[list[float], float]:
    """The sum of the gradient steps that make the expected tokens of each source its share of the total, and that total."""
    names = list(targets)
    share, caps = [targets[n][0] for n in names], [float(targets[n][1]) for n in names]
    post, size = F.col("post"), F.col("n_tokens")
    mass = members.agg(*[F.sum(size * post[i]).alias(f"m{i}") for i in range(len(names))]).first()
    tokens_of = [float(m or 0) for m in mass]
    feasible = min((c * t / s for c, t, s in zip(caps, tokens_of, share) if s > 0), default=0.0)
    total = feasible if total is None else min(total, feasible)
    summed = [0.0] * len(names)
    for _ in range(steps):
        row = members.withColumn("_r", _rate(post, summed, caps)).agg(*[F.sum(size * post[i] * F.col("_r")).alias(f"g{i}") for i in range(len(names))]).first()
        residual = [float(g or 0) - s * total for g, s in zip(row, share)]
        if max((abs(x) for x in residual), default=0) <= tolerance * max(total, 1):
            break
        # preconditioned by each source's tokens: a step moves its records' rates by what they are off on average
        summed = [g + (x / t if t else 0.0) for g, x, t in zip(summed, residual, tokens_of)]
    return summed, total


def factors(rated: DataFrame, targets: dict[str, tuple[float, int]], total: float | None, rounds: int = 30, tolerance: float = 1e-5) -> tuple[dict[str, float], float]:
    """Per domain the factor on its records' rates (cut at its cap) that makes the tokens it supplies its share of the total, and that total.

    Found for all domains together by halving on a logarithmic scale, one aggregation a round. ``rated`` has domain, n_tokens and rate.
    """
    names = list(targets)
    supply = {r["domain"]: float(r["t"]) for r in rated.groupBy("domain").agg(F.sum("n_tokens").alias("t")).collect()}
    feasible = min((supply.get(n, 0.0) * cap / share for n, (share, cap) in targets.items()), default=0.0)
    total = feasible if total is None else min(total, feasible)
    low, high = dict.fromkeys(names, -12.0), dict.fromkeys(names, 12.0)
    for _ in range(rounds):
        middle = {n: (low[n] + high[n]) / 2 for n in names}
        drawn = {r["domain"]: float(r["t"]) for r in rated.groupBy("domain").agg(F.sum(F.col("n_tokens") * _scaled(middle, targets)).alias("t")).collect()}
        off = {n: drawn.get(n, 0.0) - targets[n][0] * total for n in names}
        if max(map(abs, off.values()), default=0) <= tolerance * max(total, 1):
            return middle, total
        for n in names:
            if off[n] < 0:
                low[n] = middle[n]
            else:
                high[n] = middle[n]
    return {n: (low[n] + high[n]) / 2 for n in names}, total


def _scaled(powers: dict[str, float], targets: dict[str, tuple[float, int]]) -> Column:
    of = F.create_map(*[F.lit(x) for n, p in powers.items() for x in (n, float(2.0**p))])
    cap = F.create_map(*[F.lit(x) for n, (_, c) in targets.items() for x in (n, float(c))])
    # a rate of nothing could never be brought to a target; the least rate keeps every record in reach of the factor
    return F.least(cap[F.col("domain")], F.greatest(F.col("rate"), F.lit(2.0**-10)) * of[F.col("domain")])


def draw(members: DataFrame, key: str, source: str, targets: dict[str, tuple[float, int]], summed: list[float], total: float | None) -> DataFrame:
    """(key, source, domain, draw_no, n_tokens): each record as often as it is drawn."""
    names, caps = list(targets), [float(c) for _, c in targets.values()]
    post, size = F.col("post"), F.col("n_tokens")
    # an unlabelled record stands for a source drawn from its posterior, so that the totals drawn are the expected ones
    lot = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(1).alias("k"))
    step = lambda a, p: F.struct((a["c"] + p).alias("c"), (a["k"] + F.when(a["c"] + p <= lot, 1).otherwise(0)).alias("k"))
    best = F.least(F.aggregate(post, start, step)["k"], F.lit(len(names)))
    domain = F.when(F.col(source).isin(names), F.col(source)).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), best))
    rated = members.withColumn("rate", _rate(post, summed, caps)).withColumn("domain", domain)
    rated = durable(rated.select(key, source, "n_tokens", "domain", "rate"))
    powers, total = factors(rated, targets, total)
    cap_of = F.create_map(*[F.lit(x) for n, c in zip(names, caps) for x in (n, int(c))])
    rated = (
        rated.withColumn("rate", _scaled(powers, targets)).withColumn("cap", cap_of[F.col("domain")])
        .withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("u", F.pmod(F.xxhash64(F.lit(7), key), F.lit(BINS * BINS)).cast("int"))
    )
    able = rated.where("whole < cap AND part > 1e-6")
    want = {r["domain"]: float(r["t"]) for r in able.groupBy("domain").agg(F.sum(size * F.col("part")).alias("t")).collect()}

    def histogram(rows: DataFrame, bin_: Column) -> dict[str, np.ndarray]:
        out = {n: np.zeros(BINS) for n in names}
        for r in rows.groupBy("domain", bin_.alias("b")).agg(F.sum(size).alias("t")).collect():  # at most BINS rows per source
            out[r["domain"]][r["b"]] = float(r["t"])
        return out

    def crossing(h: np.ndarray, amount: float) -> tuple[int, float]:
        c = np.cumsum(h)
        b = int(np.searchsorted(c, amount, side="right"))
        return min(b, BINS - 1), amount - (c[b - 1] if b else 0.0)

    coarse = histogram(able, (F.col("u") / BINS).cast("int"))
    first = {n: crossing(coarse[n], want.get(n, 0.0)) for n in names}
    of_source = F.create_map(*[F.lit(x) for n in names for x in (n, first[n][0])])[F.col("domain")]
    fine = histogram(able.where((F.col("u") / BINS).cast("int") == of_source), F.pmod("u", F.lit(BINS)).cast("int"))
    limit, missing = {}, {}
    for n in names:
        b, missing[n] = crossing(fine[n], first[n][1])
        limit[n] = first[n][0] * BINS + b
    added: list[int] = []
    # the record at the threshold would be too much: of all records left, those whose sizes add up best
    missing_of = F.create_map(*[F.lit(x) for n in names for x in (n, float(missing[n]))])[F.col("domain")]
    limit_of = F.create_map(*[F.lit(x) for n in names for x in (n, limit[n])])[F.col("domain")]
    left = able.where((F.col("u") >= limit_of) & (size <= missing_of))
    sizes: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in left.groupBy("domain", "n_tokens").agg(F.count("*").alias("n")).collect():  # what is missing is less than one record, which bounds the sizes
        sizes[r["domain"]][r["n_tokens"]] = r["n"]
    for n in names:
        for length, k in Counter(best_sum(sizes[n], int(missing[n]))).items():
            some = left.where((F.col("domain") == n) & (size == length)).orderBy("u", key).select(key).limit(k)
            added += [r[key] for r in some.collect()]
    threshold = F.create_map(*[F.lit(x) for n in names for x in (n, limit[n])])[F.col("domain")]
    extra = F.when((F.col("whole") < F.col("cap")) & (F.col("part") > 1e-6) & ((F.col("u") < threshold) | F.col(key).isin(added)), 1).otherwise(0)
    return (
        rated.withColumn("copies", F.col("whole") + extra).where("copies > 0")
        .select(key, source, "domain", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("draw_no"), F.col("n_tokens").cast("long").alias("n_tokens"))
    )


def best_sum(counts: dict[int, int], capacity: int) -> list[int]:
    """Sizes, each at most as often as there are records of it, that add up to the most within the capacity."""
    if not counts or capacity < 1:
        return []
    seed = capacity + 1  # stands for what is there already
    return packing.fill(sorted([*counts, seed]), {**counts, seed: 1}, capacity + seed)[1:]


def mix(df: DataFrame, key: str, text: str, source: str, targets: dict[str, tuple[float, int]], total: float | None = None, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """The drawn records; ``targets`` gives each source's share (made to sum to 1) and most repeats."""
    kept = {n: (s, int(r)) for n, (s, r) in targets.items() if n is not None and s and s > 0 and r and r > 0}
    if not kept:
        return df.sparkSession.createDataFrame([], f"`{key}` long, `{source}` string, domain string, draw_no int, n_tokens long")
    whole = sum(s for s, _ in kept.values())
    kept = {n: (s / whole, r) for n, (s, r) in sorted(kept.items())}
    names = list(kept)
    members = durable(memberships(df, key, text, source, names, classifier(df, text, source, names), vocabulary))
    summed, _ = fit_rates(members, kept, total)
    return draw(members, key, source, kept, summed, total)


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, actual_share, n_draws, n_records, most_repeats, max_repeats) of a mix; unlabelled draws count for the source they were taken to stand for."""
    per = drawn.groupBy("domain").agg(
        F.sum("n_tokens").alias("t"), F.count("*").alias("n_draws"), F.count_if(F.col("draw_no") == 1).alias("n_records"), F.max("draw_no").alias("most_repeats")
    )
    total = per.agg(F.sum("t")).first()[0] or 1
    return targets.join(per, targets[source] == per["domain"], "left").select(
        source, "target_share", (F.coalesce("t", F.lit(0)) / F.lit(float(total))).alias("actual_share"),
        F.coalesce("n_draws", F.lit(0)).alias("n_draws"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
