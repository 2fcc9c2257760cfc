"""Calibration and reports over search results."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skerry.functions import vectors as V


def low_index(p: float, n: int) -> int:
    """Index for percentiles where a higher p means a smaller value; float32 arithmetic, as 0.99 of 100 values must give 0."""
    return min(n - 1, int(np.floor((np.float32(1) - np.float32(p)) * np.float32(n))))


def upper_index(p: float, n: int) -> int:
    return int(np.floor(np.float32(p) * np.float32(n - 1)))


def upper_index_double(p: float, n: int) -> int:
    """As :func:`upper_index`, in double arithmetic and clamped."""
    return min(n - 1, max(0, int(p * (n - 1))))


def kth_place(k: int, n: int, self_sampled: bool = False) -> int:
    """Index of a calibration query's k-th neighbour among its n ascending distances: one more where the query is a row itself, and the last where there are fewer."""
    return min(k + int(self_sampled), n) - 1


def max_or_zero(df: DataFrame, value: str) -> float:
    return df.agg(F.coalesce(F.max(value), F.lit(0.0))).first()[0]


def at_index(df: DataFrame, value: str, index) -> float:
    """The value at ``index(n)`` in ascending order; 0 for no rows. Range-sorted, so no task sees all rows."""
    return at_places(df, value, [index])[0]


def at_places(df: DataFrame, value: str, indexes: list) -> list[float]:
    """:func:`at_index` for several places of one sort. Rows are numbered within their ranges: an offset would bring all rows before it to one task."""
    n = df.count()
    if not n:
        return [0.0] * len(indexes)
    places = [index(n) for index in indexes]
    found = {r["place"]: r[value] for r in numbered(df.select(value), value).filter(F.col("place").isin(places)).collect()}
    return [found[p] for p in places]


def quantiles(df: DataFrame, value: str, ps: list[float]) -> list[float | None]:
    """By interpolation, over values that are not null; None for no rows."""
    known = df.filter(F.col(value).isNotNull())
    n = known.count()
    beside = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in ps]
    at = iter(at_places(known, value, [lambda n, i=i: i for _, low, high in beside for i in (low, high)])) if n else iter(())
    return [(low := next(at)) + (next(at) - low) * (p - floor) for p, floor, _ in beside] if n else [None] * len(ps)


def kth_distances(pairs: DataFrame, k: int, dist: str = "dist") -> DataFrame:
    """Each query's k-th smallest distance; queries with fewer than k give none."""
    w = W.Window.partitionBy("qid").orderBy(dist)
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("qid", F.col(dist).alias("kth"))


def d_k_samples(pairs: DataFrame, k: int, dist: str, self_sampled: bool = False) -> DataFrame:
    """(qid, kth): each sampled query's k-th smallest distance or estimate, its own row skipped by taking one more; queries with too few candidates give none."""
    return kth_distances(pairs, k + int(self_sampled), dist)


@dataclass(frozen=True)
class Calibration:
    """Thresholds and error bounds from sampled queries: ``d_k`` from exact distances, ``safein_d_k`` from stage-2 estimates, and the normalised errors of both stages."""

    d_k: float
    safein_d_k: float
    eps: float
    eps2: float


def calibrate(pairs: DataFrame, k: int, d_k_share: float = 0.9, eps_share: float = 0.9, self_sampled: bool = True) -> Calibration:
    """``pairs`` of sampled queries with all rows: qid, true, est, est2, norm_oc, norm_qc, in_cluster (whether the row is in the query's own cluster). Errors count in-cluster pairs only."""
    d_k = calibrate_d_k(d_k_samples(pairs, k, "true", self_sampled), d_k_share)
    safein = calibrate_d_k(d_k_samples(pairs, k, "est2", self_sampled), d_k_share)
    near = pairs.filter("in_cluster").select("true", "norm_oc", "norm_qc", "est", "est2")
    eps, eps2 = (calibrate_epsilon(near.select("true", "norm_oc", "norm_qc", F.col(e).alias("est")), d_k, eps_share) for e in ("est", "est2"))
    return Calibration(d_k, safein, eps, eps2)


def calibrate_d_k(kth: DataFrame, p: float) -> float:
    return at_index(kth, "kth", lambda n: low_index(p, n))


def normalised_error(est: Column, true: Column, vector_norm: Column, query_norm: Column) -> Column:
    return F.abs(est - true) / (2 * vector_norm * query_norm)


def calibrate_epsilon(pairs: DataFrame, d_k: float, p: float) -> float:
    """``pairs``: est, true, norm_oc, norm_qc. Only distances within 0.1 to 10 of d_k count."""
    near = pairs.filter(F.col("true").between(0.1 * d_k, 10 * d_k) & (F.col("norm_oc") * F.col("norm_qc") > 0))
    return at_index(near.select(normalised_error(F.col("est"), F.col("true"), F.col("norm_oc"), F.col("norm_qc")).alias("e")), "e", lambda n: upper_index(p, n))


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    """``df``: cls, is_true."""
    said = lambda c: F.col("cls") == c
    return df.groupBy(*keys).agg(*(F.count_if(said(c)).alias(c.lower()) for c in ("SafeIn", "SafeOut", "Uncertain")), F.count_if(said("SafeIn") & ~F.col("is_true")).alias("false_safein"), F.count_if(said("SafeOut") & F.col("is_true")).alias("false_safeout"))


def margin_replay(df: DataFrame, scales: list[float]) -> DataFrame:
    """Counts and rates with SafeIn margins scaled and SafeOut margins as they are. ``df``: est, margin, d_k, safein_d_k, is_true. Scales are a short list."""
    s = F.explode(F.array(*[F.lit(float(x)) for x in scales]))
    cls = F.when(F.col("est") > F.col("d_k") + 2 * F.col("margin"), "SafeOut").when(F.col("est") < F.col("safein_d_k") - 2 * F.col("scale") * F.col("margin"), "SafeIn").otherwise("Uncertain")
    return replay_rates(class_counts(df.withColumn("scale", s).withColumn("cls", cls), "scale"))


def replay_rates(counted: DataFrame) -> DataFrame:
    total = F.col("safein") + F.col("safeout") + F.col("uncertain")
    return counted.withColumn("safein_rate", V.safe_rate(F.col("safein"), total)).withColumn("false_safein_rate", V.safe_rate(F.col("false_safein"), F.col("safein")))


def grid_replay(df: DataFrame, d_ks: list[float], epsilons: list[float]) -> DataFrame:
    """Per (d_k, eps): SafeIn, false SafeIn, blocked by the margin, and queries with at least one and two. ``df``: qid, est, norms, is_true."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("d_k"), F.lit(float(e)).alias("eps")) for d in d_ks for e in epsilons]))
    m = F.col("norms") * F.col("g.eps")
    below, inside = F.col("est") < F.col("g.d_k"), F.col("est") < F.col("g.d_k") - 2 * m
    per = df.withColumn("g", grid).groupBy("g", "qid").agg(F.count_if(inside).alias("safein"), F.count_if(inside & ~F.col("is_true")).alias("false_safein"), F.count_if(below & ~inside).alias("blocked"))
    return grid_totals(per)


def grid_totals(per: DataFrame) -> DataFrame:
    """``per``: g (d_k, eps), qid, safein, false_safein, blocked."""
    return per.groupBy("g").agg(F.sum("safein").alias("safein"), F.sum("false_safein").alias("false_safein"), F.sum("blocked").alias("blocked"), F.count_if(F.col("safein") >= 1).alias("queries_1"), F.count_if(F.col("safein") >= 2).alias("queries_2")).select("g.d_k", "g.eps", "safein", "false_safein", "blocked", "queries_1", "queries_2")


def distribution(long: DataFrame) -> DataFrame:
    """mean, p50, p95, p99, max of each metric, from (metric, v): a percentile is the value at the whole part of p * (n - 1), without interpolation. One range sort for all metrics, a row for each of which is broadcast."""
    ps = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    stats = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.Window.orderBy("metric").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    places = stats.select("*", *((before + F.floor(F.lit(p) * (F.col("_n") - 1))).alias(f"_{c}") for c, p in ps.items()))
    at = numbered(long, "metric", "v").join(F.broadcast(places), "metric")
    return at.groupBy("metric").agg(F.first("mean").alias("mean"), *(F.max(F.when(F.col("place") == F.col(f"_{c}"), F.col("v"))).alias(c) for c in ps), F.first("max").alias("max"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return shares(df.groupBy(truth, guess).agg(F.count("*").alias("n")), truth)


def shares(counts: DataFrame, key: str) -> DataFrame:
    """Counts ``n`` with their per cent of those of the same key."""
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.Window.partitionBy(key)))


def entropy_bits(counts: DataFrame, n: str = "n") -> DataFrame:
    total = counts.agg(F.sum(n).alias("t"))
    p = F.col(n) / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def spearman(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Correlation of ranks (ties by ``tie``), 0 for fewer than two rows or no variance. Ranks are places in a range sort, so no task sees all rows."""
    rx = numbered(df.select(x, tie), x, tie).select(tie, F.col("place").cast("double").alias("rx"))
    ry = numbered(df.select(y, tie), y, tie).select(tie, F.col("place").cast("double").alias("ry"))
    return rx.join(ry, tie).agg(F.coalesce(F.corr("rx", "ry"), F.lit(0.0)).alias("rho"))


def dictionary(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, code): different values numbered by first place."""
    first = df.groupBy(value).agg(F.min(position).alias("first"))
    return numbered(first, "first").select(value, F.col("place").cast("int").alias("code"))


def decode(codes: DataFrame, dictionary: DataFrame, value: str, code: str = "code") -> DataFrame:
    """``codes`` with the dictionary's values; an empty string for a code that it does not hold."""
    return codes.join(dictionary.select(code, value), code, "left").withColumn(value, F.coalesce(value, F.lit("")))


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): n rows drawn uniformly, each from all rows. Rows are numbered by a range sort, so nothing meets in one task; draws are hashed numbers."""
    total = df.count()
    if not total:
        return df.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("place"))
    return draws.join(numbered(df.select(key), key), "place").select("draw", key)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, its row's number from 0 in ascending order: rows are range-sorted, and counts of the ranges before are added to the place within one."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def sample_without_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def validate(df: DataFrame) -> DataFrame:
    """Rows with a component that is not finite, and rows whose norm is not 1 within 0.01."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(F.abs(V.norm(F.col("embedding")) - 1) > 0.01).alias("not_unit"))


def quartile_rates(df: DataFrame, value: str, event: Column) -> DataFrame:
    """Rows and the rate of ``event`` in each quartile of ``value``; edges by interpolation, intervals closed on the right."""
    edges = quantiles(df, value, [0.25, 0.5, 0.75])
    quartile = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges if e is not None), F.lit(1))
    return df.groupBy(quartile.cast("int").alias("quartile")).agg(F.count("*").alias("n"), F.avg(event.cast("double")).alias("rate"))


def series(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and middle half of a value by key; infinite values count as absent."""
    v = F.when(F.abs(F.col(value)) != float("inf"), F.col(value))
    return df.groupBy(key).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"))


def threshold_counts(df: DataFrame) -> DataFrame:
    """Per query: candidates within d_k by exact distance, by each estimate and by both, SafeIn, and the share of exact distances at most d_k. ``df``: qid, true, est, est2, margin2, d_k."""
    t, a, b, d_k = (F.col(c) for c in ("true", "est", "est2", "d_k"))
    return df.groupBy("qid").agg(F.count_if(t < d_k).alias("true_below"), F.count_if(a < d_k).alias("est_below"), F.count_if(b < d_k).alias("est2_below"), F.count_if((t < d_k) & (b < d_k)).alias("both_below"), F.count_if(b < d_k - 2 * F.col("margin2")).alias("safein"), F.avg((t <= d_k).cast("double")).alias("share"))


def space_comparison(df: DataFrame) -> DataFrame:
    """Per query: SafeIn and false SafeIn by the stage-2 estimate, under the threshold of exact distances and under that of estimates. ``df``: qid, est2, margin2, d_k, safein_d_k, is_true."""
    inside = {name: F.col("est2") < F.col(c) - 2 * F.col("margin2") for name, c in (("exact", "d_k"), ("estimate", "safein_d_k"))}
    return df.groupBy("qid").agg(*(F.count_if(x).alias(f"safein_{n}") for n, x in inside.items()), *(F.count_if(x & ~F.col("is_true")).alias(f"false_{n}") for n, x in inside.items()))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """How many items of ``a`` are in ``b`` too, per key."""
    both = a.select(*keys, item).join(b.select(*keys, item).withColumn("hit", F.lit(1)), [*keys, item], "left")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count("hit").alias("shared"))
