"""Summaries (A5, A6, A8-A10): describe, per-cluster describe, mean profiles.

Quantiles are exact (linear interpolation between order statistics, the
pandas ``describe`` convention) yet never gather a column into one task:
``percentile_approx`` brackets each needed rank, one aggregate counts the
values below and inside each bracket, and brackets are narrowed the same way
until one holds at most ``FETCH`` values or a single one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DESCRIBE_PROBS = (0.25, 0.5, 0.75)
DESCRIBE_COLUMNS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


ACCURACY = 10_000
FETCH = 10_000


class _Bracket:
    """Values from ``low`` to ``high``, among them the order statistics ``ranks``; ``below`` values are smaller."""

    def __init__(self, ranks, low=None, high=None, below=0, inside=0):
        self.ranks, self.low, self.high, self.below, self.inside = ranks, low, high, below, inside

    def holds(self):
        cond = F.lit(True)
        if self.low is not None:
            cond = cond & (F.col("v") >= F.lit(self.low))
        if self.high is not None:
            cond = cond & (F.col("v") <= F.lit(self.high))
        return cond

    def narrowed(self, values: DataFrame) -> list:
        """Brackets for the ranks' parts: an approximate percentile gives two values around the ranks; what is
        below, equal to, between and above them are brackets of their own, so every step gets on."""
        slack = 2 / ACCURACY
        first, last = (r - self.below for r in (min(self.ranks), max(self.ranks)))
        probs = [max(0.0, first / self.inside - slack), min(1.0, (last + 1) / self.inside + slack)]
        here = values.where(self.holds())
        low, high = here.agg(F.percentile_approx("v", probs, ACCURACY)).first()[0]
        v = F.col("v")
        parts = [v < low, v == low, (v > low) & (v < high), v == high, v > high]
        if low == high:
            parts[3] = F.lit(False)
        found = here.agg(*[f(F.when(p, v)) for p in parts for f in (F.count, F.min, F.max)]).first()
        out, at = [], self.below
        for k in range(len(parts)):
            n, lo, hi = found[3 * k:3 * k + 3]
            ranks = [r for r in self.ranks if at <= r < at + n]
            if ranks:
                out.append(_Bracket(ranks, lo, hi, at, n))
            at += n
        return out

    def fetched(self, values: DataFrame) -> dict[int, float]:
        """The order statistics from the values inside, of which there are at most ``FETCH``."""
        rows = values.where(self.holds()).groupBy("v").count().collect()
        found, at = {}, self.below
        for v, c in sorted(map(tuple, rows)):
            found.update({r: float(v) for r in self.ranks if at <= r < at + c})
            at += c
        return found


def _order_statistics(values: DataFrame, n: int, ranks: Sequence[int]) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of column ``v`` (n non-null rows)."""
    todo = [_Bracket([r], inside=n) for r in sorted(set(ranks))] if n > FETCH else [
        _Bracket(sorted(set(ranks)), inside=n)]
    result: dict[int, float] = {}
    while todo:
        bracket = todo.pop()
        if bracket.low is not None and bracket.low == bracket.high:
            result.update({r: float(bracket.low) for r in bracket.ranks})
            continue
        if bracket.inside <= FETCH:
            result.update(bracket.fetched(values))
        else:
            todo += bracket.narrowed(values)
    return result


def _numbers(df: DataFrame, col: str) -> DataFrame:
    """Column ``v``: the values that are numbers. It comes out of a generator, through which Catalyst doesn't push
    the filter, so that what computes ``col`` is evaluated once a row."""
    values = df.select(F.explode(F.array(F.col(col).cast("double"))).alias("v"))
    return values.where(F.col("v").isNotNull() & ~F.isnan(F.col("v")))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> tuple[int, list[float | None]]:
    values = _numbers(df, col)
    return _quantiles(values, values.count(), probs)


def _quantiles(values: DataFrame, n: int, probs: Sequence[float]) -> tuple[int, list[float | None]]:
    if n == 0:
        return 0, [None for _ in probs]
    ends = [(math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1), (n - 1) * p) for p in probs]
    stats = _order_statistics(values, n, [r for lo, hi, _ in ends for r in (lo, hi)])
    return n, [stats[lo] + (h - lo) * (stats[hi] - stats[lo]) for lo, hi, h in ends]


# A5
def describe(df: DataFrame, col: str, spark: SparkSession | None = None) -> DataFrame:
    """One row: count, mean, sample std, min, 25/50/75 % (linear), max."""
    spark = spark or df.sparkSession
    # several passes follow: keep the one projected column, not the upstream plan
    values = _numbers(df, col).persist()
    try:
        n, mean, std, low, high = values.agg(
            F.count("v"), F.avg("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
        _, (p25, p50, p75) = _quantiles(values, n, DESCRIBE_PROBS)
    finally:
        values.unpersist()
    row = (int(n), mean, std, low, p25, p50, p75, high)
    return spark.createDataFrame(
        [row], "count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


# A6
def cluster_means(df: DataFrame, col: str = "score", key: str = "cluster") -> DataFrame:
    return df.groupBy(key).agg(F.avg(col).alias(col))


def describe_by_cluster(df: DataFrame, col: str = "score", key: str = "cluster") -> DataFrame:
    """Mean per cluster, then ``describe`` over the means."""
    return describe(cluster_means(df, col, key), col)


# A8
def mean_profile(df: DataFrame, scores: str = "scores", k: int = 16) -> DataFrame:
    """Element-wise mean of a fixed-length score array: one global aggregate
    with ``k`` averages (partial aggregation, no shuffle of the arrays)."""
    return df.agg(F.array(*[F.avg(F.col(scores)[i]) for i in range(k)]).alias("mean_scores"))


# A9
def profile_report(df: DataFrame, targets: Sequence[float], scores: str = "scores") -> DataFrame:
    """``(ref_id, target, mean)`` per reference (ids start at 1)."""
    k = len(targets)
    prof = mean_profile(df, scores, k)
    tgt = F.array(*[F.lit(float(t)) for t in targets])
    return prof.select(F.posexplode(F.arrays_zip(tgt.alias("target"), F.col("mean_scores").alias("mean")))
                       .alias("pos", "z")).select(
        (F.col("pos") + 1).alias("ref_id"), F.col("z.target").alias("target"), F.col("z.mean").alias("mean"))


# A10
def group_variations(variations: DataFrame) -> DataFrame:
    """``original -> [variation, ...]`` in position order (nulls dropped).

    A list holds one entry per variation instruction, so its size is bounded
    by the instruction count."""
    v = variations.where(F.col("variation").isNotNull())
    return v.groupBy("original").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "variation"))),
                    lambda s: s["variation"]).alias("variations"))
