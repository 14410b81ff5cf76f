"""Seeded, reproducible sampling and ordering (K1-K4, K6).

Order keys are ``md5(seed, row values)`` so the same seed always draws the
same rows, any engine with ``md5`` can reproduce the draw, and keys are
uniform.  ``first_n_by_hash`` takes exactly the ``n`` rows with the smallest
keys without a global sort into one task: it descends the hex digits of the
keys four at a time, each time with a histogram of at most 65,536 counts,
until the cut falls between two prefixes; identical rows, which share a whole
key, are taken by count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "\u0001"


def hash_key(seed: int | str, cols: Sequence[str]) -> Column:
    """``md5`` over the seed and the values as text, each with its length; null is a value of its own."""
    def part(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("null"))
    return F.md5(F.concat_ws(SEP, F.lit(str(seed)), *[part(c) for c in cols]))


# K1
def sample_per_group(df: DataFrame, group: str, value: str, n: int, seed: int | str = 0) -> DataFrame:
    """Up to ``n`` distinct values per group, then the distinct union of the draws.

    ``row_number() <= n`` is planned with a partial per-partition group limit
    before the shuffle, so a hot group sends at most ``n`` rows per partition."""
    distinct = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    w = Window.partitionBy(group).orderBy(hash_key(seed, [value]), value)
    drawn = distinct.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return drawn.select(value).distinct()


DIGITS = 4


def _histogram(keyed: DataFrame, key: str, prefix: str, copies: str | None = None) -> list[tuple[str, int]]:
    """Counts by the next digits of the keys that start with ``prefix`` (at most 65,536), in order; a row counts
    as often as its column ``copies`` says."""
    width = len(prefix) + DIGITS
    rows = keyed.where(F.substring(key, 1, len(prefix)) == prefix) if prefix else keyed
    counted = rows.groupBy(F.substring(key, 1, width)).agg(F.count(F.lit(1)) if copies is None else F.sum(copies))
    return sorted((r[0], r[1]) for r in counted.collect() if r[1])


def _cut(keyed: DataFrame, key: str, n: int, hist: list[tuple[str, int]],
         copies: str | None = None) -> tuple[str, int, int]:
    """The prefix up to whose keys the first ``n`` rows reach, how many rows have it and how many of these are taken:
    all, or some of those with one whole key."""
    left = n
    while True:
        for prefix, count in hist:
            if count >= left:
                break
            left -= count
        if count == left or len(prefix) == 32:
            return prefix, count, left
        hist = _histogram(keyed, key, prefix, copies)


# K2/K4 core
def first_n_by_hash(df: DataFrame, n: int, seed: int | str = 0,
                    first: list[tuple[str, int]] | None = None) -> DataFrame:
    """Exactly ``min(n, count)`` rows: those with the smallest hash keys.

    The key hashes every column, so rows tied on it are identical and are
    taken by count.  ``first`` is the histogram of the first digits, if known."""
    h = "_sample_key"
    keyed = df.withColumn(h, hash_key(seed, df.columns))
    hist = _histogram(keyed, h, "") if first is None else first
    if n >= sum(c for _, c in hist):
        return df
    if n <= 0:
        return df.limit(0)
    prefix, count, left = _cut(keyed, h, n, hist)
    if count == left:
        return keyed.where(F.substring(h, 1, len(prefix)) <= prefix).drop(h)
    one = keyed.where(F.col(h) == prefix).dropDuplicates([h])
    copies = df.sparkSession.range(left).select(F.lit(prefix).alias(h)).join(F.broadcast(one), h)
    return keyed.where(F.col(h) < prefix).select(*df.columns).unionByName(copies.select(*df.columns))


# K2
def balance_samples(a: DataFrame, b: DataFrame, seed: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to ``min(|a|, |b|)`` rows by seeded hash order."""
    key = "_sample_key"
    hists = [_histogram(d.select(hash_key(seed, d.columns).alias(key)), key, "") for d in (a, b)]
    n = min(sum(c for _, c in hist) for hist in hists)
    return tuple(first_n_by_hash(d, n, seed, hist) for d, hist in zip((a, b), hists))


def balance_copies(df: DataFrame, key: str, sides: tuple[str, str]) -> DataFrame:
    """``balance_samples`` of two sides in one frame of distinct rows: ``sides`` are columns with the number of
    copies of a row on either side, ``key`` holds its ``hash_key``. Rows of which a side keeps a copy remain."""
    hists = [_histogram(df, key, "", side) for side in sides]
    totals = [sum(c for _, c in hist) for hist in hists]
    n = min(totals)
    if n == 0:
        return df.limit(0)
    kept = F.lit(False)
    for side, hist, total in zip(sides, hists, totals):
        taken = F.col(side) > 0
        if n < total:
            prefix, _, _ = _cut(df, key, n, hist, side)
            taken &= F.substring(key, 1, len(prefix)) <= prefix
        kept |= taken
    return df.where(kept)


# K3
def seeded_shuffle(df: DataFrame, seed: int | str = 1, key_cols: Sequence[str] | None = None,
                   out: str = "shuffle_key") -> DataFrame:
    """Seeded permutation: a range-partitioned global sort on the hash key. Rows with equal keys are equal in
    ``key_cols``, so these stay out of the sort; the driver would be sent whole texts to find its ranges."""
    cols = list(key_cols) if key_cols else list(df.columns)
    return df.withColumn(out, hash_key(seed, cols)).orderBy(out)


# K4
def sample_max(df: DataFrame, n: int | None, seed: int | str = 0) -> DataFrame:
    """At most ``n`` rows (all rows when there are fewer)."""
    if n is None:
        return df
    return first_n_by_hash(df, n, seed)


# K6
def order_worklist(originals: DataFrame, selected: DataFrame, seed: int | str = 0,
                   col: str = "original") -> DataFrame:
    """Selected originals first, then the rest, each part in seeded random order."""
    flagged = originals.join(selected.select(col).distinct().withColumn("is_selected", F.lit(True)),
                             col, "left").withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
    return (flagged.withColumn("order_key", hash_key(seed, [col]))
                   .orderBy(F.col("is_selected").desc(), "order_key", col))
