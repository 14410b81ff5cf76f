"""Duplicates, distinct values, counts and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# A1
def distinct_rows(df: DataFrame, side: str | None = None, sides: Sequence = ()) -> DataFrame:
    """Every row once. With ``side``, a column that says where a row is from, rows that are equal but for it
    become one, with the number of them from each of ``sides`` as ``<side>_<value>``."""
    if side is None:
        return df.dropDuplicates()
    copies = [F.count_if(F.col(side) == F.lit(v)).alias(f"{side}_{v}") for v in sides]
    return df.groupBy(*[c for c in df.columns if c != side]).agg(*copies)


# A2
def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order`` tuple.

    An aggregate (``min_by``) instead of a ranking window: partial
    aggregation collapses a hot key on the map side, so no task ever holds a
    whole key group."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order_key = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order_key).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


# A3
def unique_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# A4
def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


# U1
def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
