"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.session import shared_folder

#: White space and words as every contract of this subpackage reads them (fixed values).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share."""
    return shared_folder(spark)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it from there.

    This cuts the lineage: a lost executor costs the tasks it was running, not the jobs before.
    The tables stay until the owner of the folder clears it, like Spark's own checkpoints.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/stash-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front of those that ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def words_in(text: Column) -> Column:
    """Number of ``WORD`` in a text as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(*cols: Column | str) -> Column:
    """A fixed pseudorandom number in [0, 1) for the given values (53 bits of xxhash64)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def prefix_sums(
    rows: DataFrame, keys: list[str], order: list[str], value: str, index: Column, buckets: int, fanout: int = 512
) -> DataFrame:
    """Running total of ``value`` before each row within its key, and the key's total.

    ``index`` deals the rows of a key to ``buckets`` buckets (0 .. buckets-1), which come one after
    another; inside a bucket ``order`` decides. Keys are not null. Bucket totals are summed up a tree of ``fanout``
    children per node, so that no task holds more than a bucket or a node's children of a key,
    however many rows the key has. Adds ``_before`` and ``_total`` (long).
    """
    level = rows.withColumn("_b", index.cast("long"))
    by = [F.col(k) for k in keys]
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    sums = rows.groupBy(*by, index.cast("long").alias("_b")).agg(F.sum(value).cast("long").alias("_v"))
    heights = max(1, math.ceil(math.log(max(buckets, 2), fanout)))
    tree = [sums]
    for _ in range(heights):
        tree.append(
            tree[-1].groupBy(*by, F.floor(F.col("_b") / fanout).alias("_b")).agg(F.sum("_v").cast("long").alias("_v"))
        )
    totals = tree[-1].groupBy(*by).agg(F.sum("_v").cast("long").alias("_total"))
    above = tree[-1].join(totals, keys).select(*keys, "_b", F.lit(0).cast("long").alias("_start"), "_total")
    for lower in reversed(tree[:-1]):
        siblings = Window.partitionBy(*keys, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        lower = lower.withColumn("_p", F.floor(F.col("_b") / fanout)).withColumn(
            "_off", F.coalesce(F.sum("_v").over(siblings), F.lit(0))
        )
        above = lower.join(above.withColumnRenamed("_b", "_p"), [*keys, "_p"]).select(
            *keys, "_b", (F.col("_start") + F.col("_off")).alias("_start"), "_total"
        )
    out = level.join(above, [*keys, "_b"])
    return out.select(*rows.columns, (F.col("_before") + F.col("_start")).alias("_before"), "_total")


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], row_id: str, size: str, total: int, hot: int = 2000) -> DataFrame:
    """Inner join of ``rows`` with their group; ``groups`` has one row per key and the group's size.

    The rows of a group of at least ``hot`` rows and a thousandth of ``total`` are dealt over several
    copies of the group's row. There are at most a thousand such groups, so their list is broadcast.
    """
    copies = F.ceil(F.col(size) / hot).cast("int")
    wide = (F.col(size) > hot) & (F.col(size) * 1000 >= total)
    if total > hot:
        listed = groups.where(wide).select(*keys, copies.alias("_copies"))
        rows = rows.join(F.broadcast(listed), keys, "left")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
        groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(wide, copies - 1).otherwise(0))))
        keys = [*keys, "_salt"]
    return rows.join(groups, keys).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Alternating large-star and small-star steps on the edge table; every step is written to the shared
    folder, and only a count and a checksum reach the driver.
    """
    edges = stash(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("_m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("_m").alias("v")
        )
        edges = stash(small.distinct(), "edges")
