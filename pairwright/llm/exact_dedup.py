"""Exact dedup (10) with an extendible-hash index in the shared folder. DataFrame functions only.

1. Every text is normalised and hashed (64 bits). Rows are grouped by (hash, normalised bytes), which
   compares bytes; copies collapse before the shuffle, so a group of any size costs a row per task.
2. The directory starts with one bit per ``capacity`` keys and doubles while a bucket holds more than
   ``capacity`` keys: only the overfull buckets are split by one more bit of the hash.
3. The index is written by key range: an owner task holds consecutive buckets, sorted by hash; equal
   hashes of different bytes form a chain.
4. Each row looks its group up: the directory slot of its hash gives the bucket, the bucket's entries are
   searched by hash and along the chain by the digest of the bytes. Groups of more than ``hot`` rows are
   dealt over several copies of their index entry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.common import SPACE, spread_join, stash

#: Above every id; the step between two lengths in the rank.
_LAST = Decimal(1 << 63)
_STEP = Decimal(10) ** 20


def normalised(text: Column) -> Column:
    """The text without any white space of ``SPACE``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


@dataclass(frozen=True)
class Index:
    """``entries``: bucket, depth, hash, chain, digest, keep_id, keep_chars, group_size, one row per distinct text, written by
    key range; ``slots``: _slot, bucket, depth, the directory of ``bits`` bits."""

    entries: DataFrame
    slots: DataFrame
    bits: int

    def buckets_of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (hash, ...) with the bucket that the directory names for their hash."""
        slotted = rows.withColumn("_slot", _slot(F.col("hash"), self.bits))
        return slotted.join(self.slots.select("_slot", "bucket"), "_slot").drop("_slot")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """The entries of the index of ``docs``."""
    return index_of(docs, id_col, text_col, capacity).entries


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> Index:
    """The index of all distinct texts with its directory.

    The row that stays has the most code points in its original text, then the smallest id (a whole number); a null
    id comes after all others. An empty table gives an empty index.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Both criteria in one number, so that the groups are aggregated in hash maps on the map side.
    rank = F.length(text).cast("decimal(12,0)") * F.lit(_STEP) + F.coalesce(
        F.lit(_LAST) - F.col(id_col).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
    )
    groups = (
        docs.select(normalised(F.col(text_col)).alias("_norm"), rank.cast("decimal(38,0)").alias("_rank"))
        .groupBy(F.xxhash64("_norm").alias("hash"), "_norm")
        .agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("group_size"))
    )
    ident = F.col("_rank") % F.lit(_STEP)
    entries = stash(
        groups.select(
            "hash",
            F.sha2("_norm", 256).alias("digest"),
            F.when(ident != 0, F.lit(_LAST) - ident).cast("long").alias("keep_id"),
            F.floor(F.col("_rank") / F.lit(_STEP)).cast("long").alias("keep_chars"),
            "group_size",
        ),
        "entries",
    )
    n = entries.count()
    found = directory(entries.select("hash"), n, capacity)
    slots = stash(found["slots"], "directory")
    placed = entries.withColumn("_slot", _slot(F.col("hash"), found["bits"])).join(slots, "_slot").drop("_slot")
    owners = max(1, min(math.ceil(n / (16 * capacity)), 10_000))
    chain = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest")) - 1
    placed = placed.withColumn("chain", chain).repartitionByRange(owners, "bucket").sortWithinPartitions("bucket", "hash")
    return Index(stash(placed, "index"), slots, found["bits"])


def directory(hashes: DataFrame, n: int, capacity: int) -> dict:
    """``bits``: global depth; ``slots``: one row per directory slot that is in use (_slot, bucket, depth).

    A bucket is named by its first slot. Doubling ends when no bucket is overfull or when all 64 bits
    are in use; what is then left in a bucket are equal hashes, which chain.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / capacity)))
    start = bits
    while True:
        bits = min(bits + 3, 64)  # three doublings are tried at once
        full = hashes.groupBy(_slot(F.col("hash"), bits).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
        depth, bucket, over = F.lit(bits), F.col("_slot"), F.col("_n") > capacity
        sizes = full
        for d in range(bits - 1, start - 1, -1):
            top = F.shiftrightunsigned("_slot", bits - d) if d else F.lit(0).cast("long")
            name = f"_n{d}"
            sizes = sizes.withColumn(f"_p{d}", top).withColumn(name, F.sum("_n").over(Window.partitionBy(f"_p{d}")))
            fits = F.col(name) <= capacity
            depth = F.when(fits, F.lit(d)).otherwise(depth)
            bucket = F.when(fits, F.shiftleft(f"_p{d}", bits - d)).otherwise(bucket)
        slots = sizes.select("_slot", bucket.alias("bucket"), depth.alias("depth"), over.alias("_over"))
        if bits == 64 or slots.where("_over").isEmpty():
            return {"bits": bits, "slots": slots.drop("_over")}


def _slot(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hot: int = 2000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; texts of white space alone equal the empty text. Ids are whole numbers; rows that repeat
    an id share its decision. Other columns of ``docs`` are not read. Empty in, empty out.
    """
    return look_up(docs, index_of(docs, id_col, text_col, capacity), id_col, text_col, hot)


def look_up(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", hot: int = 2000) -> DataFrame:
    """The rows of ``docs`` that the index finds, as ``dedup`` returns them."""
    total = index.entries.agg(F.sum("group_size")).first()[0] or 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_chars"), norm.alias("_norm")).select(
        "_id", "_chars", F.xxhash64("_norm").alias("hash"), F.sha2("_norm", 256).alias("digest")
    )
    entries = index.entries.select("bucket", "hash", "digest", "keep_id", "keep_chars", "group_size")
    return spread_join(index.buckets_of(rows), entries, ["bucket", "hash", "digest"], "_id", "group_size", total, hot).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
