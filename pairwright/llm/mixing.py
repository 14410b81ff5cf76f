"""Mixing sources to target weights (1). DataFrame functions only.

1. ``plan_mix`` gives each source its target: shares by weight, at most ``most`` times its size, the
   excess shared again by weight.
2. ``pack`` lays the documents of a source end to end in a fixed pseudorandom order and cuts the words
   into blocks of fixed length (a running total over a tree of buckets; no task holds a source).
3. ``draw_slots`` fills the output shards. A source has as many slots as its target asks for, to the
   nearest block. Every shard gets the whole part of a source's slots per shard; the shards of the
   slots that are left are drawn, so a shard's counts by source are that plus a multinomial draw,
   while the totals meet the targets at every size.
4. The j-th slot of a source takes the block at index ``permutation(j mod n)`` of its n blocks. A pass
   uses every block once, so no block and no document is used more often than there are passes.
5. Slots and blocks are joined by source and index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.common import WORD, fraction, prefix_sums, stash, words_in

ROUNDS = 12


def plan_mix(totals: DataFrame, share: float, most: float, block: int) -> DataFrame:
    """``totals``: source, source_size, weight, source_no. Adds target, block_len and n_blocks.

    Targets sum to ``share`` times all sizes; the level of the weights is found by rounds of two sums,
    until no unsaturated source is above ``most`` times its size. A source of less than 256 blocks gets
    shorter blocks (down to one word), so that its target can be met.
    """
    cap = F.col("source_size") * F.lit(float(most))
    goal = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = cap < F.col("weight") * level
        done, weight, n = totals.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if n == full or not weight:
            break
        full, level = n, (goal - done) / weight
    target = F.least(cap, F.col("weight") * F.lit(float(level)))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 256))).cast("long")
    return totals.withColumn("target", target).withColumn("block_len", length).withColumn(
        "n_blocks", F.ceil(F.col("source_size") / F.col("block_len")).cast("long")
    )


def draw_slots(plan: DataFrame, per_shard: int, most: float, seed: int) -> DataFrame:
    """shard, slot, source_no, index: which block of which source fills each slot of each output shard.

    Shards have about ``per_shard`` slots. Slot numbers are unique in a shard, not without gaps.
    """
    spark = plan.sparkSession
    asked = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    asked = F.least(F.round(asked), F.col("n_blocks") * F.lit(float(most))).cast("long")
    total = plan.agg(F.sum(asked)).first()[0] or 0
    shards = max(1, round(total / per_shard))
    in_order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    base = stash(
        plan.select("source_no", "n_blocks", F.floor(asked / shards).alias("_base"), (asked % shards).alias("_left"))
        .withColumn("_first", F.coalesce(F.sum("_base").over(in_order), F.lit(0)))
        .withColumn("_low", F.coalesce(F.sum("_left").over(in_order), F.lit(0))),
        "shares",
    )
    n_base, n_left, n_sources = base.agg(F.sum("_base"), F.sum("_left"), F.count(F.lit(1))).first()
    n_base, n_left = n_base or 0, n_left or 0
    # The whole parts: position in the shard -> source and how many of its slots come before.
    fixed = base.where("_base > 0").select(
        "source_no", "n_blocks", "_base", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_base") - 1)).alias("_i")
    )
    fixed = fixed.withColumn("slot", F.col("_first") + F.col("_i"))
    whole = spark.range(shards * n_base).select(F.floor(F.col("id") / n_base).alias("shard"), (F.col("id") % n_base).alias("slot"))
    whole = whole.join(fixed, "slot").select(
        "shard", "slot", "source_no", "n_blocks", (F.col("shard") * F.col("_base") + F.col("_i")).alias("_j")
    )
    # What is left: numbers in a row, cut into cells; a cell lists the sources whose numbers reach into it.
    width = max(1, n_left // (4 * max(n_sources, 1)))
    reach = F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_low") + F.col("_left") - 1) / width))
    cells = base.where("_left > 0").select("source_no", "n_blocks", "_base", "_low", "_left", F.explode(reach).alias("_cell"))
    drawn = spark.range(n_left).withColumn("_cell", F.floor(F.col("id") / width)).join(cells, "_cell")
    drawn = drawn.where((F.col("id") >= F.col("_low")) & (F.col("id") < F.col("_low") + F.col("_left"))).select(
        F.floor(fraction(F.lit(seed), F.col("id")) * shards).alias("shard"),
        (F.col("id") + n_base).alias("slot"),
        "source_no", "n_blocks", (F.col("_base") * shards + F.col("id") - F.col("_low")).alias("_j"),
    )
    used = whole.unionByName(drawn)
    block = permuted(F.col("_j") % F.col("n_blocks"), F.col("n_blocks"), F.col("source_no"), seed)
    return used.select("shard", "slot", "source_no", block.alias("index"))


def permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    """Map x (0 .. n-1) through a pseudorandom permutation of 0 .. n-1 fixed by key and seed.

    Swap-or-not: each round pairs x with (k - x) mod n and swaps the pair by a bit of a hash of its
    larger member, so it is a permutation for every n.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, key), n) - x, n)
        bit = F.xxhash64(r, F.lit(seed), key, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def pack(sized: DataFrame, plan: DataFrame, bucket_rows: int, rows: int, seed: int, with_text: bool) -> DataFrame:
    """Each document with its place in its source (``first``) and its pieces: (index, from, to[, text])."""
    buckets = max(1, math.ceil(rows / bucket_rows))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets))
    placed = prefix_sums(sized, ["source_no"], ["doc_id", "size"], "size", place, buckets)
    placed = placed.withColumnRenamed("_before", "first").drop("_total")
    placed = placed.join(plan.select("source_no", "source", "source_size", "target", "block_len"), "source_no")
    end = F.col("first") + F.col("size")
    words = [F.regexp_extract_all("text", F.lit(WORD), 0)] if with_text else []

    def piece(b: Column) -> Column:
        low = F.greatest(b * F.col("block_len"), F.col("first")) - F.col("first")
        high = F.least((b + 1) * F.col("block_len"), end) - F.col("first")
        text = [F.array_join(F.slice(w, (low + 1).cast("int"), (high - low).cast("int")), " ").alias("text") for w in words]
        return F.struct(b.alias("index"), low.alias("from"), high.alias("to"), *text)

    blocks = F.sequence(F.floor(F.col("first") / F.col("block_len")), F.floor((end - 1) / F.col("block_len")))
    pieces = F.when(F.col("size") > 0, F.transform(blocks, piece))
    return placed.withColumn("_pieces", pieces)


def mix(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    block: int = 64, per_shard: int = 4096, bucket_rows: int = 256, seed: int = 20_260_101, with_text: bool = False,
) -> dict[str, DataFrame]:
    """Mix ``docs`` (doc_id, source, text): sources by code point, null last, get ``weights`` in turn.

    ``plan``: one row per source. ``documents``: doc_id, source_no, size, first, source_size, target.
    ``blocks``: one row per slot and piece of its block: shard, slot, source_no, index, doc_id, first,
    from, to (words of the document, end exclusive) and, on request, text.
    Sizes count ``WORD``; null and blank texts have size 0 and are in no block. Rows that repeat a doc_id
    count one by one. A null source is a source. Empty tables give empty results. Only the three columns
    are read. The plan holds a row per source of the mix and is ordered in one task; documents and
    slots never are.
    """
    text = [F.col("text")] if with_text else []
    sized = stash(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), *text), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = stash(by_source.withColumn("source_no", number).withColumn("weight", weight), "totals")
    rows = totals.agg(F.sum("_rows")).first()[0] or 0
    plan = stash(plan_mix(totals.drop("_rows"), share, most, block), "plan")
    named = plan.select(F.col("source").alias("_source"), "source_no")
    sized = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    placed = pack(sized, plan, bucket_rows, rows, seed, with_text)
    slots = draw_slots(plan, per_shard, most, seed)
    pieces = placed.select("source_no", "doc_id", "first", "size", F.inline("_pieces"))
    return {
        "plan": plan,
        "documents": placed.drop("_pieces", "text"),
        "blocks": slots.join(pieces, ["source_no", "index"]),
    }


def taken_words(mixed: dict[str, DataFrame]) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words of it in the mix, with repeats)."""
    used = mixed["blocks"].groupBy("source_no", "first", "size").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    rows = mixed["documents"].join(used, ["source_no", "first", "size"], "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
