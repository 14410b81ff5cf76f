"""Lookups, semi/anti joins and fan-outs.

Sides whose size is fixed by construction (literal instruction or model
lists) are expanded with ``explode`` of a literal array, not joined.  Sides
derived from data are left to the planner: adaptive execution broadcasts
them when their measured size is under ``autoBroadcastJoinThreshold`` and
falls back to a shuffle join otherwise, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed_values as FV
from ..session import written


# J1, J2
def assign_split(df: DataFrame, splits: DataFrame, default: str | None = None,
                 key: str = "cluster", out: str = "split") -> DataFrame:
    """Left lookup of the split of each row's cluster; unmatched -> ``default``."""
    lookup = splits.select(F.col(key), F.col("split").alias(out))
    joined = df.join(lookup, key, "left")
    if default is not None:
        joined = joined.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return joined


# J3
def remove_leaks(df: DataFrame, *train_frames: DataFrame, on: str = "original_text",
                 asked: DataFrame | None = None) -> DataFrame:
    """Drop rows whose ``on`` value occurs in any of ``train_frames``.

    ``asked`` is ``df`` as the search for leaks reads it (by default ``df`` itself); it and ``train_frames`` may
    hold the SHA-256 (binary) of the texts in ``on``."""
    keys = None
    for t in train_frames:
        k = t.where(F.col(on).isNotNull()).select(_digest(t, on).alias(on))
        keys = k if keys is None else keys.unionByName(k)
    if keys is None:
        return df
    if not isinstance(df.schema[on].dataType, StringType):
        return df.join(keys.distinct(), on, "left_anti")
    # SHA-256 stands for the text, and only values on both sides are joined: few as a rule, so that rows needn't move
    key, seen, found_in = "_leak_key", "_leak_seen", "_leak_asked"
    asked = df if asked is None else asked
    both = keys.select(F.col(on).alias(key), F.lit(True).alias(seen)).unionByName(
        asked.where(F.col(on).isNotNull()).select(_digest(asked, on).alias(key), F.lit(False).alias(seen)))
    found = both.groupBy(key).agg(F.bool_or(seen).alias(seen), F.bool_or(~F.col(seen)).alias(found_in))
    leaked = written(found.where(F.col(seen) & F.col(found_in)).select(key), "leaked")
    return df.withColumn(key, _digest(df, on)).join(leaked, key, "left_anti").select(on, *[c for c in df.columns if c != on])


def _digest(df: DataFrame, col: str) -> Column:
    """SHA-256 of a text column (binary); other columns as they are."""
    return F.unhex(F.sha2(F.col(col), 256)) if isinstance(df.schema[col].dataType, StringType) else F.col(col)


def train_keys(df: DataFrame, on: str = "original_text", split_col: str = "split",
               train: str = FV.DEFAULT_SPLIT) -> DataFrame:
    return df.where(F.col(split_col) == F.lit(train)).select(on)


# U2 + J4
def known_prompt_set(variations: DataFrame, original: str = "original",
                     variation: str = "variation", out: str = "prompt") -> DataFrame:
    """Distinct map keys and list values of a long-form variation map."""
    keys = variations.select(F.col(original).alias(out))
    vals = variations.select(F.col(variation).alias(out))
    return keys.unionByName(vals).where(F.col(out).isNotNull()).distinct()


def keep_known_prompts(df: DataFrame, variations: DataFrame, col: str = "rewrite_prompt") -> DataFrame:
    known = known_prompt_set(variations, out=col)
    return df.join(known, col, "left_semi")


# J5
def keep_frequent(df: DataFrame, key: str = "original_text",
                  min_count: int = FV.MIN_ROWS_PER_ORIGINAL) -> DataFrame:
    """Keep rows whose ``key`` occurs at least ``min_count`` times.

    Counting is a partial (map-side) aggregate, so a hot key never gathers
    its rows in one task; the semi join is split by adaptive skew handling."""
    frequent = (df.where(F.col(key).isNotNull()).groupBy(key).count()
                  .where(F.col("count") >= F.lit(min_count)).select(key))
    return df.join(frequent, key, "left_semi")


# J6
def expand_variations(pairs: DataFrame, variations: DataFrame) -> DataFrame:
    """Each pair whose prompt is an original, once per non-null variation."""
    v = variations.where(F.col("variation").isNotNull()).select(
        F.col("original").alias("rewrite_prompt"), "pos", "variation")
    joined = pairs.join(v, "rewrite_prompt", "inner")
    rest = [c for c in pairs.columns if c != "rewrite_prompt"]
    return joined.select(*rest, F.col("variation").alias("rewrite_prompt"),
                         F.col("rewrite_prompt").alias("parent_prompt"), "pos")


# J7 (+ A7)
def prompt_cluster(pairs: DataFrame, order: str = "id") -> DataFrame:
    """``prompt -> cluster``; for a prompt in several clusters the pair whose
    first occurrence comes last wins (dict built over distinct pairs)."""
    firsts = (pairs.where(F.col("cluster").isNotNull())
                   .groupBy("rewrite_prompt", "cluster").agg(F.min(order).alias("_first")))
    return firsts.groupBy("rewrite_prompt").agg(
        F.max_by("cluster", "_first").alias("cluster"))


def cluster_prompts(pairs: DataFrame, variations: DataFrame, order: str = "id") -> DataFrame:
    """Distinct ``(cluster, prompt)``: each cluster's prompts plus the
    variations of prompts mapped to that cluster."""
    base = pairs.select("cluster", F.col("rewrite_prompt").alias("prompt")).where(
        F.col("cluster").isNotNull() & F.col("prompt").isNotNull())
    mapped = prompt_cluster(pairs, order).withColumnRenamed("rewrite_prompt", "original")
    added = (variations.where(F.col("variation").isNotNull())
             .join(mapped, "original", "inner")
             .select("cluster", F.col("variation").alias("prompt")))
    return base.unionByName(added).distinct()


# J8
def pending_by_id(inputs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


# J9
def pending_originals(prompts: DataFrame, variations: DataFrame, col: str = "rewrite_prompt",
                      retry_incomplete: bool = False,
                      expected: int = FV.VARIATIONS_PER_PROMPT) -> DataFrame:
    """Distinct prompts that have no entry in the variation map yet.

    With ``retry_incomplete`` prompts with fewer than ``expected`` non-null
    variations run again."""
    todo = prompts.select(col).where(F.col(col).isNotNull()).distinct()
    if retry_incomplete:
        complete = (variations.groupBy("original").agg(F.count("variation").alias("_n"))
                    .where(F.col("_n") >= expected).select(F.col("original").alias(col)))
    else:
        complete = variations.select(F.col("original").alias(col))
    return todo.join(complete, col, "left_anti")


# J10
def processed_parents(variations: DataFrame, new_rows: DataFrame, col: str = "rewrite_prompt") -> DataFrame:
    """Originals with at least one variation already used as a prompt in ``new_rows``."""
    used = new_rows.select(F.col(col).alias("variation"))
    return variations.join(used, "variation", "left_semi").select("original").distinct()


# J11
def selected_parents(variations: DataFrame, selected: DataFrame,
                     processed: DataFrame | None = None, col: str = "prompt") -> DataFrame:
    """Originals selected directly or through one of their variations, minus processed ones."""
    chosen = selected.select(F.col(col).alias("_p"))
    keyed = (variations.select("original", F.col("original").alias("_p"))
             .unionByName(variations.select("original", F.col("variation").alias("_p"))))
    parents = keyed.join(chosen, "_p", "left_semi").select("original").distinct()
    if processed is not None:
        parents = parents.join(processed.select("original"), "original", "left_anti")
    return parents


# J12, J13 (fan-out over a fixed literal list)
def fan_out(df: DataFrame, values: Sequence[str], out: str, pos: str | None = None) -> DataFrame:
    arr = F.array(*[F.lit(v) for v in values])
    if pos is None:
        return df.select("*", F.explode(arr).alias(out))
    return df.select("*", F.posexplode(arr).alias(pos, out))


def cross_instructions(prompts: DataFrame, instructions: Sequence[str] = FV.VARIATION_INSTRUCTIONS) -> DataFrame:
    return fan_out(prompts, instructions, "instruction", pos="pos")


def cross_models(df: DataFrame, models: Sequence[str] = FV.TEXT_MODELS) -> DataFrame:
    return fan_out(df, models, "model")


# J15
def number_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` written once, with the position of each row as ``name`` (from 0, in the order of its partitions).

    Rows are counted per partition and the counts become offsets, so no task holds more than its own
    partition; the driver holds one number per partition."""
    numbered = written(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    counts = sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = list(accumulate((r["n"] for r in counts), initial=0))
    starts = df.sparkSession.createDataFrame([(r["part"], at) for r, at in zip(counts, offsets)], "_part long, _start long")
    rows = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, F.col("_start") + inside).drop("_place", "_part", "_start")


def attach_truth(predicted: DataFrame, truth: DataFrame, key: str | None = None) -> DataFrame:
    """The columns of ``truth`` beside those of ``predicted``, row by row in their order; a column that both have
    comes from ``predicted``. Frames of different length are refused.

    ``key`` names a column of a written ``truth`` with another value in each row: positions are then kept for
    the keys alone and the rows not written again. It isn't among the columns of the result."""
    rest = [c for c in truth.columns if c not in predicted.columns and c != key]
    left = number_rows(predicted, "_row")
    right = number_rows(truth.select(*(rest if key is None else [key])), "_row")
    n = [f.count() for f in (left, right)]
    if n[0] != n[1]:
        raise ValueError(f"{n[0]} predictions for {n[1]} rows")
    both = left.join(right, "_row").drop("_row")
    return both if key is None else both.join(truth.select(key, *rest), key).select(*predicted.columns, *rest)
