"""Views over the driver tables used by the registered queries.

``pairs``          documents joined to a benchmark item (doc_id modulo the number of
                   items); the rewritten text is the next document of the same language.
``turn_pairs``     a user turn joined to the assistant turn that follows it.
``variations``     long form ``(original, pos, variation)`` from benchmark items.
``vectors``        embeddings as prompt vectors; ``vec_id < 16`` are references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VARIATIONS_PER_PROMPT = 3
N_REFERENCES = 16
SPLIT_RULE = ((0, 3, "test"), (4, 6, "val"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lead_in_order(df: DataFrame, part: str, order: str, value: str, out: str,
                  bucket_width: int = 1 << 10, levels: int = 3) -> DataFrame:
    """``lead(value) over (partition by part order by order)`` without one task per ``part``.

    Rows are windowed per ``(part, order div bucket_width)``, so no window
    group exceeds ``bucket_width`` distinct order values however skewed
    ``part`` is.  To let the last row of a bucket see the first row of the
    next non-empty bucket, that first row (order and value, from one
    aggregate) is added to the bucket once more as a sentinel.  The same
    function finds the next bucket's head among the heads, ``levels`` times;
    the plain window at the top has one row per ``bucket_width ** levels``
    order values.
    """
    if levels == 0:
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(part).orderBy(order)))
    b, head, nxt_head, sentinel = "_lead_bucket", "_lead_head", "_lead_next_head", "_lead_sentinel"
    d = df.withColumn(b, F.floor(F.col(order) / F.lit(bucket_width)).cast("long"))
    heads = d.groupBy(part, b).agg(F.struct(F.min(order).alias("o"), F.min_by(value, order).alias("v")).alias(head))
    nxt = lead_in_order(heads.withColumnRenamed(b, "_lead_order"), part, "_lead_order", head, nxt_head,
                        bucket_width, levels - 1)
    sentinels = nxt.where(F.col(nxt_head).isNotNull()).select(
        part, F.col("_lead_order").alias(b), F.col(nxt_head)["o"].alias(order),
        F.col(nxt_head)["v"].alias(value), F.lit(True).alias(sentinel))
    body = d.withColumn(sentinel, F.lit(False))
    w = Window.partitionBy(part, b).orderBy(order, sentinel)
    return (body.unionByName(sentinels, allowMissingColumns=True)
                .withColumn(out, F.lead(value).over(w))
                .where(~F.col(sentinel))
                .drop(b, sentinel))


def n_items(bench: DataFrame) -> Column:
    """Number of benchmark items, as a scalar subquery of the plan it is used in."""
    return bench.agg(F.count(F.lit(1))).scalar()


def pairs(spark: SparkSession, sf_dir: str, bucket_width: int = 1 << 10, digests: bool = False) -> DataFrame:
    """``(id, original_text, rewrite_prompt, rewritten_text, cluster)``; every benchmark item is a prompt.
    With ``digests`` the SHA-256 of both texts (binary) stand in their place, for jobs that only compare them."""
    text = F.unhex(F.sha2("text", 256)) if digests else F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang", "source")
    bench = table(spark, sf_dir, "benchmark")
    prompts = bench.select("item_id", F.col("text").alias("rewrite_prompt"))
    led = lead_in_order(docs, "lang", "doc_id", "text", "rewritten_text", bucket_width)
    joined = led.withColumn("item_id", F.col("doc_id") % n_items(bench)).join(prompts, "item_id", "inner")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("original_text"),
        "rewrite_prompt",
        "rewritten_text",
        F.expr("substring(source, 4)").cast("int").alias("cluster"),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, prompt_text, response_text)`` of consecutive user/assistant turns."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt_text"))
    bot = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text"))
    return user.join(bot, ["conv_id", "turn"], "inner")


def variations(spark: SparkSession, sf_dir: str, per_prompt: int = VARIATIONS_PER_PROMPT) -> DataFrame:
    """Long-form variation map ``(original, pos, variation)``.

    The first ``1 / (per_prompt + 1)`` of the items are originals; every other
    item is a variation of one of them."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    numbered = bench.withColumn(
        "n_originals", F.greatest(F.lit(1), F.floor(n_items(bench) / (per_prompt + 1))))
    orig = numbered.where(F.col("item_id") < F.col("n_originals")).select(
        F.col("item_id").alias("o_id"), F.col("text").alias("original"))
    var = numbered.where(F.col("item_id") >= F.col("n_originals")).select(
        (F.col("item_id") % F.col("n_originals")).alias("o_id"),
        (F.floor(F.col("item_id") / F.col("n_originals")) - 1).cast("int").alias("pos"),
        F.col("text").alias("variation"))
    return orig.join(var, "o_id", "inner").select("original", "pos", "variation")


def split_map(spark: SparkSession, rule=SPLIT_RULE) -> DataFrame:
    """``(cluster, split)`` from inclusive cluster ranges; other clusters are absent.

    The rows come out of a literal, whose size the planner knows: rows that look their split up needn't move."""
    rows = [F.struct(F.lit(c).alias("cluster"), F.lit(name).alias("split")) for lo, hi, name in rule for c in range(lo, hi + 1)]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<cluster:int,split:string>>")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, embedding, cluster)`` prompt vectors."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.col("label").alias("cluster"))


def candidate_vectors(spark: SparkSession, sf_dir: str, n_refs: int = N_REFERENCES) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") >= n_refs)


def reference_vectors(spark: SparkSession, sf_dir: str, n_refs: int = N_REFERENCES) -> list[list[float]]:
    """The ``n_refs`` reference vectors, ordered by id (reference id = vec_id + 1).

    The set is a fixed-size parameter of the selection; its size is checked
    before it is brought to the driver."""
    refs = (vectors(spark, sf_dir).where(F.col("vec_id") < n_refs)
            .orderBy("vec_id").limit(n_refs + 1).collect())
    if len(refs) != n_refs:
        raise ValueError(f"expected {n_refs} reference vectors, found {len(refs)}")
    return [[float(x) for x in r["embedding"]] for r in refs]
