"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. quality: documents that the quality classifier rejects go.
2. line_dedup: later occurrences of repeated lines go from the texts; a document of which nothing is left goes.
3. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays.
4. decontaminate: documents that contain a benchmark item go.
5. mix: the sources are mixed to their target weights; one row per document with the words the mix takes.

All stages but the last return the columns of their input. Null and empty texts, repeated rows and
additional columns pass through as the operators say; an empty table gives an empty table. Rows
without a doc_id are kept by stages 2 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontamination, line_dedup, mixing, near_dedup, quality
from pairwright.llm.common import SPACE, stash, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (was_blank,) = unused(docs, "_was_blank")
    marked = docs.withColumn(was_blank, F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "") == "")
    out = line_dedup.dedup_lines(marked, counts=False)
    out = out.where(F.col(was_blank) | (F.regexp_replace("text", SPACE, "") != "")).drop(was_blank)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, k=5, threshold=80)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(docs))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: Classifier, sketches and draws are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
