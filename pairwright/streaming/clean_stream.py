"""Row-local cleaning (the P1 filters and text fixes) on a streaming source.

The pipeline being reproduced has no streams; its resumable generation loop
maps naturally onto Structured Streaming instead: files of pairs arriving in
a folder are cleaned micro-batch by micro-batch into a Parquet sink, and the
checkpoint location makes a restarted query continue exactly where it
stopped.  De-duplication needs a watermark in streaming and stays in the
batch job (P1's final ``distinct``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..functions import text as T
from ..operators import filters as FL
from ..sources.files import PAIR_SCHEMA


def clean_rows(df: DataFrame) -> DataFrame:
    """The row-local part of P1 (valid on streaming and batch frames)."""
    out = FL.drop_null_rows(df)
    out = FL.reject_if_contains_all(out, "rewrite_prompt", FV.REJECT_ALL_WORD_GROUPS[0])
    out = FL.reject_if_contains_any(out, "rewrite_prompt", FV.REJECT_ANY_WORDS)
    for group in FV.REJECT_ALL_WORD_GROUPS[1:]:
        out = FL.reject_if_contains_all(out, "rewrite_prompt", group)
    out = out.withColumn("rewritten_text", T.strip_preamble("rewritten_text"))
    out = FL.reject_identical(out)
    out = FL.reject_boilerplate(out)
    out = FL.reject_near_identical(out)
    out = FL.reject_redundant_prompt(out)
    return out.withColumn("rewritten_text", T.ustrip("rewritten_text"))


def start_clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       schema: str = PAIR_SCHEMA, max_files_per_trigger: int = 8):
    """Clean Parquet files of pairs as they arrive; returns the running query."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    cleaned = clean_rows(stream).withColumn("cleaned_at", F.current_timestamp())
    return (cleaned.writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
