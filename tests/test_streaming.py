"""The streaming wrapper cleans files as they arrive and matches the batch row-local result."""

import os

from pairwright.sources import views as VW
from pairwright.streaming.clean_stream import clean_rows, start_clean_stream

from .conftest import SF001


def test_clean_stream_matches_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    pairs = VW.pairs(spark, SF001).selectExpr("CAST(id AS STRING) AS id", "original_text", "rewrite_prompt",
                                              "rewritten_text", "cluster")
    pairs.write.parquet(src)
    q = start_clean_stream(spark, src, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(os.path.join(scratch, "out")).select("id").collect()
    expect = clean_rows(spark.read.parquet(src)).select("id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in expect)
