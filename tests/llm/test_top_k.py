import math

import pytest
from pyspark.sql import functions as F

from pairwright.llm import top_k
from pairwright.llm.common import table
from pairwright.llm.queries import QUERIES

from tests.conftest import SF001


def brute(rows, every=100, k=10, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (i, q) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for r, (j, v) in enumerate(ok) if r != p and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_equals_all_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF001, "embeddings").collect()]
    got = QUERIES["op11_top_k"](spark, SF001)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert found(got) == brute(rows)


def test_many_blocks_ties_nulls_and_odd_vectors(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(400, 520)]
    rows += [(520, None), (600, [0.1, None, 0.2]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [0.5] * 6), (900, []), (901, [])]
    rows += [rows[7], rows[100], rows[100]]  # repeated rows, a repeated query among them
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(top_k, "BLOCK_NUMBERS", 64 * 50)
    assert found(top_k.top_k(df.withColumn("block", F.lit(1)).withColumn("score", F.lit("x")))) == brute(rows)
    assert found(top_k.top_k(df, every=40, k=3, scale=10)) == brute(rows, 40, 3, 10)


def test_few_rows_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(top_k.top_k(spark.createDataFrame([], schema))) == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert found(top_k.top_k(one)) == []
    two = spark.createDataFrame([(0, [1.0, 2.0]), (3, [-1.0, -2.0])], schema)
    assert found(top_k.top_k(two)) == [(0, 1, 3, -5 * 1024 * 1024)]


def test_reading_stops_before_the_lists_end():
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(size=(4000, 16)) * 100).astype(np.int64)
    lists = top_k.Lists(np.arange(4000), vectors)
    touched = []
    real = np.bincount
    lists_best = lambda: lists.best(vectors[0], 10, -math.inf, 0)
    top_k.np.bincount = lambda x, *a, **k: (touched.append(len(x)), real(x, *a, **k))[1]
    try:
        lists_best()
    finally:
        top_k.np.bincount = real
    assert sum(touched[::3]) < 0.7 * vectors.size


def test_scores_that_are_not_exact_are_refused():
    import numpy as np

    lists = top_k.Lists(np.arange(2), np.array([[1 << 40], [1]]))
    with pytest.raises(ValueError):
        lists.best(np.array([1 << 40]), 1, -math.inf)
