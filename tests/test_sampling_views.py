"""K1/K2/K4 exactness under skew; two-level lead equals a plain window; exact describe."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators import aggregates as A
from pairwright.operators import sampling as K
from pairwright.sources import views as VW
from pairwright.sources.views import lead_in_order


def test_first_n_by_hash_exact_and_deterministic(spark):
    rows = [(i % 7, f"v{i % 50}") for i in range(400)] + [(1, "hot")] * 300
    df = spark.createDataFrame(rows, "g int, v string").repartition(5)
    for n in (0, 1, 37, 350, 699, 700, 1000):
        got = K.first_n_by_hash(df, n, seed=3)
        assert got.count() == min(n, 700)
    a = sorted(map(tuple, K.first_n_by_hash(df, 123, 3).collect()))
    b = sorted(map(tuple, K.first_n_by_hash(df.repartition(2), 123, 3).collect()))
    assert a == b
    keyed = df.withColumn("h", K.hash_key(3, ["g", "v"])).toPandas().sort_values(["h"])
    expect = sorted(map(tuple, keyed.head(123)[["g", "v"]].itertuples(index=False)))
    assert a == expect


def test_sample_per_group_bound(spark):
    rows = [(g, f"g{g}p{i}") for g in range(4) for i in range(60 if g == 0 else 10)]
    df = spark.createDataFrame(rows, "cluster int, prompt string")
    got = K.sample_per_group(df, "cluster", "prompt", 30, seed=1)
    vals = [r[0] for r in got.collect()]
    assert len(vals) == 30 + 10 * 3 and len(set(vals)) == len(vals)


def test_lead_in_order_matches_window(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "en", "en", "fr", "de"]), f"t{i}") for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, part string, v string")
    expect = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("part").orderBy("k")))
    for width in (1, 7, 64, 1 << 16):
        got = lead_in_order(df, "part", "k", "v", "nxt", bucket_width=width)
        assert sorted(map(tuple, got.select("k", "part", "v", "nxt").collect())) == \
            sorted(map(tuple, expect.select("k", "part", "v", "nxt").collect()))


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.random(997)) + [0.5] * 200 + [None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "x double")
    got = A.describe(df, "x").first()
    exp = pd.Series([v for v in vals if v is not None]).describe()
    assert got["count"] == exp["count"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                         ("p75", "75%"), ("max", "max")):
        assert abs(got[ours] - exp[theirs]) < 1e-12


@pytest.mark.parametrize("values", [
    [float(i % 97) for i in range(3000)],                                   # ties
    [1.0] * 1500 + [2.0] * 1500,                                            # two values only
    [float(i) * 1e300 / 3000 for i in range(1500)] + [i * 1e-300 for i in range(1500)],  # wide spread
    [float(i) for i in range(300)] + [0.5] * 2700,                          # one value has nearly all rows
])
def test_exact_quantiles_fetch_a_fixed_number_of_values(spark, monkeypatch, values):
    monkeypatch.setattr(A, "ACCURACY", 50)
    monkeypatch.setattr(A, "FETCH", 100)
    fetched = []
    real = A._Bracket.fetched
    monkeypatch.setattr(A._Bracket, "fetched", lambda self, v: fetched.append(self.inside) or real(self, v))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    n, qs = A.exact_quantiles(df, "x", (0.1, 0.5, 0.9))
    assert n == 3000 and all(k <= 100 for k in fetched)
    assert np.allclose(qs, np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12)


def test_samples_tell_null_positions_apart_and_cut_ties(spark):
    df = spark.createDataFrame([("x", None), (None, "x")] + [("t", "t")] * 50, "a string, b string")
    for n in range(1, 52):
        if n in (1, 2, 3, 25, 51):
            assert K.first_n_by_hash(df, n, 3).count() == n
    a, b = K.balance_samples(df, df.limit(7), 1)
    assert (a.count(), b.count()) == (7, 7)


def test_heads_of_buckets_are_found_through_levels(spark):
    rows = [(p, o, f"{p}{o}") for p in "ab" for o in (0, 3, 4, 17, 64, 65, 300, 2000, 2001)]
    df = spark.createDataFrame(rows, "p string, o long, v string")
    want = {tuple(r) for r in VW.lead_in_order(df, "p", "o", "v", "n", levels=0).collect()}
    for width in (2, 4, 16):
        assert {tuple(r) for r in VW.lead_in_order(df, "p", "o", "v", "n", width).collect()} == want


def test_every_benchmark_item_is_used(spark):
    from .conftest import SF001
    items = VW.table(spark, SF001, "benchmark")
    used = VW.pairs(spark, SF001).select("rewrite_prompt").distinct()
    assert used.count() == items.select("text").distinct().count()
    v = VW.variations(spark, SF001)
    assert v.select("original").union(v.select("variation")).distinct().count() == items.select("text").distinct().count()
