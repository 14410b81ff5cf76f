"""Helpers: words, running totals over a bucket tree, components, spread joins."""

import numpy as np
from pyspark.sql import functions as F

from pairwright.llm.common import components, prefix_sums, spread_join, words_in
from pairwright.llm.shingles import shingle_sets, word_hashes


def test_words_in(spark):
    texts = ["a  b\tc\n", "", None, " \x0b\x0c ", "é x y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(words_in(F.col("t"))).collect()] == [3, 0, 0, 0, 2]


def test_prefix_sums_equal_a_running_total(spark):
    rows = [(k, i, (7 * i + k) % 5) for k in range(2) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, i long, v long")
    got = prefix_sums(df, ["k"], ["i"], "v", F.floor(F.col("i") / 10), 70, fanout=4).collect()
    for k in range(2):
        values = sorted((r["i"], r["v"], r["_before"], r["_total"]) for r in got if r["k"] == k)
        total = 0
        for _, v, before, all_ in values:
            assert before == total and all_ == sum(x[1] for x in values)
            total += v
    assert len(got) == 1400
    assert prefix_sums(df.limit(0), ["k"], ["i"], "v", F.lit(0), 1).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(20, 40)] + [(5, 3), (3, 5), (9, 9), (60, 50), (50, 55)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 20 for i in range(20, 41)} | {3: 3, 5: 3, 50: 50, 55: 50, 60: 50}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_join_keeps_all_rows(spark):
    rows = spark.range(300).withColumn("k", F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = spread_join(rows, groups, ["k"], "id", "n", 300, hot=20)
    assert sorted(r["id"] for r in got.collect()) == list(range(300))
    assert sorted(got.columns) == ["id", "k", "n"]


def test_shingles_equal_plain_sets():
    texts = ["A b c d", "a B\nc   d", "x", "x y", "", None, "a b c a b c a b c", "wörter " * 50, "q" * 3_000_000 + " z"]
    sets = shingle_sets(texts, 3)

    def plain(t):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        n = min(3, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()

    assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
    assert np.array_equal(sets[0], sets[1]) and not set(sets[2]) & set(sets[3])
    assert np.array_equal(word_hashes("ab cd".encode())[::-1], word_hashes("cd ab".encode()))
