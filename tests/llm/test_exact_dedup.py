from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.llm import exact_dedup

SCHEMA = "doc_id long, text string, hash string, bucket int"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    out = set()
    for members in groups.values():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep) for _, i in members}
    return out


def result(spark, rows, **args):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = exact_dedup.dedup(df, **args).collect()
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got}, got


def test_ties_nulls_blanks_and_clashing_columns(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b "), (1, None), (2, ""), (4, " \n\t"), (7, "Ab"), (8, "é"), (6, "é"), (-2, "ab")]
    got, full = result(spark, rows)
    assert got == brute(rows) and len(full) == len(rows)


def test_small_buckets_double_the_directory(spark):
    rows = [(i, f"text {i % 150}") for i in range(400)]
    got, _ = result(spark, rows, capacity=4, hot=10)
    assert got == brute(rows)
    index = exact_dedup.build_index(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4)
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("depth").alias("d"))
    assert index.count() == 150 and sizes.where("n > 4 or d > 1").count() == 0


def test_rows_are_found_through_the_directory(spark):
    rows = [(i, f"text {i % 150}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.index_of(df, capacity=4)
    assert index.slots.count() > 30 and exact_dedup.look_up(df, index).count() == 400
    wrong = exact_dedup.Index(index.entries, index.slots.withColumn("bucket", F.col("bucket") + 1), index.bits)
    assert exact_dedup.look_up(df, wrong).count() < 40
    one = index.slots.orderBy("_slot").first()["_slot"]
    without = exact_dedup.look_up(df, exact_dedup.Index(index.entries, index.slots.where(F.col("_slot") != one), index.bits)).count()
    assert 0 < without < 400


def test_hot_group_and_repeated_rows(spark):
    rows = [(i, "same text" + " " * (i % 7)) for i in range(300)] + [(1000, "x"), (1000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.dedup(df, hot=20).collect()
    assert len(got) == 302
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] < 1000} == {(6, 300)}
    assert [r["kept"] for r in got if r["doc_id"] == 1000] == [True, True]


def test_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=4), min_size=1, max_size=25))
def test_any_rows(spark, texts):
    rows = list(enumerate(texts))
    got, _ = result(spark, rows, capacity=2, hot=3)
    assert got == brute(rows)
