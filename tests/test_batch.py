"""Batch map, tagger test, prompt and text generation with stand-in models."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.operators import batch as M
from pairwright.operators import filters as FL
from pairwright.operators import joins as JN
from pairwright.operators import scoring as SC
from pairwright.plans import pipelines as P


def tagger(texts):
    """Tags by a tiny word list; one call per batch."""
    tags = {"text": "NN", "texts": "NNS", "rewritten": "VBN", "made": "VBN", "clear": "JJ", "needs": "VBZ"}
    return [[(w, tags.get(w.lower(), "IN")) for w in t.split()] for t in texts]


def test_tagged_pattern(spark):
    rows = [(1, "the text to be rewritten"), (2, "needs to be made"), (3, "Texts To Be MADE now"), (4, "text to be"),
            (5, None), (6, ""), (7, "text to be clear"), (8, "of text to be rewritten text to be")]
    df = spark.createDataFrame(rows, "id int, rewrite_prompt string")
    kept = {r["id"] for r in FL.reject_redundant_prompt(df, tagger=tagger).collect()}
    assert kept == {2, 4, 5, 6, 7}
    assert FL.reject_redundant_prompt(df, tagger=tagger).columns == df.columns


def test_batch_map_keeps_columns_and_failed_slices(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, text string").coalesce(1)

    def fn(chunk):
        if "t3" in chunk:
            raise ValueError("no")
        return [t.upper() for t in chunk]

    got = M.batch_generate(df, "text", fn, batch_size=2).orderBy("id").collect()
    assert [r["generated"] for r in got] == ["T0", "T1", None, None, "T4", "T5", "T6"]
    assert [r["error"] is None for r in got] == [True, True, False, False, True, True, True]


def examples(n):
    def fn(requests):
        one = {"prompt": "p", "input_characteristics": {"type": "note"}, "transformation_characteristics": {},
               "output_characteristics": {"type": "poem"}}
        return [json.dumps({"examples": [one] * n}) for _ in requests]
    return fn


def test_prompts_until_there_are_enough(spark):
    got = M.generate_prompts(spark, {"a": examples(3), "b": examples(2)}, n_total=12, per_request=5)
    assert got.count() >= 12 and set(got.select("model").distinct().toPandas()["model"]) == {"a", "b"}
    with pytest.raises(RuntimeError, match="0 of 4"):
        M.generate_prompts(spark, {"a": lambda rs: ["no json" for _ in rs]}, n_total=4)


def test_texts_for_every_model(spark):
    prompts = M.generate_prompts(spark, {"a": examples(2)}, n_total=2)
    calls = {"x": lambda rs: ["from x" for _ in rs], "y": lambda rs: ["" for _ in rs]}
    got = M.generate_texts(prompts, calls).collect()
    assert len(got) == prompts.count() and {r["original_text"] for r in got} == {"from x"} and {r["model"] for r in got} == {"x"}


def test_predictor_with_extra_columns_and_csv(spark, scratch):
    rows = [(f"o{i}", f"r{i}", "make it short" if i % 2 else "make it long", i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "original_text string, rewritten_text string, rewrite_prompt string, cluster int")

    def predictor(hidden):
        assert "rewrite_prompt" not in hidden.columns
        return M.constant_prediction(hidden, "make it short").selectExpr("*", "1 as confidence"), ["confidence"]

    done = P.evaluate(df, predictor, path=f"{scratch}/csv")
    assert done["rows"].columns[-1] == "confidence" and done["score"].first()["max"] == pytest.approx(1.0)
    assert spark.read.option("header", True).csv(f"{scratch}/csv").count() == 6
    assert done["cluster_score"].first()["count"] == 2


def eval_rows(spark, n=40):
    rows = [(f"o{i}", f"r{i}", f"make it {i}", i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "original_text string, rewritten_text string, rewrite_prompt string, cluster int").repartition(5)


def test_predictor_that_returns_only_its_own_column_and_cannot_see_the_truth(spark):
    def predictor(frame):
        assert "rewrite_prompt" not in frame.columns and not any("og" in c for c in frame.columns)
        return frame.select(F.concat(F.lit("guess "), F.substring("original_text", 2, 9)).alias("rewrite_prompt"))

    rows, _ = P.evaluate_rows(eval_rows(spark), predictor)
    got = rows.collect()
    assert len(got) == 40 and all(r["rewrite_prompt"] == "guess " + r["original_text"][1:] for r in got)
    assert all(r["rewrite_prompt_og"] == "make it " + r["original_text"][1:] == "make it " + r["rewritten_text"][1:] for r in got)


def test_predictions_of_another_number_are_refused(spark):
    with pytest.raises(ValueError, match="39 predictions for 40 rows"):
        P.evaluate_rows(eval_rows(spark), lambda f: f.where("original_text <> 'o3'").withColumn("rewrite_prompt", F.lit("x")))


def test_positions_count_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 <> 0 and (id < 200 or id > 500)")
    got = JN.number_rows(df).orderBy("id").collect()
    assert [r["row"] for r in got] == list(range(len(got)))
    assert JN.number_rows(df.where("id < 0")).count() == 0


def test_predictor_module_from_another_folder(spark, scratch):
    with open(f"{scratch}/shouting_predictor.py", "w") as f:
        f.write("import pandas as pd\nfrom pyspark.sql import functions as F\n\n\ndef shout(text):\n    return text.upper()\n\n\n"
                "@F.pandas_udf('string')\ndef shouted(texts: pd.Series) -> pd.Series:\n    return texts.map(shout)\n\n\n"
                "def predict(frame):\n    return frame.withColumn('rewrite_prompt', shouted('original_text'))\n")
    rows, _ = P.evaluate_rows(eval_rows(spark, 6), f"{scratch}/shouting_predictor.py")
    assert {r["rewrite_prompt"] for r in rows.collect()} == {f"O{i}" for i in range(6)}


def test_many_references_score_as_literals_do(spark):
    import random

    rng = random.Random(1)
    refs = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(20_000)]
    refs[7] = [0.0] * 8
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(5)] + [(9, [0.0] * 8), (10, None)], "id int, embedding array<double>")
    many = {r["id"]: r["scores"] for r in SC.score_against_references(df, refs).collect()}
    few = {r["id"]: r["scores"] for r in SC.score_against_references(df, refs[:40]).collect()}
    assert many[10] is None and all(len(many[i]) == 20_000 for i in range(5))
    for i in (*range(5), 9):
        assert many[i][:40] == pytest.approx(few[i], abs=1e-12)
    absolute = SC.score_against_references(df.where("id = 0"), refs, signed=False).first()["scores"]
    assert absolute == pytest.approx([abs(x) for x in many[0]], abs=1e-12)
    with pytest.raises(ValueError, match="most_bytes"):
        SC.score_against_references(df, refs, most_bytes=1000)


def test_mean_prompt_blend_in_prediction(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, original_text string, rewritten_text string")
    plain = M.predict_prompts(df, lambda xs: [json.dumps({"prompt": "zebra"}) for _ in xs]).first()["rewrite_prompt"]
    mixed = M.predict_prompts(df, lambda xs: [json.dumps({"prompt": "zebra"}) for _ in xs], use_mean_prompt=True).first()["rewrite_prompt"]
    assert plain == "zebra" and "zebra" in mixed and mixed != plain


def test_preamble_is_stripped_once_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "p", "## x\nb", 1)], "id int, original_text string, rewrite_prompt string, rewritten_text string, cluster int")
    plan = P.clean_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_repeat(0") == 1


def test_rewrites_end_in_the_sink_and_failures_are_retried(spark, scratch):
    rows = [(f"text {i}", "shorter", i % 2, f"request {i}") for i in range(6)]
    work = spark.createDataFrame(rows + rows[:2], "original_text string, rewrite_prompt string, cluster int, request string").coalesce(1)

    def flaky(batch):
        if any(r.endswith(("2", "5")) for r in batch):
            raise ValueError("busy")
        return [r.upper() for r in batch]

    sink = f"{scratch}/rewrites"
    assert M.generate_rewrites(work, sink, flaky, batch_size=1).count() == 4
    done = M.generate_rewrites(work, sink, lambda batch: [r.upper() for r in batch], batch_size=4)
    assert {r["rewritten_text"] for r in done.collect()} == {f"REQUEST {i}" for i in range(6)}
    assert done.select("id").distinct().count() == done.count() == 6


def test_pair_ids_tell_nulls_and_cuts_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("ab", ""), ("a", "b"), ("a", "b")], "original_text string, rewrite_prompt string")
    ids = [r["id"] for r in M.with_pair_id(df).collect()]
    assert len(set(ids)) == 4 and ids[3] == ids[4]
    assert M.with_pair_id(df.withColumn("id", df["rewrite_prompt"])).columns == ["original_text", "rewrite_prompt", "id"]


def test_encode_hashing_query_returns_the_embedding(spark):
    import math
    from collections import Counter

    from pyspark.ml.feature import HashingTF
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from pairwright.functions import text as T
    from pairwright.sources.views import pairs
    from tests.conftest import SF001

    got = {r["id"]: r["embedding"] for r in entry.queries()["encode_hashing"](spark, SF001).collect()}
    tf = HashingTF(numFeatures=256)
    rows = pairs(spark, SF001).select("id", F.split(T.normalize_prompt("rewrite_prompt"), f"[{T.WHITESPACE_CLASS}]+").alias("words")).limit(50)
    for r in rows.collect():
        n = Counter(tf.indexOf(w) for w in r["words"] or [] if w)
        norm = math.sqrt(sum(k * k for k in n.values()))
        want = [n[i] / norm if n else 0.0 for i in range(256)]
        assert len(got[r["id"]]) == 256 and all(abs(a - b) < 1e-5 for a, b in zip(got[r["id"]], want))


def test_batches_run_over_arrow_batches_and_sort_by_length(spark):
    df = spark.createDataFrame([(i, "x" * ((i * 7) % 23)) for i in range(103)], "i int, t string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        got = M.batch_map(df, "t", lambda ts: [f"{len(ts)}/{max(map(len, ts)) - min(map(len, ts))}/{len(t)}" for t in ts], "o", batch_size=8, window=4).collect()
    finally:
        spark.conf.set(key, before)
    parts = [r["o"].split("/") for r in sorted(got)]
    assert [int(p[2]) for p in parts] == [(i * 7) % 23 for i in range(103)]  # results in row order
    assert sorted(int(p[0]) for p in parts) == [7] * 7 + [8] * 96  # only the last batch is short
    assert max(int(p[1]) for p in parts) < 22
