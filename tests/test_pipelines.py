"""P1 against a pandas re-statement of the cleaning steps on the sf0.001 pairs;
P4/P5 shape checks; batch map error handling."""

import pandas as pd
from pyspark.sql import functions as F

from pairwright import fixed_values as FV
from pairwright.functions.similarity import indel_ratio
from pairwright.operators import batch as M
from pairwright.plans import pipelines as P
from pairwright.sources import views as VW

from .conftest import SF001


def py_first_line(t):
    return t.strip().split("\n")[0]


def py_clean(pdf: pd.DataFrame) -> pd.DataFrame:
    import re
    d = pdf.dropna()
    low = d.rewrite_prompt.str.lower()
    d = d[~(low.str.contains("translate") & low.str.contains("from") & low.str.contains("to"))]
    for w in FV.REJECT_ANY_WORDS:
        d = d[~d.rewrite_prompt.str.upper().str.contains(w.upper(), regex=False)]
    low = d.rewrite_prompt.str.lower()
    d = d[~(low.str.contains("code") & low.str.contains("language"))]

    def strip_pre(t):
        first = py_first_line(t)
        n = ("##" in first) + 2 * ("**" in first) + bool(re.search("sure|here's", first, re.I))
        for _ in range(n):
            t = t.replace(first, "")
        return t
    d = d.assign(rewritten_text=d.rewritten_text.map(strip_pre))
    d = d[d.rewritten_text != d.original_text]
    pat = re.compile("|".join(re.escape(p) for p in FV.BOILERPLATE_PHRASES), re.I)
    d = d[~d.rewritten_text.map(lambda t: bool(pat.search(t)))]
    d = d[[indel_ratio(a, b) < 95 for a, b in zip(d.original_text, d.rewritten_text)]]
    from .test_tagging import most_likely
    d = d[~d.rewrite_prompt.map(most_likely)]
    d = d[["id", "original_text", "rewrite_prompt", "rewritten_text", "cluster"]].drop_duplicates().dropna()
    return d.assign(rewritten_text=d.rewritten_text.str.strip())


def test_clean_pairs_matches_pandas(spark):
    pairs = VW.pairs(spark, SF001)
    got = P.clean_pairs(pairs).toPandas().sort_values("id").reset_index(drop=True)
    exp = py_clean(pairs.toPandas()).sort_values("id").reset_index(drop=True)
    assert list(got.id) == list(exp.id)
    assert list(got.rewritten_text) == list(exp.rewritten_text)


def test_training_and_evaluation_sets(spark):
    pairs = VW.pairs(spark, SF001)
    final = P.build_final(P.clean_pairs(pairs), pairs, VW.variations(spark, SF001), min_count=1)
    train = P.training_set(final, VW.split_map(spark), max_size=20, seed=1)
    rows = train.collect()
    assert 0 < len(rows) <= 20
    assert all(r["n_tokens"] < FV.MAX_TRAINING_TOKENS and r["completion_part"].startswith(" {") for r in rows)
    ev = P.evaluation_set(pairs, pairs.withColumn("rewritten_text", F.upper("rewritten_text")),
                          VW.split_map(spark), seed=1)
    assert ev.where(F.col("split") == "train").count() == 0
    res = P.evaluate(ev)
    assert res["score"].first()["count"] == ev.count()


def test_batch_map_failure_becomes_null(spark):
    df = spark.range(6).coalesce(1).withColumn("p", F.col("id").cast("string"))

    def flaky(xs):
        if "3" in xs:
            raise RuntimeError("api down")
        return [x + "!" for x in xs]
    out = M.batch_generate(df, "p", flaky, batch_size=2).orderBy("id").collect()
    assert [r["generated"] for r in out] == ["0!", "1!", None, None, "4!", "5!"]
    assert out[2]["error"] and out[0]["error"] is None


def test_stage_counts_are_a_by_product_of_the_run(spark):
    import __spark_entry__ as E
    from pairwright.plans import catalog as C

    pairs = VW.pairs(spark, SF001)
    counts = P.StageCounts()
    tracker, group = spark.sparkContext.statusTracker(), "observed-run"
    spark.sparkContext.setJobGroup(group, "")
    P.clean_pairs(pairs, observed=counts, **{**C.STAGE_PARAMS}).write.format("noop").mode("overwrite").save()
    rows = counts.rows()
    jobs = len(tracker.getJobIdsForGroup(group))
    counts.rows()
    assert len(tracker.getJobIdsForGroup(group)) == jobs
    spark.sparkContext._jsc.clearJobGroup()
    want = sorted(map(tuple, E.queries()["stage_counts"](spark, SF001).collect()))
    assert rows == want and len({r[2] for r in rows}) > 3
