"""The pipeline against brute-force versions of its stages, each judged on its own input, and the registered queries."""

import math
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from pairwright.llm.common import scratch, table
from tests.conftest import SF001
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import targets
from tests.llm.test_near_dedup import brute as brute_near

ORACLES = {k: v for k, v in entry.oracle_sql().items() if k.startswith("op")}


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents and of every stage's output."""
    out = {}
    docs = table(spark, SF001, "documents")
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = f"{scratch(spark)}/test-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, SF001).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def rows(stage):
    return [(r["doc_id"], r["text"]) for r in stage]


def test_quality_keeps_what_labels_call_good(stages, spark):
    good = {r["doc_id"]: r["quality"] for r in table(spark, SF001, "labels").collect()}
    kept = {r["doc_id"] for r in stages["quality"]}
    right = [(i in kept) == bool(q) for i, q in good.items()]
    assert sum(right) / len(right) > 0.9 and kept <= {r["doc_id"] for r in stages["documents"]}


def test_line_dedup(stages):
    want = {i: t for i, t in brute_lines(rows(stages["quality"])).items() if t is None or t.strip()}
    assert dict(rows(stages["line_dedup"])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"] if r["text"] is not None)


def test_near_dedup(stages):
    found = brute_near(rows(stages["line_dedup"]), 5, 80)
    assert {r["doc_id"] for r in stages["near_dedup"]} == {i for i, (_, _, kept) in found.items() if kept}


def test_decontamination(stages, spark):
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    leaked = {i for i, t in rows(stages["near_dedup"]) if any(x in plain(t) for x in items)}
    left = {r["doc_id"] for r in stages["decontaminate"]}
    before = {r["doc_id"] for r in stages["near_dedup"]}
    assert not left & leaked and len(before - left - leaked) <= 0.01 * len(before)


def test_mix(stages):
    docs = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in stages["decontaminate"]}
    total = {}
    for source, n in docs.values():
        total[source] = total.get(source, 0) + n
    want = targets(total)
    taken = dict.fromkeys(total, 0)
    assert {r["doc_id"] for r in stages["mix"]} == set(docs)
    for r in stages["mix"]:
        assert (r["source"], r["size"]) == docs[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 3 for s in total)


def test_stages_take_odd_rows_and_keep_columns(spark):
    odd = table(spark, SF001, "documents").limit(30).withColumn("score", F.lit("clash")).withColumn("_lines", F.lit(1))
    more = spark.createDataFrame(
        [(10**6, None, None, None, None, None, None), (10**6 + 1, "", "en", "s", 0, "x", 2), (None, "text without id", None, "s", 15, "x", 2)],
        T.StructType([T.StructField(f.name, f.dataType) for f in odd.schema.fields]),
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd.unionByName(more), SF001)
        if name != "mix":
            assert out.columns == odd.columns
        assert out.count() <= 33
        assert stage(spark, odd.limit(0), SF001).count() == 0


def test_run_is_registered(spark, stages):
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in stages["mix"]}


def _norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF001)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr([_norm(v) for v in r]) for r in got.select(*cols).collect()) == sorted(repr([_norm(v) for v in r]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k.startswith("op")))
def test_query_returns_its_contract(spark, name):
    key, source = ("page_id", "pages") if name.startswith("op3") else ("doc_id", "documents")
    got = entry.queries()[name](spark, SF001)
    if name.startswith("op11"):
        ids = {r[0] for r in got.select("query_id").collect()}
        assert ids == {r[0] for r in table(spark, SF001, "embeddings").where("vec_id % 100 = 0").select("vec_id").collect()}
    elif name.startswith("op12"):
        words = [r[0] for r in got.select("word").collect()]
        assert words and len(words) == len(set(words)) and all(len(w) >= 5 for w in words)
    elif not name.startswith("op4"):
        ids = sorted(r[0] for r in got.select(key).collect())
        assert ids == sorted(r[0] for r in table(spark, SF001, source).select(key).collect())
