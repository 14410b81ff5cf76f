"""Row expressions that are evaluated once: plans that don't repeat them."""

from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.functions import vectors as V
from pairwright.operators import aggregates as A
from pairwright.operators import joins as JN
from pairwright.operators import sampling as K
from pairwright.plans import pipelines as P
from pairwright.session import written
from pairwright.sources import views as VW


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_l2_normalize_evaluates_its_vector_once(spark):
    df = spark.createDataFrame([("3 4",), ("0 0",), (None,)], "t string")
    out = df.select(V.l2_normalize(F.split(F.upper("t"), " ").cast("array<double>")).alias("u"))
    assert _plan(out).count("upper(") == 1
    assert [r["u"] for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_vocabulary_is_normalised_outside_the_word_loop(spark):
    df = spark.createDataFrame([("The CAT, sat!",), ("!! the",), (None,)], "t string")
    out = df.select(T.subtract_vocabulary("t", "the, Sat").alias("w"))
    assert _plan(out).count("regexp_replace(") == 1
    assert [r["w"] for r in out.collect()] == ["cat", "", None]
    other = df.select(T.subtract_vocabulary("t", "th\u00e9 the Sat \u00dcber").alias("w"))
    assert [r["w"] for r in other.collect()] == ["cat", "", None]


def test_describe_does_not_compute_its_column_for_the_filter(spark):
    df = spark.createDataFrame([("1",), ("2",), ("nan",), (None,)], "t string").select(F.lower("t").alias("x"))
    assert _plan(A._numbers(df, "x")).count("lower(") == 1
    assert A.describe(df, "x").first()["mean"] == 1.5


def test_seeded_shuffle_sorts_by_its_key_alone(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, t string")
    out = K.seeded_shuffle(df, 1, ["id", "t"])
    sort = next(line for line in _plan(out).splitlines() if line.lstrip().startswith("Sort ["))
    assert sort.count("ASC") == 1
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys) and len(keys) == 50


def test_evaluation_set_writes_both_sides_in_one_job(spark, monkeypatch):
    names = []
    for module in (P, JN):
        monkeypatch.setattr(module, "written", lambda df, name: names.append((name, df)) or written(df, name))
    rows = [(i, f"text {i % 7}" if i % 5 else None, "p", f"r{i}", i % 3) for i in range(60)]
    old = spark.createDataFrame(rows, "id long, original_text string, rewrite_prompt string, rewritten_text string, cluster int")
    new = old.withColumn("rewritten_text", F.upper("rewritten_text")).where("id % 7 <> 3")
    splits = spark.createDataFrame([(0, "test"), (1, "val")], "cluster int, split string")
    held = old.where("cluster < 2")
    train = old.where("cluster = 2 and id % 7 = 1").select("original_text")
    left = JN.remove_leaks(held, train)
    assert sorted(r["id"] for r in left.collect()) == sorted(r[0] for r in rows if r[4] < 2 and r[1] != "text 1")
    assert [n for n, _ in names] == ["leaked"]
    assert [r for _, df in names for r in df.columns] == ["_leak_key"]  # digests move, no texts
    names.clear()
    P.evaluation_set(old, new, splits)
    assert [n for n, _ in names] == ["leaked", "sides"]


def test_looking_up_the_split_moves_no_rows(spark):
    df = spark.createDataFrame([(i, i % 9) for i in range(30)], "id long, cluster int")
    got = JN.assign_split(df, VW.split_map(spark), "train")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["cluster"]: r["split"] for r in got.collect()} == {c: "test" if c < 4 else "val" if c < 7 else "train" for c in range(9)}


def test_evaluate_moves_and_writes_its_texts_once(spark, monkeypatch):
    frames = []
    for module in (P, JN):
        monkeypatch.setattr(module, "written", lambda df, name: frames.append((name, set(df.columns))) or written(df, name))
    rows = [(i, f"text {i % 9}", f"p{i % 4}", f"r{i}", i % 3) for i in range(60)]
    old = spark.createDataFrame(rows, "id long, original_text string, rewrite_prompt string, rewritten_text string, cluster int")
    new = old.withColumn("rewritten_text", F.upper("rewritten_text")).where("id % 7 <> 3")
    splits = spark.createDataFrame([(0, "test"), (1, "val")], "cluster int, split string")
    digest = old.withColumn("original_text", F.unhex(F.sha2("original_text", 256)))
    ev = P.evaluation_set(old, new, splits, digests=(digest, digest), key="row")
    done = P.evaluate(ev, lambda frame: frame.select(F.concat("original_text", "rewritten_text").alias("rewrite_prompt")), key="row")
    assert [n for n, _ in frames] == ["leaked", "sides", "numbered", "numbered", "evaluation"]
    assert all("original_text" not in c for n, c in frames if n in ("leaked", "numbered"))
    got = done["rows"].collect()
    assert len(got) == ev.count() > 20 and "row" not in done["rows"].columns
    assert all(r["rewrite_prompt"] == r["original_text"] + r["rewritten_text"] for r in got)
    prompts = {r[3].lower(): r[2] for r in rows}
    assert all(r["rewrite_prompt_og"] == prompts[r["rewritten_text"].lower()] for r in got)


def _evaluation_brute(old, new, test, seed):
    """Rows (id, original, prompt, rewritten, cluster) of both sides in plain Python."""
    import hashlib

    def key(r):
        i, o, p, w, c = r
        values = [o, c, i, p, w, "test"]
        return hashlib.md5("\u0001".join([str(seed), *(f"{len(str(v))}:{v}" for v in values)]).encode()).hexdigest()

    full = [[r for r in side if None not in r] for side in (old, new)]
    train = {r[1] for side in full for r in side if r[4] not in test}
    held = [sorted((r for r in side if r[4] in test and r[1] not in train), key=key) for side in full]
    n = min(map(len, held))
    return {r for side in held for r in side[:n] if all(str(x).strip() for x in r[1:4])}


def test_evaluation_set_with_copies_equals_its_definition(spark):
    schema = "id long, original_text string, rewrite_prompt string, rewritten_text string, cluster int"
    old = [(i % 23, f"text {i % 23}" if i % 11 else None, "p" if i % 6 else " ", f"r{i % 23}", i % 23 % 4) for i in range(160)]
    old += [(7, "text 100", "p", "r", 3), (8, "text 1", "p", "r", 3)] + [(9, "text 100", "p", "r", 1)] * 5
    splits = spark.createDataFrame([(c, "test") for c in range(3)], "cluster int, split string")
    for new in (old[:40], [r[:3] + (f"{r[3]} new" if r[0] % 2 else r[3],) + r[4:] for r in old[20:90]] * 2, []):
        frames = [spark.createDataFrame(x, schema) for x in (old, new)]
        digests = tuple(f.withColumn("original_text", F.unhex(F.sha2("original_text", 256))) for f in frames)
        for given in (None, digests):
            ev = P.evaluation_set(*frames, splits, 5, digests=given)
            got = [(r["id"], r["original_text"], r["rewrite_prompt"], r["rewritten_text"], r["cluster"]) for r in ev.collect()]
            assert len(got) == len(set(got))
            # hash_key reads the columns as evaluation_set orders them
            assert ev.columns == ["original_text", "cluster", "id", "rewrite_prompt", "rewritten_text", "split"]
            assert set(got) == _evaluation_brute(old, new, {0, 1, 2}, 5)


def test_evaluation_sets_of_other_schemas_are_written_side_by_side(spark):
    schema = "id long, original_text string, rewrite_prompt string, rewritten_text string, cluster int"
    rows = [(i % 23, f"text {i % 23}" if i % 11 else None, "p" if i % 6 else " ", f"r{i % 23}", i % 23 % 4) for i in range(160)]
    old = spark.createDataFrame([*rows, (8, "text 1", "p", "r", 3)], schema)
    splits = spark.createDataFrame([(c, "test") for c in range(3)], "cluster int, split string")
    want = {r[1:] for r in _evaluation_brute(rows + [(8, "text 1", "p", "r", 3)], rows, {0, 1, 2}, 1)}
    for new in (old.select(*reversed(old.columns)), old.withColumn("cluster", F.col("cluster").cast("double"))):
        ev = P.evaluation_set(old, new, splits, key="row")
        got = ev.select("original_text", "rewrite_prompt", "rewritten_text", F.col("cluster").cast("int")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        assert ev.select("row").distinct().count() == len(got)
