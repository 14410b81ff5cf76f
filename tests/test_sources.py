"""S1-S8 readers/writers on hand-made files."""

import json
import os

from pyspark.sql import functions as F

from pairwright.sources import files as S
from pairwright.sources import resumable as R
from pairwright.sources.files import read_pairs_csv, write_csv
from pairwright.sources.resumable import append_results


def test_read_pairs_csv(spark, scratch):
    path = os.path.join(scratch, "pairs.csv")
    with open(path, "w") as f:
        f.write('id,original_text,rewrite_prompt,rewritten_text,cluster\n')
        f.write('1,"line one\nline two","say ""hi""",  padded  ,3\n')
        f.write('2,NA,null,back\\slash,\n')
    df = S.read_pairs_csv(spark, path)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert rows[0]["original_text"] == "line one\nline two"
    assert rows[0]["rewrite_prompt"] == 'say "hi"'
    assert rows[0]["rewritten_text"] == "  padded  "
    assert rows[0]["cluster"] == 3
    assert rows[1]["original_text"] is None and rows[1]["rewrite_prompt"] is None
    assert rows[1]["rewritten_text"] == "back\\slash" and rows[1]["cluster"] is None


def test_variations_and_split_map(spark, scratch):
    vpath = os.path.join(scratch, "variations.json")
    json.dump({"p1": ["a", None, "c"], "p2": []}, open(vpath, "w"))
    v = S.read_variations_json(spark, vpath)
    got = sorted((r["original"], r["pos"], r["variation"]) for r in v.collect())
    assert got == [("p1", 0, "a"), ("p1", 1, None), ("p1", 2, "c"), ("p2", None, None)]
    spath = os.path.join(scratch, "split.json")
    json.dump({"624": "test", "5": "val"}, open(spath, "w"))
    s = S.read_split_map_json(spark, spath)
    assert sorted(map(tuple, s.collect())) == [(5, "val"), (624, "test")]
    lpath = os.path.join(scratch, "selected.json")
    json.dump(["x", "y"], open(lpath, "w"))
    assert sorted(r[0] for r in S.read_string_list_json(spark, lpath).collect()) == ["x", "y"]
    missing = S.read_records_json(spark, os.path.join(scratch, "none.json"), "id string, prompt string")
    assert missing.count() == 0


def test_write_and_resumable_append(spark, scratch):
    out = os.path.join(scratch, "sink")
    inputs = spark.range(10).withColumn("prompt", F.concat(F.lit("p"), F.col("id").cast("string")))
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.withColumn("generated", F.upper("prompt"))

    R.append_results(spark, inputs.where("id < 4"), out, "id", compute)
    full = R.append_results(spark, inputs, out, "id", compute)
    assert calls == [4, 6]
    assert full.count() == 10 and full.select("id").distinct().count() == 10
    csv_out = os.path.join(scratch, "csv")
    S.write_csv(full, csv_out)
    back = spark.read.option("header", True).csv(csv_out)
    assert back.count() == 10


def test_csv_columns_by_header_and_whole_numbers_with_a_fraction(spark, scratch):
    path = f"{scratch}/pairs.csv"
    with open(path, "w") as f:
        f.write("cluster,extra,rewrite_prompt,original_text,rewritten_text,id\n3.0,e,p,o,r,1\n,e,NA,o2,r2,2\n2.5,e,p,o,r,3\nx,e,p,o,r,4\n")
    got = {r["id"]: tuple(r) for r in read_pairs_csv(spark, path).collect()}
    assert got["1"] == ("1", "o", "p", "r", 3) and got["2"] == ("2", "o2", None, "r2", None)
    assert got["3"][4] is None and got["4"][4] is None


def test_csv_round_trip_keeps_spaces_newlines_and_quotes(spark, scratch):
    rows = [("1", " pad ", 'quote " in', "line\nbreak", 1), ("2", "\ttab\t", "a,b", "\\", 2), ("3", None, "x", "  ", None)]
    df = spark.createDataFrame(rows, "id string, original_text string, rewrite_prompt string, rewritten_text string, cluster int")
    write_csv(df, f"{scratch}/out")
    assert sorted(map(tuple, read_pairs_csv(spark, f"{scratch}/out").collect())) == sorted(rows)


def test_failed_rows_are_tried_again(spark, scratch):
    inputs = spark.createDataFrame([(i,) for i in range(6)], "id long")
    path = f"{scratch}/sink"
    flaky = lambda todo: todo.withColumn("error", F.when(F.col("id") % 2 == 0, "failed"))
    assert append_results(spark, inputs, path, "id", flaky, "error").count() == 3
    assert append_results(spark, inputs, path, "id", lambda t: t.withColumn("error", F.lit(None).cast("string")), "error").count() == 6


def test_overlapping_runs_leave_one_row_per_key(spark, scratch):
    path = f"{scratch}/sink"
    inputs = spark.range(20)
    append_results(spark, inputs.where("id < 5"), path, "id", lambda t: t.withColumn("by", F.lit("first")))

    def slow(todo):
        # while this run computes, another one starts and ends, and a third fails halfway
        append_results(spark, inputs.where("id < 12"), path, "id", lambda t: t.withColumn("by", F.lit("other")))
        try:
            append_results(spark, inputs, path, "id", lambda t: t.withColumn("by", F.raise_error(F.lit("lost"))))
        except Exception:
            pass
        return todo.withColumn("by", F.lit("slow"))

    got = append_results(spark, inputs, path, "id", slow)
    rows = {r["id"]: r["by"] for r in got.collect()}
    assert got.count() == 20 and set(rows) == set(range(20))
    assert [rows[i] for i in (0, 5, 11, 12, 19)] == ["first", "other", "other", "slow", "slow"]
    calls = []
    append_results(spark, inputs, path, "id", lambda t: (calls.append(t.count()), t.withColumn("by", F.lit("last")))[1])
    assert calls == [0] and R.read_or_empty(spark, path, None).count() == 20


def test_keys_may_be_null_or_several_and_repeat_within_a_run(spark, scratch):
    path = f"{scratch}/sink"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a")], "id long, kind string")
    base = R.entries(spark, path)
    for by in ("x", "y"):  # both have seen the empty log
        R.append_new_rows(rows.withColumn("by", F.lit(by)), path, ["id", "kind"], base)
    got = R.read_or_empty(spark, path, None)
    assert sorted((r["id"], r["kind"] or "", r["by"]) for r in got.collect()) == [(1, "", "x"), (1, "a", "x"), (2, "a", "x")]


def test_write_json_lines_come_back(spark, scratch):
    rows = [(1, "é \" quote", None), (2, "line\nbreak", [1, 2])]
    df = spark.createDataFrame(rows, "id long, text string, xs array<long>")
    S.write_json(df, f"{scratch}/json")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{scratch}/json").collect())) == sorted(rows)


def by_csv_module(folder):
    import csv

    rows = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", newline="") as f:
            rows += [tuple(None if x == "" or x in S.NA_STRINGS else x for x in row) for row in list(csv.reader(f))[1:]]
    return rows


def test_csv_is_read_by_many_tasks(spark, scratch):
    import csv
    import random

    rng = random.Random(6)
    cells = ["plain", "", "NA", 'a "quoted" word', "two\nlines", '"', '""\n""', "comma, here", " pad ", "\n\n", "é漢😀", "x" * 300, 'end"', "\r\nwin", ","]
    os.mkdir(f"{scratch}/many")
    for name, n, end in (("a", 700, "\n"), ("b", 1, "\r\n"), ("c", 300, "\r\n"), ("d", 0, "\n")):
        with open(f"{scratch}/many/{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "original_text", "rewrite_prompt", "rewritten_text", "cluster"])
            for i in range(n):
                out.writerow([f"{name}{i}", *(rng.choice(cells) for _ in range(3)), i])
    with open(f"{scratch}/many/c.csv", "a") as f:
        f.write('c-last,"no line end",x,"open\nfield",7')
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    want = sorted(map(repr, by_csv_module(f"{scratch}/many")))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lines = spark.read.text(f"{scratch}/many")
        assert lines.rdd.getNumPartitions() > 20
        schema = "id string, original_text string, rewrite_prompt string, rewritten_text string, cluster string"
        got = sorted(repr(tuple(r)) for r in read_pairs_csv(spark, f"{scratch}/many", schema).collect())
        records = S.csv_records(spark, f"{scratch}/many").groupBy("file").agg(F.count("*").alias("n"), F.max("record").alias("m")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(want) == 1002 and got == want
    assert sorted((r["n"], r["m"]) for r in records) == [(1, 0), (2, 1), (302, 301), (701, 700)]


def in_small_splits(spark, work):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return work()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_json_documents_are_read_by_many_tasks(spark, scratch):
    import random

    rng = random.Random(2)
    words = ["plain", "", 'a "quoted" one', "back\\slash", "\\\\", "]}, {[", "comma, here", "é漢😀", "line\nbreak", "\\\"", "x" * 900, "{", "tab\t"]
    records = [{"id": str(i), "prompt": rng.choice(words), "tags": [rng.choice(words) for _ in range(rng.randint(0, 3))],
                "inner": {"a": rng.choice(words), "b": None}} for i in range(200)]
    schema = "id string, prompt string, tags array<string>, inner struct<a:string,b:string>"
    for indent in (None, 2):
        path = f"{scratch}/records-{indent}.json"
        with open(path, "w") as f:
            json.dump(records, f, indent=indent, ensure_ascii=bool(indent))
        tasks, got = in_small_splits(spark, lambda: (spark.read.text(path).rdd.getNumPartitions(), S.read_records_json(spark, path, schema).collect()))
        assert tasks > 20
        assert sorted((r["id"], r["prompt"], r["tags"], r["inner"]["a"], r["inner"]["b"]) for r in got) == sorted(
            (r["id"], r["prompt"], r["tags"], r["inner"]["a"], None) for r in records)
    variations = {f"{i} {rng.choice(words)}": [rng.choice([*words, None]) for _ in range(rng.randint(0, 4))] for i in range(80)}
    listed = [rng.choice(words) for _ in range(150)]
    for name, value in (("v", variations), ("l", listed), ("s", {str(i): f"split {i % 3}" for i in range(90)}), ("none", []), ("empty", {})):
        with open(f"{scratch}/{name}.json", "w") as f:
            json.dump(value, f)
    got = in_small_splits(spark, lambda: S.read_variations_json(spark, f"{scratch}/v.json").collect())
    want = [(k, p, x) for k, xs in variations.items() for p, x in (enumerate(xs) if xs else [(None, None)])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(r[0] for r in in_small_splits(spark, lambda: S.read_string_list_json(spark, f"{scratch}/l.json").collect())) == sorted(listed)
    splits = in_small_splits(spark, lambda: S.read_split_map_json(spark, f"{scratch}/s.json").collect())
    assert sorted(map(tuple, splits)) == [(i, f"split {i % 3}") for i in range(90)]
    assert S.read_string_list_json(spark, f"{scratch}/none.json").count() == 0
    assert S.read_variations_json(spark, f"{scratch}/empty.json").count() == 0
