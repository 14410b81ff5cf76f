from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pairwright.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 7, "clash") for i, s, t in rows], SCHEMA)


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Shares by weight, the excess over the cap shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal = share * sum(sizes.values())
    out, free = {}, set(order)
    while free:
        level = (goal - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def rows_for_test():
    rows = [(i, f"s{i % 4}", "w " * (20 + i % 90)) for i in range(400)]
    rows += [(1000 + i, None, "null source words") for i in range(30)]
    return rows + [(2000, "blank", None), (2001, "blank", " \n"), (2002, "s1", ""), (2003, "s3", "x " * 20_000), (2004, "Z", "a b c")]


def test_mix_against_brute_force(spark):
    rows = rows_for_test()
    got = mixing.taken_words(mixing.mix(frame(spark, rows), block=16, per_shard=256)).collect()
    size = {i: len((t or "").split()) for i, _, t in rows}
    total, taken = Counter(), Counter()
    for i, s, _ in rows:
        total[s] += size[i]
    want = targets(total)
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 3, s


def test_reruns_agree_however_rows_are_dealt(spark):
    df = frame(spark, rows_for_test())
    first, second = (
        sorted(map(tuple, mixing.taken_words(mixing.mix(d)).collect())) for d in (df, df.orderBy(F.desc("doc_id")).repartition(7))
    )
    assert first == second


def test_blocks_are_whole_texts_cut_in_pieces(spark):
    rows = [(i, "ab"[i % 2], " ".join(f"w{i}_{j}" for j in range(5 + 3 * i))) for i in range(30)]
    mixed = mixing.mix(frame(spark, rows), block=8, with_text=True)
    words = {i: t.split() for i, _, t in rows}
    slots = defaultdict(list)
    for r in mixed["blocks"].collect():
        assert r["text"].split() == words[r["doc_id"]][r["from"] : r["to"]]
        slots[r["shard"], r["slot"]].append((r["source_no"], r["index"], r["to"] - r["from"]))
    for pieces in slots.values():
        assert len({p[:2] for p in pieces}) == 1 and sum(p[2] for p in pieces) <= 8


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), 5).alias("x"))
        assert sorted(r["x"] for r in df.collect()) == list(range(n))


def test_empty_and_blank_tables(spark):
    assert mixing.taken_words(mixing.mix(frame(spark, []))).count() == 0
    got = mixing.taken_words(mixing.mix(frame(spark, [(1, "a", None), (1, "a", None), (2, None, " ")]))).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 3
