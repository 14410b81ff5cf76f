import random

import numpy as np

from pairwright.llm import near_dedup
from pairwright.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, n int, rep string"


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        n = min(k, len(words))
        out[i] = frozenset(tuple(words[p : p + n]) for p in range(len(words) - n + 1)) if n else frozenset()
    return out


def brute(rows, k, threshold):
    sets = sets_of(rows, k)
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def rows_for_test(seed=6):
    rng = random.Random(seed)
    rows = []
    for g in range(6):  # groups of near copies, many of them just below or above the threshold
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(120)] = f"e{rng.randint(0, 10_000)}"
            rows.append(" ".join(words))
    rows += ["one", "ONE", "one two", "two one", "", None, " \n", "a b c", "a  b\tc", "a b c d", "x " * 20_000]
    rows += [rows[3]] * 30
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows, k, threshold):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(df, k=k, threshold=threshold)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return got.collect()


def test_against_brute_force(spark):
    rows = rows_for_test()
    got = {r[0]: tuple(r)[1:] for r in result(spark, rows, 3, 85)}
    assert got == brute(rows, 3, 85)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = rows_for_test(8)
    got = {r[0]: tuple(r)[1:] for r in result(spark, rows, 5, 80)}
    assert got == brute(rows, 5, 80)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "some words that are here twice in a row of words"
    got = result(spark, [(None, text), (7, text), (7, text), (9, text)], 5, 80)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", True)
    ]
    assert result(spark, [], 5, 80) == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        extra = rng.integers(0, 2**63, (2, n // 4), dtype=np.uint64)
        a, b = np.unique(np.concatenate((common, extra[0]))), np.unique(np.concatenate((common, extra[1])))
        marks = near_dedup.sketch([a, b], 512)
        assert (marks != np.iinfo(np.uint64).max).all()
        assert abs((marks[0] == marks[1]).mean() - n / (n + 2 * (n // 4))) < 0.12


def test_equal_sets_have_equal_sketches():
    a, b = shingle_sets(["the same words in it", "THE  same\nwords in it"], 3)
    assert np.array_equal(near_dedup.sketch([a]), near_dedup.sketch([b]))
