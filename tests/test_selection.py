"""K5/K7/K8 against a plain list-based model of the greedy profile match."""

import random

import numpy as np
from pyspark.sql import functions as F

from pairwright.operators import nearest as NE
from pairwright.operators import selection as SEL
from pairwright.operators.sampling import hash_key


def model_greedy(vecs, target, th, desired, seed_order, exclude=()):
    """Straightforward transcription of the contract in list form."""
    ids = [i for i in sorted(vecs) if i not in exclude]
    if not ids:
        return None
    seeds = [i for i in seed_order if i not in exclude]
    used = [seeds[0]]
    chosen = [seeds[0]]
    while True:
        n = len(chosen)
        avg = [sum(vecs[c][r] for c in chosen) / n for r in range(len(target))]
        cur = max(abs(t - a) for a, t in zip(avg, target))
        others = [i for i in ids if i not in chosen]
        if not others:
            return None
        total = [sum(vecs[c][r] for c in chosen) for r in range(len(target))]
        scored = sorted(((max(abs(t - (s + vecs[i][r]) / (n + 1)) for r, (s, t) in enumerate(zip(total, target))), i)
                         for i in others))
        e, i = scored[0]
        if e < cur or e < th:
            chosen.append(i)
            continue
        if cur <= th or len(chosen) >= desired:
            return chosen
        rest = [s for s in seeds if s not in used]
        if not rest:
            return None
        used.append(rest[0])
        chosen = [rest[0]]


def _setup(spark, n, k, seed):
    rng = random.Random(seed)
    vecs = {i: [rng.uniform(-0.2, 1.0) ** 3 for _ in range(k)] for i in range(n)}
    target = [rng.uniform(0.1, 0.6) for _ in range(k)]
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()], "id long, scores array<double>").repartition(3)
    order = [r["id"] for r in df.select("id", hash_key(7, ["id"]).alias("h")).orderBy("h", "id").collect()]
    return vecs, target, df, order


def test_greedy_matches_model(spark):
    for case in range(3):
        vecs, target, df, order = _setup(spark, 40, 4, case)
        for th, desired in ((0.005, 10), (0.05, 5), (0.2, 3)):
            trace = SEL.GreedyTrace()
            got = SEL.greedy_profile_match(df, target, th, desired, seed=7, trace=trace)
            assert got == model_greedy(vecs, target, th, desired, order)


def test_select_until_matches_model(spark):
    vecs, target, df, order = _setup(spark, 30, 3, 11)
    got = SEL.select_until(df, target, 0.05, 12, seed=7)
    selected = []
    while len(selected) < 12:
        if not [i for i in vecs if i not in selected]:
            break
        c = model_greedy(vecs, target, 0.05, 12 - len(selected), order, exclude=selected)
        if c is None:
            break
        selected += c
    assert got == selected


def test_best_candidate_ties_take_lowest_id(spark):
    df = spark.createDataFrame([(5, [0.5, 0.5]), (3, [0.5, 0.5]), (9, [0.0, 0.0])], "id long, scores array<double>")
    e, cid, _ = SEL.best_candidate(df, [0.0, 0.0], 0, [0.5, 0.5])
    assert cid == 3 and abs(e) < 1e-12
    assert SEL.best_candidate(df.where(F.lit(False)), [0.0, 0.0], 0, [0.5, 0.5]) is None
    assert np.isclose(SEL.profile_energy([0.1, 0.2], [0.15, 0.5]), 0.3)


def test_registered_queries_equal_the_model(spark):
    import __spark_entry__ as E
    from pairwright.plans import catalog as C

    from .conftest import SF001

    df, target, tolerance = C._selectable(spark, SF001)
    vecs = {r["id"]: list(r["scores"]) for r in df.collect()}
    order = [r["id"] for r in df.select("id", hash_key(C.SEED, ["id"]).alias("h")).orderBy("h", "id").collect()]
    want = model_greedy(vecs, target, tolerance, 1500, order)
    got = [r["id"] for r in E.queries()["greedy_profile_match"](spark, SF001).orderBy("step").collect()]
    assert got and got == want and got[0] != order[0]  # seeds before it failed
    until = [r["id"] for r in E.queries()["select_until"](spark, SF001).orderBy("rank").collect()]
    assert until[:len(got)] == got and len(set(until)) == len(until)


def test_blocks_read_or_looked_at_by_aggregates_give_the_same_cluster(spark, monkeypatch):
    monkeypatch.setattr(SEL.Blocks, "ROWS", 6)
    vecs, target, df, order = _setup(spark, 60, 3, 5)
    want = model_greedy(vecs, target, 0.03, 8, order)
    for read, kept in ((1000, 1000), (12, 24), (0, 0)):  # all rows kept, few, none: every step is an aggregate
        blocks = SEL.Blocks(df, 3, read_rows=read, kept_rows=kept)
        assert len(blocks.size) > 4 and blocks.size.sum() == 60
        trace = SEL.GreedyTrace()
        got = SEL.greedy_profile_match(blocks, target, 0.03, 8, seed=7, parallel_seeds=4, seeds_at_once=5, trace=trace)
        assert got == want
        assert (len(blocks.kept) == 0) == (read == 0)


def test_few_blocks_are_read_for_a_target_inside_the_cloud(spark, monkeypatch):
    monkeypatch.setattr(SEL.Blocks, "ROWS", 20)
    vecs, _, df, order = _setup(spark, 2000, 2, 3)
    blocks = SEL.Blocks(df, 2, read_rows=40)
    total, target = np.array(vecs[order[0]]), np.array([0.2, 0.2])
    least = blocks.least_energy(total, 1, target)
    exact = {i: max(abs(t - (s + x) / 2) for t, s, x in zip(target, total, v)) for i, v in vecs.items()}
    assert (least <= min(exact.values())).sum() < len(least) / 4


def test_no_candidates_and_null_scores(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, None), (None, [0.1, 0.2])], "id long, scores array<double>")
    assert SEL.greedy_profile_match(df.where("id = 9"), [0.5, 0.5], 0.01, 5) is None
    assert SEL.select_until(df, [0.5, 0.5], 0.01, 5) == []  # one candidate can't be joined by another


def _normal_rows(spark):
    vecs = np.random.default_rng(5).normal(size=(600, 3)).round(3)
    return vecs.mean(axis=0), spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "id long, scores array<double>")


def test_seeds_behind_the_leading_one_stay_close(spark, monkeypatch):
    mean, df = _normal_rows(spark)
    grown = {}
    advance = SEL._Trajectory.advance

    def seen(self, *args, **kw):
        advance(self, *args, **kw)
        grown[self.key] = len(self.chosen)

    monkeypatch.setattr(SEL._Trajectory, "advance", seen)
    monkeypatch.setattr(SEL.Blocks, "ROWS", 8)
    got = SEL.greedy_profile_match(SEL.Blocks(df, 3, read_rows=40), list(mean + 0.25), 0.2, 8, seed=1)
    assert len(got) > 500
    assert sum(grown.values()) < len(got) + 16 * 64


def test_a_failed_seed_is_not_grown_in_the_next_round(spark, monkeypatch):
    mean, df = _normal_rows(spark)
    args = list(mean + 0.05), 0.01, 8
    blocks, trace = SEL.Blocks(df, 3), SEL.GreedyTrace()
    first = SEL.greedy_profile_match(blocks, *args, seed=1, trace=trace)
    assert trace.restarts > 10
    failed = {chosen[0] for chosen, _ in blocks.failed.values() if not set(chosen) & set(first)}
    grown = []
    best = SEL._Trajectory.best
    monkeypatch.setattr(SEL._Trajectory, "best", lambda self, *a: grown.append(self) or best(self, *a))
    second = SEL.greedy_profile_match(blocks, *args, seed=1, exclude=first)
    again = {t.chosen[0] for t in grown}
    assert failed and not again & failed
    assert second == SEL.greedy_profile_match(SEL.Blocks(df, 3), *args, seed=1, exclude=first)


def test_a_table_that_fits_is_read_once(spark, monkeypatch):
    mean, df = _normal_rows(spark)
    monkeypatch.setattr(SEL.Blocks, "ROWS", 8)
    trace = SEL.GreedyTrace()
    got = SEL.greedy_profile_match(SEL.Blocks(df, 3, read_rows=40), list(mean + 0.25), 0.2, 8, seed=1, trace=trace)
    assert len(got) > 500 and trace.scans == 1
    monkeypatch.setattr(SEL.Blocks, "KEPT", 100)
    parts, trace = SEL.Blocks(df, 3), SEL.GreedyTrace()
    assert SEL.greedy_profile_match(parts, list(mean + 0.25), 0.2, 8, seed=1, trace=trace) == got and trace.scans >= 6
    assert parts.all.sorted_ids.tolist() == list(range(600))


def _cubes(n, dims, copies, seed):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(scale=0.3, size=(n, dims)) ** 3
    vecs[n - copies:] = vecs[rng.integers(0, n - copies, copies)]
    return rng.permutation(n).astype(np.int64), vecs


def _walk(ids, vecs, target, steps, gone=()):
    """The ids of a greedy walk from the first row, every energy computed."""
    left = ~np.isin(ids, [*gone, ids[0]])
    total, n, walk = vecs[0].copy(), 1, []
    while len(walk) < steps and left.any():
        e = np.abs(target - (total + vecs) / (n + 1)).max(axis=1)
        i = min(np.flatnonzero(left & (e == e[left].min())), key=lambda i: ids[i])
        walk.append((int(ids[i]), e[i]))
        total, n, left = total + vecs[i], n + 1, left & (ids != ids[i])
    return walk


def _walk_of_slots(ids, vecs, target, steps, gone=()):
    rest = NE.Left(NE.Slots(ids, vecs, target))
    for cid in gone:
        rest.take(cid)
    left = rest.copy()
    left.take(int(ids[0]))
    total, n, walk = vecs[0].copy(), 1, []
    while len(walk) < steps and (found := left.best(total, n, target)):
        walk.append((found[1], found[0]))
        left.take(found[1])
        total, n = total + found[2], n + 1
    return walk


def test_bitmaps_find_every_winner(monkeypatch):
    monkeypatch.setattr(NE, "SAMPLE", 16)
    for n, dims, copies, seed in ((700, 4, 0, 1), (700, 5, 400, 2), (500, 1, 100, 3), (300, 3, 290, 4)):
        ids, vecs = _cubes(n, dims, copies, seed)
        ids[5:25] = ids[25:45]  # rows that share an id go together
        target = vecs.mean(axis=0) + 0.01
        for gone in ((), ids[100:300].tolist()):
            want = _walk(ids, vecs, target, n, gone)
            assert _walk_of_slots(ids, vecs, target, n, gone) == want and len(want) >= (n - 220 if not gone else 50)


def test_a_step_computes_few_energies(spark, monkeypatch):
    ids, vecs = _cubes(40_000, 6, 0, 6)
    target = vecs.mean(axis=0) + 0.002
    seen = []
    real = NE.energies
    monkeypatch.setattr(NE, "energies", lambda *a: seen.append(a[3].shape[1]) or real(*a))
    assert _walk_of_slots(ids, vecs, target, 300) == _walk(ids, vecs, target, 300)
    assert sum(seen) < 300 * 40_000 / 10


def test_rounds_read_the_table_once(spark, monkeypatch):
    mean, df = _normal_rows(spark)
    monkeypatch.setattr(SEL.Blocks, "ROWS", 8)
    vecs = {r["id"]: list(r["scores"]) for r in df.collect()}
    order = [r["id"] for r in df.select("id", hash_key(7, ["id"]).alias("h")).orderBy("h", "id").collect()]
    args, want, rounds = (list(mean + 0.05), 0.02), [], 0
    while len(want) < 60 and (c := model_greedy(vecs, *args, 60 - len(want), order, exclude=want)):
        want, rounds = want + c, rounds + 1
    trace = SEL.GreedyTrace()
    assert SEL.select_until(df, *args, 60, seed=7, trace=trace) == want
    assert rounds > 1 and trace.scans == 1
