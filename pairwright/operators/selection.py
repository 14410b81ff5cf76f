"""Greedy selection of prompts whose mean score profile matches a target (K5, K7, K8).

The candidates are laid out in blocks by their scores. The driver keeps the
selection state (the ids chosen so far, the running sum of their score vectors, the
place of the last seed in the seed order), the bounds of at most 4,096
blocks and a bounded number of rows. A table of at most ``kept_rows`` rows is read once, and steps
find their winner by bitmaps (``nearest.py``). In a larger one a step reads
only the blocks whose bounds may hold its winner; where these are too many,
one native aggregate finds the winner of every seed grown side by side.

Energy of a mean profile ``avg``: ``max_r |target_r - avg_r|``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..session import written
from .nearest import Left, Slots, energies
from .sampling import hash_key


def profile_energy(avg: Sequence[float], target: Sequence[float]) -> float:
    return max(abs(t - a) for a, t in zip(avg, target))


def step_energy(scores: str, total: Sequence[float], n: int, target: Sequence[float]) -> Column:
    """New max energy when a candidate joins a set with sum ``total`` of ``n`` vectors."""
    terms = [F.abs(F.lit(float(t)) - (F.lit(float(s)) + F.col(scores)[i]) / F.lit(float(n + 1)))
             for i, (s, t) in enumerate(zip(total, target))]
    return F.greatest(*terms) if len(terms) > 1 else terms[0]


# K5
def best_candidate(candidates: DataFrame, total: Sequence[float], n: int, target: Sequence[float],
                   exclude: Sequence[int] = (), id_col: str = "id", scores: str = "scores"):
    """Candidate with the lowest new max energy (ties: lowest id), or None."""
    pool = candidates.where(~F.col(id_col).isin(list(exclude))) if exclude else candidates
    best = pool.agg(F.min(F.struct(step_energy(scores, total, n, target).alias("energy"),
                                   F.col(id_col).alias("id"), F.col(scores).alias("scores"))).alias("b")).first()["b"]
    return None if best is None else (best["energy"], best["id"], list(best["scores"]))


class Blocks:
    """Candidates laid out by their scores, with the bounds of every block on the driver.

    The dimensions that vary most are cut at their quantiles; candidates in the same cells are a block, and the
    table lies in the shared folder in the order of the blocks. A block's least and largest scores bound the
    energy of all its candidates from below, so a greedy step reads only blocks that may hold the winner. A table of at
    most ``kept_rows`` rows is read as a whole. Of a larger one, or one with a score that is null or not finite, rows that
    were read are kept up to ``kept_rows`` and ``KEPT``; what is left of a step beyond ``read_rows`` is one
    aggregate in Spark. Rows without an id or scores take no part."""

    CUT, AT_MOST, ROWS, KEPT = 3, 4096, 512, 200_000

    def __init__(self, candidates: DataFrame, dims: int, id_col: str = "id", scores: str = "scores",
                 read_rows: int = 20_000, kept_rows: int = 1_000_000):
        self.dims, self.read_rows = dims, read_rows
        rows = candidates.where(F.col(id_col).isNotNull() & F.col(scores).isNotNull())
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(scores).cast("array<double>").alias("scores"))
        of = [F.col("scores")[i] for i in range(dims)]
        spread = rows.agg(F.count(F.lit(1)), *[F.variance(x) for x in of],
                          *[F.percentile_approx(x, [i / 64 for i in range(1, 64)], 1000) for x in of]).first()
        n_cells = min(self.AT_MOST, max(1, spread[0] // self.ROWS))
        cut = sorted(range(dims), key=lambda i: -(spread[1 + i] or 0.0))[:self.CUT]
        per_dim = math.ceil(n_cells ** (1 / len(cut)))
        block = F.lit(0)
        for i in cut:
            quantiles = spread[1 + dims + i] or []
            edges = sorted({quantiles[64 * j // per_dim - 1] for j in range(1, per_dim)}) if quantiles else []
            cell = sum((F.when(of[i] > e, 1).otherwise(0) for e in edges), F.lit(0))
            block = block * per_dim + cell
        laid = rows.withColumn("block", block.cast("int")).repartitionByRange("block").sortWithinPartitions("block")
        self.rows = written(laid, "blocks")
        finite = F.coalesce(reduce(and_, [F.abs(x) < F.lit(math.inf) for x in of]), F.lit(False))
        bounds = self.rows.groupBy("block").agg(F.count(F.lit(1)), *[F.min(x) for x in of], *[F.max(x) for x in of],
                                                F.bool_and(finite)).collect()
        self.number = np.array([r[0] for r in bounds], dtype=np.int64)
        self.size = np.array([r[1] for r in bounds], dtype=np.int64)
        edges = np.array([r[2:-1] for r in bounds], dtype=float).reshape(len(bounds), 2 * dims)
        self.low, self.high = np.ascontiguousarray(edges[:, :dims].T), np.ascontiguousarray(edges[:, dims:].T)
        self.whole = bool(self.size.sum() <= kept_rows and all(r[-1] for r in bounds))
        self.kept_rows = kept_rows if self.whole else min(kept_rows, self.KEPT)
        self.all: Slots | None = None
        self.rest: Left | None = None
        self.kept: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}  # ids in order, vectors as columns; None: in ``all``
        self.home: dict[int, list[int]] = {}  # the kept blocks of an id
        self.scans = 0
        self.batches: dict[tuple, tuple[list, tuple | None]] = {}
        self.failed: dict[tuple, tuple[list[int], set[int]]] = {}

    def least_energy(self, total: np.ndarray, n: int, target: np.ndarray) -> np.ndarray:
        """A lower bound per block for the energy after one of its candidates joined."""
        total, target = total[:, None], target[:, None]
        low, high = (total + self.low) / (n + 1), (total + self.high) / (n + 1)
        return np.maximum(np.maximum(low - target, target - high), 0.0).max(axis=0, initial=0.0)

    def _fetch(self, of: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block numbers, ids and vectors (as columns) of these rows."""
        got = self.rows.where(of).select("block", "id", *[F.col("scores")[i].alias(f"s{i}") for i in range(self.dims)]).toArrow()
        self.scans += 1
        number, ids, *scores = (got.column(i).to_numpy() for i in range(got.num_columns))
        return number, ids, np.array(scores, dtype=float).reshape(self.dims, len(ids))

    def slots(self, target: np.ndarray) -> Slots | None:
        """All rows, read ``KEPT`` at a time, or None if the table isn't kept as a whole."""
        if self.whole and self.all is None:
            ids, vecs = np.empty(self.size.sum(), np.int64), np.empty((self.size.sum(), self.dims))
            order, n, held = np.argsort(self.number), 0, 0
            for i, b in enumerate(order):
                held += self.size[b]
                if i + 1 < len(order) and held + self.size[order[i + 1]] <= self.KEPT:
                    continue
                _, some, columns = self._fetch(F.col("block") <= int(self.number[b]) if n == 0 else
                                               F.col("block").between(low + 1, int(self.number[b])))
                ids[n:n + len(some)], vecs[n:n + len(some)] = some, columns.T
                n, held, low = n + len(some), 0, int(self.number[b])
            self.all, self.kept = Slots(ids, vecs, target), dict.fromkeys(range(len(self.size)))
        return self.all

    def left(self, target: np.ndarray, base: set[int]) -> Left | None:
        """The slots without the ids of ``base``; a round of ``select_until`` goes on from the round before."""
        slots = self.slots(target)
        if slots is not None and (self.rest is None or not self.rest.own <= base):
            self.rest = Left(slots)
        if self.rest is not None:
            for cid in base - self.rest.own:
                self.rest.take(cid)
        return self.rest

    def read(self, blocks: set[int]) -> None:
        """Keep the rows of these blocks; the ones read first go when there are too many."""
        numbers = [int(self.number[b]) for b in sorted(blocks)]
        place = {int(x): b for b, x in enumerate(self.number)}
        number, ids, vecs = self._fetch(F.col("block").isin(numbers))
        order = np.lexsort((*vecs[::-1], ids, number))
        number, ids, vecs = number[order], ids[order].astype(np.int64), vecs[:, order]
        starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(ids) else []
        for i, j in zip(starts, [*starts[1:], len(ids)]):
            b = place[int(number[i])]
            if b in self.kept:
                self._drop(b)
            self.kept[b] = ids[i:j].copy(), np.ascontiguousarray(vecs[:, i:j])
            for x in dict.fromkeys(ids[i:j].tolist()):
                self.home.setdefault(x, []).append(b)
        held = sum(len(ids) for ids, _ in self.kept.values())
        for b in [b for b in self.kept if b not in blocks]:
            if held <= self.kept_rows:
                break
            held -= self._drop(b)

    def _drop(self, b: int) -> int:
        ids, _ = self.kept.pop(b)
        for x in dict.fromkeys(ids.tolist()):
            self.home[x].remove(b)
            if not self.home[x]:
                del self.home[x]
        return len(ids)

    def next_seeds(self, seed, after, count: int):
        """``_seed_batch``; the first 64 batches are read once for all rounds of ``select_until``."""
        key = (seed, after, count)
        if key not in self.batches:
            batch = _seed_batch(self.rows, after, seed, count)
            if len(self.batches) >= 64:
                return batch
            self.batches[key] = batch
        return self.batches[key]

    def best_of(self, wanted: list[tuple[int, np.ndarray, int, set[int], set[int]]], target: np.ndarray) -> dict:
        """One aggregate for several states (key, total, n, chosen ids, blocks): the best candidate of each."""
        spark = self.rows.sparkSession
        taken = pa.table({"state": pa.array([key for key, _, _, chosen, _ in wanted for _ in chosen], pa.int32()),
                          "id": pa.array([int(i) for *_, chosen, _ in wanted for i in chosen], pa.int64())})
        rows = self.rows.where(F.col("block").isin(sorted({int(self.number[b]) for *_, bs in wanted for b in bs})))
        # at most as many rows as the states have chosen
        gone = spark.createDataFrame(taken).groupBy("id").agg(F.collect_list("state").alias("states"))
        rows = rows.join(F.broadcast(gone), "id", "left")
        best = []
        for key, total, n, _, blocks in wanted:
            here = F.col("block").isin([int(self.number[b]) for b in blocks])
            free = F.col("states").isNull() | ~F.array_contains("states", key)
            best.append(F.min(F.when(here & free, F.struct(step_energy("scores", total, n, target).alias("energy"), "id", "scores"))))
        found = rows.agg(*best).first()
        self.scans += 1
        return {key: None if b is None else (b["energy"], b["id"], np.asarray(b["scores"][:self.dims], dtype=float))
                for (key, *_), b in zip(wanted, found)}


class _Trajectory:
    """One greedy cluster grown from one seed."""

    def __init__(self, key: int, seed_id: int, seed_vec: np.ndarray, base: set[int], left: Left | None = None):
        self.key, self.base, self.left = key, base, left
        if left is not None:
            left.take(seed_id)
        self.chosen, self.own = [seed_id], {seed_id}
        self.seed = seed_vec
        self.total = seed_vec.copy()
        self.status = None          # None (running), "ok", "fail", "none"
        self.missing: set[int] = set()  # blocks that this step still has to look at
        self.found = None           # the best of the blocks that an aggregate looked at in this step
        self.looked: set[int] = set()
        self.gone: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # ids of a kept block, which of them are excluded

    def excluded(self) -> set[int]:
        return self.base | self.own

    def gone_of(self, b: int, ids: np.ndarray) -> np.ndarray:
        held = self.gone.get(b)
        if held is None or held[0] is not ids:  # a block that was dropped and read again has new arrays
            gone = np.fromiter((i in self.own or i in self.base for i in ids.tolist()), bool, len(ids))
            held = self.gone[b] = ids, gone
        return held[1]

    def take(self, cid: int, vec: np.ndarray, blocks: Blocks) -> None:
        self.chosen.append(cid)
        self.own.add(cid)
        self.total = self.total + vec
        if self.left is not None:
            self.left.take(cid)
            return
        for b in blocks.home.get(cid, ()):
            ids = blocks.kept[b][0]
            self.gone_of(b, ids)[np.searchsorted(ids, cid):np.searchsorted(ids, cid, "right")] = True
        self.found, self.looked = None, set()

    def best(self, blocks: Blocks, target: np.ndarray):
        """(energy, id, vector) of the step, "none", or None when ``missing`` has to be looked at first."""
        n = len(self.chosen)
        if self.left is not None:
            return self.left.best(self.total, n, target) or "none"
        least = blocks.least_energy(self.total, n, target) * (1 - 1e-9) - 1e-12
        best, self.missing = self.found, set()
        for b in np.argsort(least, kind="stable").tolist():
            if best is not None and least[b] > best[0]:
                break
            if b in self.looked:
                continue
            if b not in blocks.kept:
                if best is None and self.missing and sum(blocks.size[x] for x in self.missing) >= blocks.read_rows // 4:
                    break
                self.missing.add(b)
                continue
            ids, vecs = blocks.kept[b]
            gone = self.gone_of(b, ids)
            if not gone.all():
                e = energies(self.total, n, target, vecs)
                e[gone] = np.inf
                i = int(e.argmin())  # ids ascend within a block
                if best is None or (e[i], ids[i]) < best[:2]:
                    best = (float(e[i]), int(ids[i]), vecs[:, i])
        if self.missing:
            return None
        return best or "none"

    def advance(self, blocks: Blocks, target: np.ndarray, tolerance: float, desired_len: int, most: int | None = None) -> None:
        """Take steps until finished, until ``most`` are chosen or until blocks have to be read."""
        self.missing = set()
        while self.status is None:
            n = len(self.chosen)
            if most is not None and n >= most:
                return
            current = float(np.max(np.abs(target - self.total / n)))
            best = self.best(blocks, target)
            if best is None:
                return
            if best == "none":
                self.status = "none"
                return
            energy, cid, vec = best
            if energy < current or energy < tolerance:
                self.take(cid, vec, blocks)
                continue
            self.status = "ok" if (current <= tolerance or n >= desired_len) else "fail"


def _look(blocks: Blocks, states: list[_Trajectory], target: np.ndarray) -> None:
    """Read the blocks that the states miss, or look at them by an aggregate where they have too many rows.

    The first state leads: what it misses is read up to half of the rows that can be kept, since its next steps look
    there again."""
    rows = 0
    few: set[int] = set()
    many = []
    for t in states:
        size = int(blocks.size[list(t.missing - few)].sum())
        if rows + size <= blocks.read_rows or t is states[0] and size <= blocks.kept_rows // 2:
            few |= t.missing
            rows += size
        else:
            many.append(t)
    if few:
        blocks.read(few)
    if many:
        best = blocks.best_of([(t.key, t.total, len(t.chosen), t.excluded(), t.missing) for t in many], target)
        for t in many:
            t.looked |= t.missing
            if best[t.key] is not None and (t.found is None or best[t.key][:2] < t.found[:2]):
                t.found = best[t.key]


def _seed_batch(pool: DataFrame, after, seed, count: int):
    """The next ``count`` seeds behind the place ``after`` (hash, id) of the seed order, and the new place."""
    keyed = pool.select(hash_key(seed, ["id"]).alias("_h"), "id", "scores")
    if after is not None:
        keyed = keyed.where((F.col("_h") > after[0]) | ((F.col("_h") == after[0]) & (F.col("id") > after[1])))
    rows = keyed.orderBy("_h", "id").limit(count).collect()
    place = (rows[-1]["_h"], rows[-1]["id"]) if rows else after
    return [(r["id"], np.asarray(r["scores"], dtype=float)) for r in rows], place


@dataclass
class GreedyTrace:
    steps: int = 0
    restarts: int = 0
    scans: int = 0
    energies: list = field(default_factory=list)


AHEAD = 64  # what seeds behind the leading one may choose; most that fail do so earlier


# K7
def greedy_profile_match(candidates: DataFrame | Blocks, target: Sequence[float] = FV.TARGET_SCORES,
                         tolerance: float = FV.SELECTION_TOLERANCE,
                         desired_len: int = FV.SELECTION_SIZE, seed=0,
                         id_col: str = "id", scores: str = "scores",
                         trace: GreedyTrace | None = None, exclude: Sequence[int] = (),
                         parallel_seeds: int = 16, seeds_at_once: int = 256) -> list[int] | None:
    """One greedy cluster: start from a seeded random candidate, repeatedly add
    the candidate giving the lowest new max energy while it is lower than the
    current energy or below ``tolerance``.  When none qualifies, return the
    cluster if its energy is within ``tolerance`` or it reached
    ``desired_len``; otherwise restart from the next unused seed.  ``None``
    when candidates or seeds run out.

    Restarts depend only on the seed order, so up to ``parallel_seeds``
    seeds are grown side by side and share each job: the first to its end, the
    others a little ahead while it waits for rows (it never does in a table read as a whole). The result is the first
    seed's outcome in order, as in a sequential run. A seed that failed is not
    grown again while nothing it chose has been excluded since. Ids are distinct; rows
    without an id or scores take no part."""
    trace = trace or GreedyTrace()
    tgt = np.asarray(target, dtype=float)
    blocks = candidates if isinstance(candidates, Blocks) else Blocks(candidates, len(tgt), id_col, scores)
    base = set(exclude)
    before = blocks.scans
    free = blocks.left(tgt, base)
    place = None
    waiting: list[tuple[int, np.ndarray]] = []
    active: list[_Trajectory] = []
    more = True
    key = 0
    try:
        while True:
            while len(active) < parallel_seeds and (waiting or more):
                if not waiting:
                    fresh, place = blocks.next_seeds(seed, place, seeds_at_once)
                    more = len(fresh) == seeds_at_once
                    waiting = [s for s in fresh if s[0] not in base]
                    continue
                sid, vec = waiting.pop(0)
                t = _Trajectory(key, sid, vec[:len(tgt)], base, None if free is None else free.copy())
                chosen, excluded = blocks.failed.get((tgt.tobytes(), tolerance, sid, t.total.tobytes()), (None, base))
                if chosen and len(chosen) < desired_len and excluded <= base and base.isdisjoint(chosen):
                    t.chosen, t.status = chosen, "fail"
                active.append(t)
                key += 1
            if not active:
                return None
            for i, t in enumerate(active):
                leads = all(u.status == "fail" for u in active[:i])
                t.advance(blocks, tgt, tolerance, desired_len, None if leads else AHEAD)
                if leads and t.status in ("ok", "none"):
                    break
            while active and active[0].status is not None:
                head = active.pop(0)
                if head.status == "ok":
                    trace.steps += len(head.chosen) - 1
                    return head.chosen
                if head.status == "none":
                    return None
                trace.restarts += 1
                if len(head.chosen) <= AHEAD and len(blocks.failed) < blocks.kept_rows // AHEAD:
                    blocks.failed[tgt.tobytes(), tolerance, head.chosen[0], head.seed.tobytes()] = head.chosen, base
            need = [t for t in active if t.status is None and t.missing]
            if need:
                _look(blocks, need, tgt)
    finally:
        trace.scans += blocks.scans - before


# K8
def select_until(candidates: DataFrame, target: Sequence[float] = FV.TARGET_SCORES,
                 tolerance: float = FV.SELECTION_TOLERANCE, size: int = FV.SELECTION_SIZE,
                 seed=0, id_col: str = "id", scores: str = "scores",
                 trace: GreedyTrace | None = None) -> list[int]:
    """Repeat the greedy match on the remaining candidates until ``size`` ids
    are selected (the last cluster may overshoot) or no cluster is found."""
    blocks = Blocks(candidates, len(target), id_col, scores)
    selected: list[int] = []
    while len(selected) < size:
        cluster = greedy_profile_match(blocks, target, tolerance, size - len(selected), seed,
                                       trace=trace, exclude=selected)
        if cluster is None:
            break
        selected.extend(cluster)
    return selected
