"""Exact top-k search (11) by no-random-access aggregation over sorted lists.

The score of a vector is the sum of one contribution per dimension, and every dimension has a list of
the vectors sorted by it. For a query the lists are read from their best ends, all down to one frontier
of contribution; then the frontier sinks. A vector's upper bound is what was read of it plus, for each list in which it
wasn't met, the frontier; its lower bound takes the least that lists give instead. Reading stops
when outsiders can't reach the k-th best score that is sure; the vectors that are left are resolved to their final scores.

The lists are written in blocks of bounded size. Every block first answers the queries among its own vectors; the k-th score
there is a bound that the other blocks start from. Then portions of queries meet blocks, one
pair in a task, and the best k of all blocks are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import stash

BLOCK_NUMBERS = 1 << 19  # components in a block
PORTION = 1 << 13  # queries that meet a block in one task
EXACT = float(1 << 53)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null for vectors that are null or hold null or other than finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """A block of vectors with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exact = vectors.astype(float)  # sums below 2**53 are exact
        columns = np.ascontiguousarray(vectors.T)
        self.order = np.argsort(columns, axis=1, kind="stable")  # per dimension, ascending
        self.values = np.take_along_axis(columns, self.order, axis=1).astype(float)
        self.largest = np.abs(vectors).max(axis=0, initial=0).astype(float)

    def best(self, query: np.ndarray, k: int, bound: float, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors whose score is at least ``bound``; ``own`` takes no part.

        Ties go to the smaller id."""
        n, dims = self.vectors.shape
        if float(np.abs(query) @ self.largest) >= EXACT:
            raise ValueError("scores of 2**53 and more are not exact")
        used = np.flatnonzero(query)
        weight = query[used].astype(float)
        up = weight > 0
        head = weight * np.where(up, self.values[used, -1], self.values[used, 0])
        tail = weight * np.where(up, self.values[used, 0], self.values[used, -1])
        others = np.arange(n) != own
        if n - (own >= 0) > k:
            bound = max(bound, self.first_bound(query, used, up, head, k, own))
        total, met = np.zeros(n), np.zeros(n)
        least = np.minimum(tail, 0).sum()  # what the lists in which a vector wasn't met give at the least
        read = np.zeros(len(used), np.int64)
        for frontier in frontiers(head, tail, bound):
            ids, gains = [], []
            for j, (d, w, edge) in enumerate(zip(used.tolist(), weight.tolist(), (frontier / weight).tolist())):
                values = self.values[d]
                if w > 0:
                    to = n - int(values.searchsorted(edge, "right"))
                    part = slice(n - to, n - read[j])
                else:
                    to = int(values.searchsorted(edge, "left"))
                    part = slice(read[j], to)
                if to > read[j]:
                    ids.append(self.order[d, part])
                    gains.append(w * values[part])
                    read[j] = to
            if ids:
                at = np.concatenate(ids)
                total += np.bincount(at, np.concatenate(gains), n)
                met += np.bincount(at, minlength=n)
            upper = total - met * frontier + np.minimum(frontier, head).sum()
            if n - (own >= 0) > k:
                lower = np.where(others, total + least, -np.inf)
                first = np.argpartition(lower, n - min(2 * k, n - 1))[n - min(2 * k, n - 1):]
                first = first[others[first]]
                sure = np.sort(np.maximum(lower[first], self.exact[first] @ query.astype(float)))  # the leaders are resolved
                if len(sure) >= k:
                    bound = max(bound, float(sure[-k]))
            alive = np.flatnonzero((upper >= bound) & others)
            if len(alive) <= max(4 * k, n // 4):
                break
        scores = (self.exact[alive] @ query.astype(float)).astype(np.int64)
        kept = scores >= bound
        alive, scores = alive[kept], scores[kept]
        first = np.lexsort((self.ids[alive], -scores))[:k]
        return alive[first], scores[first]

    def first_bound(self, query: np.ndarray, used: np.ndarray, up: np.ndarray, head: np.ndarray, k: int, own: int) -> float:
        """The k-th best score among the heads of the lists that can give most."""
        n = len(self.vectors)
        lists = np.argsort(-head)[:8]
        heads = [self.order[used[j], max(n - 2 * k, 0) :] if up[j] else self.order[used[j], : 2 * k] for j in lists]
        some = np.unique(np.concatenate(heads)) if heads else np.arange(0)
        some = some[some != own]
        return float(np.partition(self.exact[some] @ query.astype(float), len(some) - k)[len(some) - k]) if len(some) >= k else -math.inf


def frontiers(head: np.ndarray, tail: np.ndarray, bound: float) -> Iterator[float]:
    """Falling frontiers: first where a vector that no list has shown can't reach the bound, last where all lists are read."""
    end = float(tail.min(initial=0.0)) - 1.0
    if not len(head) or bound == -math.inf:
        yield end
        return
    top = np.sort(head)[::-1]
    # sum of min(f, head) = bound: the lists whose head is below f give their head
    below = np.append(np.cumsum(top[::-1])[::-1][1:], 0.0)
    f = next((v for i in range(len(top)) if (v := (bound - below[i]) / (i + 1)) >= (top[i + 1] if i + 1 < len(top) else -math.inf)), float(top[0]))
    step = max(abs(f), float(top[0]) / 64, 1.0)
    for share in (0.8, 1.0, 1.25, 1.75, 3.0):
        if f - share * step <= end:
            break
        yield f - share * step
    yield end


_BLOCK = "block long, dims int, ids array<long>, numbers array<long>"
_QUERY = "block long, place int, dims int, query_id long, vector array<long>, bound double"


def _lists(row: dict) -> Lists:
    ids = np.asarray(row["ids"], np.int64)
    return Lists(ids, np.asarray(row["numbers"], np.int64).reshape(len(ids), row["dims"]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) as blocks of one dimension each."""
    number = TaskContext.get().partitionId() << 32
    held: dict[int, tuple[list, list]] = {}

    def block(dims: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dims)
        numbers = [x for v in vectors for x in v]
        return pa.RecordBatch.from_pydict(
            {"block": [number], "dims": [dims], "ids": [ids], "numbers": [numbers]},
            schema=pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))]),
        )

    for batch in batches:
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(i)
            vectors.append(vector)
            if len(ids) * max(len(vector), 64) >= BLOCK_NUMBERS:
                yield block(len(vector))
                number += 1
    for dims in list(held):
        yield block(dims)
        number += 1


def _own_queries(every: int, k: int):
    """The queries among the vectors of a block, with the k-th best score in the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = _lists(row)
                asked = np.flatnonzero(lists.ids % every == 0)
                bounds = []
                for place in asked.tolist():
                    _, scores = lists.best(lists.vectors[place], k, -math.inf, place)
                    bounds.append(float(scores[-1]) if len(scores) == k else -math.inf)
                n = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(asked, pa.int32()), pa.array([row["dims"]] * n, pa.int32()),
                     pa.array(lists.ids[asked]), pa.array(lists.vectors[asked].tolist(), pa.list_(pa.int64())), pa.array(bounds, pa.float64())],
                    names=["block", "place", "dims", "query_id", "vector", "bound"],
                )

    return rows


def _answers(k: int):
    def answer(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(block):
            lists = _lists(block.to_pylist()[0])
            own_block = block.column("block")[0].as_py()
            for row in queries.to_pylist():
                own = row["place"] if row["from"] == own_block else -1
                at, scores = lists.best(np.array(row["vector"], np.int64), k, row["bound"], own)
                out[0] += [row["from"]] * len(at)
                out[1] += [row["place"]] * len(at)
                out[2] += [row["query_id"]] * len(at)
                out[3] += lists.ids[at].tolist()
                out[4] += scores.tolist()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["from", "place", "query_id", "vec_id", "score"])

    return answer


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` the ``k`` highest inner products
    of floor(``scale`` * x) with all other rows (all, if fewer), ties to the smaller id.

    Rows are told apart by place: repeated rows are candidates of each other, and a repeated query row has
    its own result rows. Vectors that are null or hold null or other than finite components and rows without an id
    take no part. Vectors are compared with those of their own length. Scores of 2**53 and more are refused with an
    error. Other columns are not read. Empty in, empty out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"))
    rows = stash(rows.where("id is not null and v is not null"), "numbers")
    size = rows.agg(F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(64))), F.lit(0))).first()[0]
    blocks = stash(rows.repartition(math.ceil(size / BLOCK_NUMBERS) or 1).mapInArrow(_pack, _BLOCK), "lists")
    queries = stash(blocks.mapInArrow(_own_queries(every, k), _QUERY), "queries")
    n_blocks, n_queries = blocks.count(), queries.count()
    portions = n_queries // PORTION + 1
    ids = blocks.select(F.col("block").alias("to"), F.col("dims").alias("of")).distinct()
    # every query meets every block of its length: the block numbers are listed per length, not multiplied as rows
    listed = ids.groupBy("of").agg(F.collect_list("to").alias("to"))
    asked = queries.withColumnRenamed("block", "from").join(listed, F.col("dims") == F.col("of")).drop("of", "dims")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("from", "place"), F.lit(portions))).withColumn("to", F.explode("to"))
    tiles = blocks.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))))
    tasks = max(1, n_blocks * portions)
    answers = (
        tiles.repartition(tasks, "block", "portion").groupBy("block", "portion")
        .cogroup(asked.repartition(tasks, "to", "part").groupBy("to", "part"))
        .applyInArrow(_answers(k), "from long, place int, query_id long, vec_id long, score long")
    )
    by_score = Window.partitionBy("from", "place").orderBy(F.desc("score"), "vec_id")
    best = answers.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
