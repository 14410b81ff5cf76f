"""Spelling variant grouping (12) by search schemes over a bidirectional FM-index.

Two words are near if they differ by one inserted, deleted or replaced code point. The error is in one half of
the word, so the other half occurs exactly: the search matches the first half exactly and extends to the
right across the second with at most one error, and the other way round. Both are backward searches over an FM-index of the
delimited vocabulary: extending to the right uses the index of the reversed words, extending to
the left that of the words. Extensions go by suffix-rank intervals; a delimiter at both ends makes an interval one word.

The index of either direction is cut into blocks of bounded size by ranges of the words (or of the reversed words), so an
exact half concerns the blocks whose range it meets. Blocks and the queries that are routed to them meet in one
task per block and portion of queries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import stash

RUN = "[A-Za-z\\u00C0-\\u00FF]+"  # fixed by the contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS, BLOCK_CHARS = 1 << 15, 1 << 20
PORTION = 50_000  # queries that meet a block in one task
AT_ONCE = 8_000  # queries that are searched together


def occurrences(docs: DataFrame, id_col: str, text_col: str, strip_one_in: int = 97) -> DataFrame:
    """Every run of letters as a ``word`` in lower case; where ``strip_one_in`` divides the crc32 h of
    `<id>:<run>`, without its code point h % length. A null id counts as the empty string there."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), 0))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.where(F.length("run") >= 5).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % strip_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, least: int = 3) -> DataFrame:
    """word, n: the words of at least ``length`` (5 or more) code points with at least ``least`` occurrences."""
    words = occurrences(docs, id_col, text_col).where(F.length("word") >= max(length, 5))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class HalfIndex:
    """FM-index of reversed strings between delimiters: extends a match to the right, code point by code point."""

    def __init__(self, strings: list[str]):
        text = "\0" + "\0".join(s[::-1] for s in strings) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        n = self.n = len(codes)
        order = suffix_order(codes)
        self.bwt = codes[order - 1]
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.occurs = self.bwt[by_symbol] * (n + 1) + by_symbol  # sorted by symbol, then place
        self.back = np.empty(n, np.int64)  # rank of the suffix that is one symbol longer
        self.back[by_symbol] = np.arange(n)
        # ranks of the suffixes that begin with a delimiter, hence of the words; the last is the end of the text
        start = np.flatnonzero(codes == 0)[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.word = np.full(len(start) + 1, -1)
        self.word[rank[start]] = np.arange(len(start))

    def encode(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol; empty ones have lo >= hi."""
        one = hi - lo == 1
        new_lo, new_hi = np.zeros_like(lo), np.zeros_like(hi)
        same = one.copy()
        same[one] = self.bwt[lo[one]] == symbol[one]
        new_lo[same] = self.back[lo[same]]
        new_hi[same] = new_lo[same] + 1
        many = ~one
        key = symbol[many] * (self.n + 1)
        new_lo[many] = np.searchsorted(self.occurs, key + lo[many])
        new_hi[many] = np.searchsorted(self.occurs, key + hi[many])
        return new_lo, new_hi

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the symbols that extend it, delimiters apart: places of intervals and symbols."""
        size = hi - lo
        wide = size > 4 * len(self.alphabet)
        row = np.repeat(np.flatnonzero(~wide), size[~wide])
        at = np.arange(len(row)) - np.repeat(np.cumsum(size[~wide]) - size[~wide], size[~wide]) + lo[row]
        few = np.unique(row * len(self.alphabet) + self.bwt[at])
        tried = np.repeat(np.flatnonzero(wide), len(self.alphabet)) * len(self.alphabet) + np.tile(np.arange(len(self.alphabet)), wide.sum())
        row, symbol = np.divmod(np.concatenate([few, tried]), len(self.alphabet))
        return row[symbol > 0], symbol[symbol > 0]

    def near(self, strings: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (string, word) at one error, for the words that begin with the first ``exact`` code points of the string.

        Equal code points beside an inserted or deleted one: the last place of the run stands for all."""
        length = np.array([len(s) for s in strings])
        points = self.encode(np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32))
        points = np.append(points, 0)
        start = np.cumsum(length) - length
        q = np.arange(len(strings))
        lo, hi = self.extend(np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n))
        ahead = (q[:0], lo[:0], hi[:0])  # one error made, before code point i
        found = []
        i = 0
        while len(q) or len(ahead[0]):
            symbol = points[start[q] + np.minimum(i, length[q])]
            inside = i < length[q]
            branch = np.flatnonzero(i >= exact[q])
            if len(branch):
                heads, of = np.unique(lo[branch] * (self.n + 1) + hi[branch], return_inverse=True)
                row, c = self.symbols(heads // (self.n + 1), heads % (self.n + 1))
                c_lo, c_hi = self.extend(c, heads[row] // (self.n + 1), heads[row] % (self.n + 1))
                kept = c_lo < c_hi
                row, c, c_lo, c_hi = row[kept], c[kept], c_lo[kept], c_hi[kept]
                first = np.searchsorted(row, np.arange(len(heads) + 1)) if (np.diff(row) >= 0).all() else None
                if first is None:
                    order = np.argsort(row, kind="stable")
                    row, c, c_lo, c_hi = row[order], c[order], c_lo[order], c_hi[order]
                    first = np.searchsorted(row, np.arange(len(heads) + 1))
                n = first[of + 1] - first[of]
                at = np.arange(n.sum()) + np.repeat(first[of] - np.cumsum(n) + n, n)
                state = branch.repeat(n)
                other = ~inside[state] | (c[at] != symbol[state])
                at, state = at[other], state[other]
                ahead = tuple(np.concatenate(x) for x in zip(ahead, (q[state], c_lo[at], c_hi[at])))  # inserted
                replaced = inside[state]
                at, state = at[replaced], state[replaced]
                after = points[start[q[branch]] + np.minimum(i + 1, length[q[branch]])]
                last = inside[branch] & ((i + 1 >= length[q[branch]]) | (after != symbol[branch]))
                drop = branch[last]
                later = (np.append(q[state], q[drop]), np.append(c_lo[at], lo[drop]), np.append(c_hi[at], hi[drop]))
            else:
                later = (q[:0], lo[:0], hi[:0])
            e, e_lo, e_hi = ahead
            e_inside = i < length[e]
            e_symbol = np.where(e_inside, points[start[e] + np.minimum(i, length[e])], 0)
            e_lo, e_hi = self.extend(e_symbol, e_lo, e_hi)
            kept = e_lo < e_hi
            done = kept & ~e_inside
            found.append((e[done], self.word[e_lo[done]]))
            kept &= e_inside
            ahead = tuple(np.concatenate(x) for x in zip((e[kept], e_lo[kept], e_hi[kept]), later))
            q, symbol, lo, hi = q[inside], symbol[inside], lo[inside], hi[inside]
            lo, hi = self.extend(symbol, lo, hi)
            kept = lo < hi
            q, lo, hi = q[kept], lo[kept], hi[kept]
            i += 1
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order, by doubling the compared length."""
    n = len(codes)
    rank = codes.astype(np.int64)
    size = 1
    while True:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        size *= 2


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, n) as blocks of bounded size."""
    number = TaskContext.get().partitionId() << 32
    keys: list[str] = []
    counts: list[int] = []
    size = 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [number], "first": [keys[0]], "last": [keys[-1]], "keys": [keys], "counts": [counts]})

    for batch in batches:
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if keys and (len(keys) >= BLOCK_WORDS or size + len(key) > BLOCK_CHARS):
                yield block()
                number, keys, counts, size = number + 1, [], [], 0
            keys.append(key)
            counts.append(n)
            size += len(key) + 1
    if keys:
        yield block()


def _route(blocks: list[tuple[str, str, int]]):
    """Column of the blocks whose range meets the strings that begin with ``key[:exact]``."""
    firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]

    @F.pandas_udf("array<long>")
    def route(key: pd.Series, exact: pd.Series) -> pd.Series:
        heads = (k[:e] for k, e in zip(key, exact))
        return pd.Series([[b[2] for b in blocks[bisect_left(lasts, h) : bisect_right(firsts, h + "\U0010ffff")]] for h in heads])

    return route


def _search(backward: bool):
    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["word", "n_near", "best_n", "best"]
        if not len(block) or not len(queries):
            return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
        keys, counts = block.column("keys")[0].as_py(), np.array(block.column("counts")[0].as_py())
        words = [k[::-1] for k in keys] if backward else keys
        place = np.empty(len(words), np.int64)  # in code-point order
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        index = HalfIndex(keys)
        asked, exact = queries.column("key").to_pylist(), queries.column("exact").to_numpy()
        out: list[tuple[list, ...]] = []
        for i in range(0, len(asked), AT_ONCE):
            part = asked[i : i + AT_ONCE]
            q, w = index.near(part, exact[i : i + AT_ONCE])
            if backward:  # words that begin with the first half as well are found by the other search
                half = [len(s) // 2 for s in part]
                new = np.array([not keys[b].endswith(part[a][len(part[a]) - half[a] :]) for a, b in zip(q.tolist(), w.tolist())], bool)
                q, w = q[new], w[new]
            if not len(q):
                continue
            order = np.lexsort((place[w], -counts[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            texts = [part[a][::-1] if backward else part[a] for a in q[first].tolist()]
            out.append((texts, np.diff(np.append(first, len(q))).tolist(), counts[w[first]].tolist(), [words[b] for b in w[first].tolist()]))
        columns = [[x for part in out for x in part[k]] for k in range(4)]
        return pa.table([pa.array(c, pa.string() if k in (0, 3) else pa.int64()) for k, c in enumerate(columns)], names=names)

    return search


def _half(vocab: DataFrame, total: int, key: Column, exact: Column, backward: bool) -> DataFrame:
    """word, n_near, best_n, best per word and block, for the near words with the same first half of ``key``."""
    spark = vocab.sparkSession
    rows = vocab.select(key.alias("key"), exact.cast("int").alias("exact"), "n")
    parts = total // (4 * BLOCK_WORDS) + 1
    packed = rows.select("key", "n").repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = stash(packed.mapInArrow(_pack, "block long, first string, last string, keys array<string>, counts array<long>"), "blocks")
    ranges = sorted((r["first"], r["last"], r["block"]) for r in blocks.select("first", "last", "block").collect())
    routed = stash(rows.select("key", "exact", F.explode(_route(ranges)("key", "exact")).alias("block")), "routed")
    sizes = {r["block"]: r["count"] for r in routed.groupBy("block").count().collect()}
    portions = spark.createDataFrame([(b, (sizes.get(b, 0) - 1) // PORTION + 1) for *_, b in ranges], "block long, portions long")
    tasks = sum((n - 1) // PORTION + 1 for n in sizes.values())
    pieces = blocks.join(portions, "block").withColumn("portion", F.explode(F.expr("sequence(0L, greatest(portions, 1L) - 1)")))
    asked = routed.join(portions, "block").withColumn("portion", F.pmod(F.xxhash64("key"), F.greatest("portions", F.lit(1))))
    pieces = pieces.select("block", "portion", "keys", "counts").repartition(max(tasks, 1), "block", "portion")
    asked = asked.select(F.col("block").alias("at"), F.col("portion").alias("part"), "key", "exact").repartition(max(tasks, 1), "at", "part")
    return (
        pieces.groupBy("block", "portion").cogroup(asked.groupBy("at", "part"))
        .applyInArrow(_search(backward), "word string, n_near long, best_n long, best string")
    )


def variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n) of distinct words.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n is at least ``factor`` (2 or
    more) times the word's own, else null, as is ``form_n``; ``root`` follows the forms to the last one. Null words are
    left out. Words of any length are searched whole; an empty table gives an empty table. The driver holds the
    range of each block of 32,768 words, nothing of the words themselves.
    """
    vocab = stash(vocab.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    total = vocab.count()
    length = F.length("word")
    half = F.floor(length / 2)
    both = _half(vocab, total, F.col("word"), half, False).unionByName(_half(vocab, total, F.reverse("word"), length - half, True))
    best = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("m"))
    best = best.select("word", "n_near", (-F.col("m.n")).alias("best_n"), F.col("m.best").alias("best"))
    rows = vocab.join(best, "word", "left")
    larger = F.col("best_n") >= factor * F.col("n")
    rows = rows.select(
        "word", F.when(larger, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, F.col("best_n")).alias("form_n"),
    )
    rows = stash(rows, "forms")
    return rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root for links (word, form): every round doubles the steps that are followed. Links form no circle, as
    n at least doubles with each; so there are about as many rounds as the logarithm of the longest chain."""
    links = forms.withColumnRenamed("form", "root")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(ahead, "root", "left")
        moved = stash(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return links


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the vocabulary of a corpus. Null texts have no words; repeated rows count as they stand; other
    columns are not read, so their names can't clash."""
    return variants(vocabulary(docs, id_col, text_col))
