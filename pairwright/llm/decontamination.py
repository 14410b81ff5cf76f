"""Benchmark decontamination (4) by latent semantic retrieval.

1. Terms are the words of the benchmark items (letters and digits, in lower case). Document frequencies
   are counted over all documents; terms of more than ``COMMON`` of them are left out, but every item
   keeps at least its ``LEAST_TERMS`` rarest.
2. Passages are overlapping windows of ``WIDTH`` words. A randomised SVD of their TF-IDF matrix (over
   the passages of all documents and of the items) gives a latent
   space: each pass multiplies the matrix and its transpose with a thin block inside Spark tasks and sums
   the blocks by slices of ``SLICE_TERMS`` terms; orthogonalisation of the thin block is done on the driver.
   What the truncated SVD leaves out is kept as a random projection of ``RESIDUAL`` numbers, so that
   an item of rare words does not vanish.
3. Every passage of every document is folded into the space and compared by cosine with the items, whole
   and cut into the same windows, so that a long item is as near to its copy as a short one.
4. Beside this search, a passage is a candidate where it holds one of an item's rarest pairs of neighbouring
   words. There are enough pairs that a copy with words replaced or left out, as far as ``overlap`` allows,
   keeps one of them.
5. Candidates are checked on words: the longest common subsequence with the item in the surroundings
   of the passage, and that of the item's answer (its last sentence; of an item of one sentence its
   rarest words).

Documents are hashed once; what is kept of them in the shared folder is, per word, the index of its term.
Items are handled in blocks of ``ITEMS``, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm import shingles
from pairwright.llm.common import stash

WIDTH, STRIDE = 48, 24
COMMON, LEAST_TERMS = 0.05, 8
DIMENSIONS, OVERSAMPLE, POWERS, RESIDUAL = 64, 16, 2, 96
COSINE = 0.35
ITEMS = 2000
SLICE = 10_000 * STRIDE  # words that are compared at a time
SLICE_TERMS = 256  # rows of a sum that are added up in one group
RUN = 32  # longer runs of rows are summed in pieces

_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def lowered(text: str | None) -> bytes:
    """A text in lower case, with blanks for all ASCII characters but letters and digits."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT)


def word_ids(text: str | None) -> np.ndarray:
    """Hashes of a text's words in lower case; all ASCII characters but letters and digits are gaps."""
    return shingles.word_hashes(lowered(text))


@dataclass
class Items:
    """A block of benchmark items: ids, words, words of the answer, sorted terms, their spelling and weights."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    spelled: pa.Array
    weights: np.ndarray | None = None
    frequencies: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        words = [word_ids(text) for _, text in rows]
        last = [re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1] for _, text in rows]
        terms, first = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_index=True)
        spelled = [w for _, text in rows for w in lowered(text).split()]
        spelled = pa.array([spelled[i] for i in first], pa.large_binary()).view(pa.large_string())
        return Items([i for i, _ in rows], words, [word_ids(t) for t in last], terms, spelled)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Index of each word among the terms, -1 for other words."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)

    def places_of_texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """``places`` of the words of each text, as 32-bit numbers. Short texts are looked up together."""
        group, size = [], 0
        for text in texts:
            data = lowered(text)
            if group and size + len(data) > shingles.SEGMENT:
                yield from self._places_together(group)
                group, size = [], 0
            group.append(data)
            size += len(data)
        if group:
            yield from self._places_together(group)

    def _places_together(self, group: list[bytes]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(group, pa.large_binary()).view(pa.large_string()))
        words = split.flatten()
        solid = pc.binary_length(words).to_numpy() > 0  # blanks at an end leave an empty word
        at = pc.fill_null(pc.index_in(words, value_set=self.spelled), -1).to_numpy()[solid]
        return np.split(at, np.concatenate(([0], np.cumsum(solid)))[split.offsets.to_numpy()[1:-1]])


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """id, n_words, places: per document the term index of every word (32-bit numbers, -1 for other words)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                places = list(items.places_of_texts(part.column(1).to_pylist()))
                columns = [part.column(0), pa.array([len(p) for p in places], pa.int64()), pa.array([p.tobytes() for p in places], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "places"])

    out = T.StructType([docs.schema["id"], *T.StructType.fromDDL("n_words long, places binary").fields])
    return stash(docs.select("id", "text").mapInArrow(encode, out), "places")


def decoded(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), dtype=np.int32)


def document_frequencies(places: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Number of documents with each term, and of all documents."""
    n_terms = len(items.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(n_terms + 1, dtype=np.int64), np.zeros(n_terms + 1, dtype=np.int64)
        for batch in batches:
            for at in decoded(batch.column(0)):
                number = np.arange(len(at))
                mark[at] = number  # -1 is the last place; of a term's words one leaves its number
                total[at[mark[at] == number]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["term", "n"])

    rows = places.select("places").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_terms + 1, dtype=np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:n_terms], places.count()


def idf_weights(frequencies: np.ndarray, n: int, items: Items) -> np.ndarray:
    """Inverse document frequencies; 0 for common terms that no item needs."""
    weights = np.log((1.0 + n) / (1.0 + frequencies)) + 1e-3
    rare = frequencies <= COMMON * n
    for words in items.words:
        own = np.unique(items.places(words))
        rare[own[np.argsort(frequencies[own], kind="stable")[:LEAST_TERMS]]] = True
    return np.where(rare, weights, 0.0)


def pairs_of(places: np.ndarray, n_terms: int) -> np.ndarray:
    """A number for each pair of neighbouring words; that of the word alone for a text of one word."""
    after = places[1:] if len(places) > 1 else np.full(len(places), n_terms)
    return places[: len(after)].astype(np.int64) * (n_terms + 1) + after


def rarest_pairs(items: Items, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their items: of each item and each of its windows, one more of the rarest pairs than
    the words that ``overlap`` lets go can break. A pair is as rare as the rarer of its words."""
    n_terms = len(items.terms)
    rarity = np.append(items.frequencies, np.iinfo(np.int64).max)
    keys, owners = [], []
    for k, words in enumerate(items.words):
        places = items.places(words)
        chosen = []
        for part in parts_of(places):
            pairs = pairs_of(part, n_terms)
            order = np.argsort(np.minimum(rarity[pairs // (n_terms + 1)], rarity[pairs % (n_terms + 1)]), kind="stable")
            chosen.append(pairs[order[: 2 * int((1 - overlap) * len(part) + 1e-9) + 1]])
        keys.append(np.unique(np.concatenate(chosen)))
        owners.append(np.full(len(keys[-1]), k))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    return keys[order], owners[order]


def answer_of(items: Items, k: int) -> np.ndarray:
    """Term indices of an item's last sentence; of an item of one sentence its rarest quarter, at least three words."""
    words, last = items.places(items.words[k]), items.places(items.answers[k])
    if 0 < len(last) < len(words):
        return last
    order = np.argsort(items.frequencies[words], kind="stable")
    return words[np.sort(order[: max(3, math.ceil(len(words) / 4))])]


def parts_of(places: np.ndarray) -> list[np.ndarray]:
    """The windows of an item, the last one at its end; an item of up to ``WIDTH`` words is one."""
    starts = [*range(0, max(len(places) - WIDTH, 0), STRIDE), max(len(places) - WIDTH, 0)]
    return [places[i : i + WIDTH] for i in starts]


def fit_space(places: DataFrame, items: Items, seed: int = 11) -> np.ndarray:
    """Randomised SVD of the TF-IDF passages of all documents: terms x dimensions, then the projection of the rest."""
    n_terms = len(items.terms)
    rng = np.random.default_rng(seed)
    width = min(DIMENSIONS + OVERSAMPLE, n_terms)
    block = np.linalg.qr(rng.standard_normal((n_terms, width)))[0]
    matrix = places.select("places")
    weights = items.weights
    used = np.append(weights > 0, False)  # -1 is the last place
    gap = np.full(2 * STRIDE, -1, np.int32)

    def times(places: np.ndarray, weighted: np.ndarray, out: np.ndarray) -> None:
        """Add the transpose of a document's unit passages times those passages times x to ``out``; ``weighted`` is
        x with its rows times the weights."""
        at = np.flatnonzero(used[places])
        if len(at):
            _add_product(at // STRIDE, places[at], weights, weighted, out)

    for _ in range(POWERS + 1):
        x = block

        def product(batches: Iterator[pa.RecordBatch], x=x) -> Iterator[pa.RecordBatch]:
            out, weighted = np.zeros_like(x), weights[:, None] * x
            for batch in batches:
                group, size = [], 0
                for places in decoded(batch.column(0)):
                    group += [places, gap[len(places) % STRIDE :]]  # no passage spans two texts
                    size += len(places)
                    if size >= 1 << 15:
                        times(np.concatenate(group), weighted, out)
                        group, size = [], 0
                if group:
                    times(np.concatenate(group), weighted, out)
            task = TaskContext.get().partitionId()
            slices = [(k, out[k * SLICE_TERMS : (k + 1) * SLICE_TERMS]) for k in range(-(-len(out) // SLICE_TERMS))]
            slices = [(k, v) for k, v in slices if v.any()]
            columns = [pa.array([k for k, _ in slices], pa.int32()), pa.array([task] * len(slices), pa.int32())]
            columns.append(pa.array([v.tobytes() for _, v in slices], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["part", "task", "value"])

        def total(parts: pd.DataFrame) -> pd.DataFrame:
            out = 0.0
            for value in parts.sort_values("task")["value"]:  # the same order in every run
                out = out + np.frombuffer(value)
            return pd.DataFrame({"part": parts["part"].iloc[:1].to_numpy(), "value": [out.tobytes()]})

        sums = matrix.mapInArrow(product, "part int, task int, value binary").groupBy("part").applyInPandas(total, "part int, value binary")
        y = np.zeros_like(x)
        for r in sums.collect():
            y[r["part"] * SLICE_TERMS : (r["part"] + 1) * SLICE_TERMS] += np.frombuffer(r["value"]).reshape(-1, y.shape[1])
        weighted = weights[:, None] * x
        for words in items.words:
            times(items.places(words), weighted, y)
        block, gram = np.linalg.qr(y)[0], x.T @ y
    _, axes = np.linalg.eigh((gram + gram.T) / 2)
    latent = (x @ axes[:, ::-1])[:, :DIMENSIONS]
    rest = rng.standard_normal((n_terms, RESIDUAL)) / math.sqrt(RESIDUAL)
    return np.hstack((latent, rest - latent @ (latent.T @ rest)))


def _add_product(block: np.ndarray, term: np.ndarray, weights: np.ndarray, weighted: np.ndarray, out: np.ndarray) -> None:
    """Of the words of blocks of ``STRIDE``, in order; block b stands in passage b (after block b - 1) and b + 1."""
    n, parts = int(block[-1]) + 1, [slice(i, i + (1 << 15)) for i in range(0, len(term), 1 << 15)]
    sums, square = np.zeros((n + 2, out.shape[1])), np.bincount(block + 1, weights[term] ** 2, n + 2)
    for part in parts:
        b, t = block[part], term[part]
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        sums[b[starts] + 1] += _run_sums(weighted, t, starts)
    sums, square = sums[:-1] + sums[1:], square[:-1] + square[1:]
    sums /= np.where(square > 0, square, 1.0)[:, None]
    sums = sums[:-1] + sums[1:]
    for part in parts:
        order = np.argsort(term[part], kind="stable")
        b, t = block[part][order], term[part][order]
        starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        out[t[starts]] += weights[t[starts]][:, None] * _run_sums(sums, b, starts)


def _run_sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``rows[index]`` over the runs of the index that begin at ``starts``: all runs' first rows, then all
    second ones and so on, which is faster than ``np.add.reduceat`` for many short runs of wide rows."""
    lengths = np.diff(starts, append=len(index))
    longest = int(lengths.max())
    if longest > RUN:
        pieces = -(-lengths // RUN)
        runs = np.cumsum(pieces) - pieces
        cuts = np.repeat(starts - RUN * runs, pieces) + RUN * np.arange(pieces.sum())
        return _run_sums(_run_sums(rows, index, cuts), np.arange(len(cuts)), runs)
    out = rows[index[starts]]
    for i in range(1, longest):
        longer = np.flatnonzero(lengths > i)
        out[longer] += rows[index[starts[longer] + i]]
    return out


def lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", overlap: float = 0.8, paraphrase: float = 0.6, answer: float = 0.8,
) -> DataFrame:
    """One row per document and item it contains: id, item id, cosine, lcs_share, answer_share, start, end.

    A document contains an item if a passage's surroundings have a common subsequence with it of
    ``overlap`` of the item's words, or of ``paraphrase`` of them with ``answer`` of its last
    sentence (of an item of one sentence: of its rarest words). The row is that of the best passage (most words in common, then cosine, then first);
    start and end are words. Null and blank texts contain nothing, blank items are contained in
    nothing; items with equal texts each give their rows; rows that repeat an id give a row each.
    Empty tables give an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    blocks = max(1, math.ceil(items.count() / ITEMS))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = T.StructType(
        [T.StructField(id_col, texts.schema["id"].dataType), T.StructField(item_col, items.schema["item"].dataType)]
        + T.StructType.fromDDL("cosine double, lcs_share double, answer_share double, start long, end long").fields
    )
    found = None
    for b in range(blocks):
        rows = [(r["item"], r["text"]) for r in dealt.where(F.col("_block") == b).collect()]
        block = Items.of(sorted((r for r in rows if len(word_ids(r[1]))), key=lambda r: (r[0] is None, r[0], r[1])))
        part = texts.sparkSession.createDataFrame([], out)
        if block.ids:
            places = encoded(texts, block)
            frequencies, n = document_frequencies(places, block)
            block.weights, block.frequencies = idf_weights(frequencies, n, block), frequencies
            space = fit_space(places, block)
            part = places.select("id", "places").mapInArrow(_searcher(block, space, out, overlap, paraphrase, answer), out)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(items: Items, space: np.ndarray, out: T.StructType, overlap: float, paraphrase: float, answer: float):
    names = out.fieldNames()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = items.weights
        fold = (space * weights[:, None]).astype(np.float32)
        words = [items.places(w) for w in items.words]
        counts = [np.unique(p, return_counts=True) for p in words]
        answers = [answer_of(items, k) for k in range(len(words))]
        parts = [[p, *(parts_of(p) if len(p) > WIDTH else [])] for p in words]
        vectors = np.stack([fold[part].sum(axis=0) for p in parts for part in p])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        targets = Targets(vectors, np.repeat(np.arange(len(parts)), [len(p) for p in parts]), *rarest_pairs(items, overlap))
        for batch in batches:
            texts = list(decoded(batch.column(1)))
            best: dict[tuple[int, int], tuple] = {}
            for owner, first, k, cosine in _candidates(texts, weights, fold, targets):
                item, part = words[k], answers[k]
                left, right = max(0, first - len(item)), min(len(texts[owner]), first + WIDTH + len(item))
                bound, around = _shared(counts[k], texts[owner][left:right])
                most = bound / len(item), round(cosine, 6), -left
                if most[0] < min(overlap, paraphrase) or (owner, k) in best and most <= best[owner, k][0]:
                    continue
                share = lcs(item, around) / len(item)
                if share < min(overlap, paraphrase):
                    continue
                got = lcs(part, around) / len(part) if len(part) else 0.0
                if share >= overlap or got >= answer:
                    rank = (share, round(cosine, 6), -left)
                    if (owner, k) not in best or rank > best[owner, k][0]:
                        best[owner, k] = rank, (items.ids[k], cosine, share, got, left, right)
            if best:
                keys = sorted(best)
                columns = [batch.column(0).take(pa.array([owner for owner, _ in keys], pa.int64()))]
                columns += [pa.array(list(c)) for c in zip(*(best[key][1] for key in keys))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return search


def _shared(counts: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> tuple[int, np.ndarray]:
    """An upper bound of the longest common subsequence with an item, and the words of a text that the item has."""
    terms, n = counts
    at = np.minimum(np.searchsorted(terms, text), len(terms) - 1)
    hit = terms[at] == text
    return int(np.minimum(np.bincount(at[hit], minlength=len(terms)), n).sum()), text[hit]


@dataclass
class Targets:
    """What passages are compared with: vectors of items and item windows, and the items' rarest pairs."""

    vectors: np.ndarray
    items: np.ndarray
    pairs: np.ndarray
    pair_items: np.ndarray


def _candidates(texts: list[np.ndarray], weights: np.ndarray, fold: np.ndarray, targets: Targets):
    """(text, first word, item, cosine) of all passages whose cosine with an item or a window of it reaches
    ``COSINE``, or that hold one of its rarest pairs. The cosine is the highest of the item's vectors.

    Texts are compared together, as many as fill a slice; longer ones are cut into slices that overlap
    by a passage.
    """
    group, size = [], 0
    for owner, text in enumerate(texts):
        for at in range(0, max(len(text), 1), SLICE):
            part = text[at : at + SLICE + STRIDE]
            if size + len(part) > SLICE and group:
                yield from _compare(group, weights, fold, targets)
                group, size = [], 0
            group.append((owner, at, part))
            size += len(part)
    if group:
        yield from _compare(group, weights, fold, targets)


def _compare(group: list[tuple[int, int, np.ndarray]], weights, fold, targets: Targets):
    # Blocks of STRIDE words are numbered through, with an empty one after each text.
    starts = np.cumsum([0] + [-(-len(p) // STRIDE) + 1 for _, _, p in group])
    places = np.concatenate([p for _, _, p in group])
    at = np.concatenate([np.arange(len(p)) + s * STRIDE for (_, _, p), s in zip(group, starts)])
    exact = _pair_hits(places, at, len(weights), targets)
    used = (places >= 0) & (weights[places] > 0)
    places, block = places[used], at[used] // STRIDE
    cosine: dict[tuple[int, int], float] = {}  # by (first block, item)
    if len(places):
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        number = block[cut]
        sums = np.add.reduceat(fold[places], cut, axis=0)
        after = np.concatenate((number[1:] == number[:-1] + 1, [False]))
        both = sums.copy()
        both[after] += sums[1:][after[:-1]]
        alone = np.concatenate(([True], number[1:] != number[:-1] + 1))
        vectors, first = np.vstack((both, sums[alone])), np.concatenate((number, number[alone]))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        for low in range(0, len(targets.vectors), ITEMS):
            cosines = vectors @ targets.vectors[low : low + ITEMS].T
            rows, columns = np.nonzero(cosines >= COSINE)
            for b, k, c in zip(first[rows].tolist(), targets.items[low + columns].tolist(), cosines[rows, columns].tolist()):
                cosine[b, k] = max(c, cosine.get((b, k), c))
        for b, k in exact:
            i = int(np.searchsorted(number, b))
            if (b, k) not in cosine and i < len(number) and number[i] == b:
                cosine[b, k] = float((targets.vectors[slice(*np.searchsorted(targets.items, (k, k + 1)))] @ vectors[i]).max())
    for b, k in exact:
        cosine.setdefault((b, k), 0.0)
    found = sorted(cosine)
    texts = np.searchsorted(starts, [b for b, _ in found], side="right") - 1
    for (b, k), t in zip(found, texts.tolist()):
        owner, offset, _ = group[t]
        yield owner, offset + (b - int(starts[t])) * STRIDE, k, cosine[b, k]


def _pair_hits(places: np.ndarray, at: np.ndarray, n_terms: int, targets: Targets) -> set[tuple[int, int]]:
    """(block, item) of all places where one of an item's rarest pairs, or its only word, stands."""
    known = places >= 0
    both = np.flatnonzero(known[:-1] & known[1:] & (at[1:] == at[:-1] + 1))
    keys = places[both].astype(np.int64) * (n_terms + 1) + places[both + 1]
    where = at[both]
    if (targets.pairs % (n_terms + 1) == n_terms).any():  # items of one word
        keys = np.concatenate((keys, places[known].astype(np.int64) * (n_terms + 1) + n_terms))
        where = np.concatenate((where, at[known]))
    low, high = np.searchsorted(targets.pairs, keys), np.searchsorted(targets.pairs, keys, side="right")
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    column = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return set(zip((np.repeat(where[hit], n) // STRIDE).tolist(), targets.pair_items[column].tolist()))
