"""Cross-tokenizer alignment (13) by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. In an interval of tokens a common end near the middle is located (the
middle end of A, then its neighbours outwards, each looked up among the ends of B by bisection); both
halves go on alike, and an interval without an inner common end is a group. All intervals of a level
take a step together.

Both tokenizers always cut before a blank or line break that follows a character other than white space, after such
a line break, and between a Latin letter and a mark of `,.;:!?)"` (checked when the files are loaded; if a file doesn't
say so, the text is one piece). So texts are divided there first, and what is found for a piece is
remembered in a table of bounded size; every piece is encoded by the libraries themselves, and every text is
read whole.

How many documents link two ids is counted over the corpus: a task writes the id pairs of a block of documents
once, each document as places in its block's list; the lists are joined with the counts and go back to their block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import stash

MARK = "▁"
REMEMBERED = 300_000  # words that a task keeps
CHARS_AT_ONCE = 1 << 20  # characters that are encoded together
BLOCK_PAIRS = 1 << 20  # distinct (document, id pair) entries of a block

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ',.;:!?)"'
CUT = re.compile(rf"(?<=\S)(?=\n)|(?<=\S\n)(?=\S)|(?<=[{LATIN}])(?=[{MARKS}])")
TOGETHER = 200  # pieces that are encoded as one text


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> np.ndarray:
    """Which ends of A are ends of B as well, as booleans, for the intervals [a0, a1) of A's tokens.

    The last end of every interval is a common one. Ends ascend over all intervals."""
    shared = np.zeros(len(ends_a), bool)
    shared[a1 - 1] = True
    lo, hi = a0, a1 - 1  # ends that may be inner cuts
    while True:
        some = hi > lo
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return shared
        middle = (lo + hi) >> 1
        cut = np.full(len(lo), -1)
        open_, away = np.arange(len(lo)), 0
        while len(open_):
            for offset in (away, -away) if away else (0,):
                probe = middle[open_] + offset
                inside = (probe >= lo[open_]) & (probe < hi[open_]) & (cut[open_] < 0)
                at = probe[inside]
                j = np.searchsorted(ends_b, ends_a[at])
                hit = ends_b[np.minimum(j, len(ends_b) - 1)] == ends_a[at]
                cut[open_[inside][hit]] = at[hit]
            away += 1
            width = np.maximum(middle[open_] - lo[open_], hi[open_] - 1 - middle[open_])
            open_ = open_[(cut[open_] < 0) & (away <= width)]
        found = cut >= 0
        shared[cut[found]] = True
        lo, hi = np.concatenate([lo[found], cut[found] + 1]), np.concatenate([cut[found], hi[found]])


def byte_level(entry: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary: printable bytes stand for themselves, the others for 256, 257, ..."""
    return b"".join(_BYTES.get(c) or c.encode("utf-8") for c in entry)


def _byte_alphabet() -> dict[str, bytes]:
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(c): bytes([b]) for c, b in [*zip(printable, printable), *((256 + i, b) for i, b in enumerate(others))]}


_BYTES = _byte_alphabet()


class _Ids(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Aligner:
    """Two tokenizers and the pieces that both have encoded. A reads blank + text, B the text."""

    def __init__(self, file_a: str, file_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=file_b)
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = byte_level(entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)
        ]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        ids_a, ids_b = map(str, range(len(self.bytes_a))), map(str, range(len(pieces)))
        names_a, names_b = list(ids_a), list(ids_b)
        self.names = [f"{n}{end}" for names, ends in ((names_a, ",|"), (names_b, ",;")) for end in ends for n in names]
        with open(file_a, encoding="utf-8") as f:
            says = json.load(f)
        before = says.get("pre_tokenizer") or {}
        plain_a = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        joins = re.compile(rf"[^{MARK}]{MARK}|[{LATIN}][{MARKS}]|.\n|\n.", re.DOTALL)
        plain_b = not any(joins.search(p) for p in pieces) and self.b.encode("a  b", out_type=str)[0].startswith(MARK)
        self.lead = self.b.encode("\n")  # what a line break in front of a piece adds
        plain_b = plain_b and self.b.encode("\n\n") == [*self.lead, self.lead[-1]]
        self.divides = bool(plain_a and plain_b and not says.get("normalizer"))
        self.forget()

    def forget(self) -> None:
        self.word = _Ids()
        self.seen = np.zeros(0, np.int64)  # how often words were looked up
        self.loose = np.zeros(0, bool)  # words that are empty or end in white space
        self.first_part = np.zeros(1, np.int64)  # where the pieces of a word begin
        self.parts = np.zeros(0, np.int64)
        self.known = _Ids()
        self.fits = np.zeros(0, bool)
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.first = np.zeros(1, np.int64)  # where the id pairs of a piece begin
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the words that were looked up again, at most half of what may be remembered."""
        again = np.flatnonzero(self.seen > 1)
        kept = np.sort(again[np.argsort(-self.seen[again], kind="stable")][: REMEMBERED // 2])
        parts, n = _gather(self.parts, self.first_part, kept)
        used, self.parts = np.unique(parts, return_inverse=True)
        self.first_part = np.append(0, np.cumsum(n))
        words, pieces = list(self.word), list(self.known)
        self.word = _Ids(zip(map(words.__getitem__, kept.tolist()), range(len(kept))))
        self.known = _Ids(zip(map(pieces.__getitem__, used.tolist()), range(len(used))))
        self.groups = list(map(self.groups.__getitem__, used.tolist()))
        self.seen, self.loose, self.fits, self.sizes = np.zeros(len(kept), np.int64), self.loose[kept], self.fits[used], self.sizes[used]
        self.times, _ = _gather(self.times, self.first, used)
        self.pairs, n = _gather(self.pairs, self.first, used)
        self.first = np.append(0, np.cumsum(n))

    def words(self, text: str) -> list[str]:
        """The text cut before blanks that follow a character other than white space, without these blanks."""
        out, held = [], None
        for word in text.split(" "):
            held = word if held is None else f"{held} {word}"
            if held and not held[-1].isspace():
                out.append(held)
                held = None
        if held is not None:
            out.append(f"{out.pop()} {held}" if out else held)
        return out

    def encode_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for pieces, and how many each has. Pieces that A cuts before and after are encoded together."""
        apart = [not self.divides or p[0] != " " or p[-1].isspace() for p in pieces]
        texts, held = [], []
        for piece, one in zip(pieces, apart):
            if held and (one or len(held) == TOGETHER):
                texts.append("".join(held))
                held = []
            if one:
                texts.append(piece)
            else:
                held.append(piece)
        if held:
            texts.append("".join(held))
        ids = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        a = np.fromiter(chain.from_iterable(ids), np.int64)
        ends, bounds = np.cumsum(self.len_a[a]), np.cumsum([len(p.encode("utf-8")) for p in pieces])
        at = np.searchsorted(ends, bounds)
        if len(a) and ends[-1] == bounds[-1] and (ends[at] == bounds).all():
            return a, np.diff(at + 1, prepend=0)
        ids = [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids])

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't known and align their tokens. A piece is what A reads; one that doesn't begin with
        a blank is inside a text."""
        led = [p.startswith(" ") for p in pieces]
        a, n_a = self.encode_a(pieces)
        ids_b = self.b.encode([p[1:] if b else f"\n{p}" for p, b in zip(pieces, led)], num_threads=1)
        ids_b = [x if b else x[len(self.lead) :] for x, b in zip(ids_b, led)]
        n_b = np.array([len(x) for x in ids_b])
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        fits = self.comes_back(pieces, a, n_a, b, n_b)
        self.fits = np.append(self.fits, fits)
        if not fits.all():
            a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
            n_a, n_b = n_a * fits, n_b * fits
        sizes = np.zeros((len(pieces), 4), np.int64)
        n_pairs = np.zeros(len(pieces), np.int64)
        groups = [""] * len(pieces)
        if len(a):
            ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            stop = np.cumsum(n_a)
            some = n_a > 0
            shared = np.flatnonzero(shared_cuts(ends_a, ends_b, (stop - n_a)[some], stop[some]))
            end_a, end_b = shared + 1, np.searchsorted(ends_b, ends_a[shared]) + 1
            start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
            owner = np.searchsorted(stop, shared, "right")
            width, height = end_a - start_a, end_b - start_b
            sizes[:, 0], sizes[:, 1] = n_a, n_b
            sizes[:, 2] = np.bincount(owner, minlength=len(pieces))
            np.add.at(sizes[:, 3], owner, width * height)
            name = np.zeros(len(a) + len(b), np.int64)
            va, vb = len(self.bytes_a), len(self.bytes_b)
            last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            last_a[end_a - 1], last_b[end_b - 1] = True, True
            name[np.arange(len(a)) + np.repeat(start_b, width)] = a + va * last_a
            name[np.arange(len(b)) + np.repeat(end_a, height)] = 2 * va + b + vb * last_b
            told = list(map(self.names.__getitem__, name.tolist()))
            end = np.cumsum(n_a + n_b)
            groups = ["".join(told[i:j])[:-1] for i, j in zip((end - n_a - n_b).tolist(), end.tolist())]
            keys, times, n_pairs = linked_pairs(a, b, start_a, start_b, width, height, owner, len(pieces))
            self.pairs = np.concatenate([self.pairs, keys])
            self.times = np.concatenate([self.times, times])
        self.groups.extend(groups)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_pairs)])

    def comes_back(self, pieces: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which pieces have the joined bytes of both tokenizers' ids equal to their own."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.cumsum([len(r) for r in raw])
        ends = [np.cumsum(np.append(0, lens))[np.cumsum(n)] for lens, n in ((self.len_a[a], n_a), (self.len_b[b], n_b))]
        a, b = list(map(self.bytes_a.__getitem__, a.tolist())), list(map(self.bytes_b.__getitem__, b.tolist()))
        whole = b"".join(raw)
        if (ends[0] == size).all() and (ends[1] == size).all() and b"".join(a) == whole and b"".join(b) == whole:
            return np.ones(len(pieces), bool)
        i, j = np.cumsum(n_a), np.cumsum(n_b)
        cuts = zip(raw, (i - n_a).tolist(), i.tolist(), (j - n_b).tolist(), j.tolist())
        return np.array([b"".join(a[p:q]) == r and b"".join(b[s:t]) == r for r, p, q, s, t in cuts])

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For texts that aren't empty: the places of their pieces, and how many pieces each text has.

        A text whose bytes don't come back from both tokenizers has no pieces."""
        cut = [t.split(" ") for t in texts] if self.divides else [[t] for t in texts]
        word, n = self.places_of_words(cut)
        if self.divides:
            loose = np.add.reduceat(self.loose[word].astype(np.int64), np.cumsum(n) - n) > 0
            if loose.any():
                word, n = self.places_of_words([self.words(t) if odd else ws for t, ws, odd in zip(texts, cut, loose)])
        places, sizes = _gather(self.parts, self.first_part, word)
        n_pieces = np.add.reduceat(sizes, np.cumsum(n) - n)
        if self.fits.all():
            return places, n_pieces
        by_text = np.split(places, np.cumsum(n_pieces)[:-1])
        odd = [i for i, ps in enumerate(by_text) if not self.fits[ps].all()]
        whole = self.places_of_pieces([f" {texts[i]}" for i in odd])
        for i, place in zip(odd, whole):
            by_text[i] = np.array([place] if self.fits[place] else [], np.int64)
        return np.concatenate(by_text), np.array([len(ps) for ps in by_text])

    def places_of_words(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(ws) for ws in cut])
        word = np.fromiter(map(self.word.__getitem__, chain.from_iterable(cut)), np.int64, n.sum())
        new = list(islice(self.word, len(self.loose), None))
        if new:
            loose = [self.divides and (not w or w[-1].isspace()) for w in new]
            split = [CUT.split(f" {w}") if self.divides and not odd else (f" {w}",) for w, odd in zip(new, loose)]
            self.loose = np.append(self.loose, loose)
            sizes = np.array([len(ps) for ps in split])
            self.parts = np.append(self.parts, self.places_of_pieces(list(chain.from_iterable(split))))
            self.first_part = np.append(self.first_part, self.first_part[-1] + np.cumsum(sizes))
            self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
        self.seen += np.bincount(word, minlength=len(self.seen))
        return word, n

    def places_of_pieces(self, pieces: list[str]) -> np.ndarray:
        places = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        new = list(islice(self.known, len(self.fits), None))
        if new:
            self.learn(new)
        return places


def linked_pairs(a, b, start_a, start_b, width, height, owner, owners) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id pairs (A << 32 | B) that groups link, once per owner, how often, and their number per owner."""
    links = width * height
    keys, times, of = [], [], []
    wide = links > 4096
    narrow = np.flatnonzero(~wide)
    if len(narrow):
        n = links[narrow]
        group = np.repeat(narrow, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys.append(a[start_a[group] + k // height[group]] << 32 | b[start_b[group] + k % height[group]])
        times.append(np.ones(len(group), np.int64))
        of.append(owner[group])
    for g in np.flatnonzero(wide):  # distinct ids first, so that repeats don't multiply
        x, nx = np.unique(a[start_a[g] : start_a[g] + width[g]], return_counts=True)
        y, ny = np.unique(b[start_b[g] : start_b[g] + height[g]], return_counts=True)
        keys.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
        of.append(np.full(len(x) * len(y), owner[g]))
    key, time, own = np.concatenate(keys), np.concatenate(times), np.concatenate(of)
    order = np.lexsort((key, own))
    key, time, own = key[order], time[order], own[order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(time, first), np.bincount(own[first], minlength=owners)


def _gather(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``rows`` one after another, and how many each has; row r holds values[first[r]:first[r + 1]]."""
    n = first[rows + 1] - first[rows]
    return values[np.arange(n.sum()) + np.repeat(first[rows] - np.cumsum(n) + n, n)], n


def _entries(aligner: Aligner, places: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair) once, as document, pair and number of links."""
    pairs, n = _gather(aligner.pairs, aligner.first, places)
    if not len(pairs):
        return pairs, pairs, pairs
    times, _ = _gather(aligner.times, aligner.first, places)
    n_b = len(aligner.bytes_b)
    room = len(aligner.bytes_a) * n_b
    packed = np.repeat(of, n) * room + (pairs >> 32) * n_b + (pairs & 0xFFFFFFFF)
    order = np.argsort(packed)
    packed, times = packed[order], times[order]
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    doc, pair = np.divmod(packed[first], room)
    return doc, pair // n_b << 32 | pair % n_b, np.add.reduceat(times, first)


_BLOCKS = (
    "block long, {id}, n_a long, n_b long, n_groups long, n_links long, groups {groups}, "
    "place array<int>, times array<long>, pair array<long>, docs array<long>"
)


def _batches(texts: list[str]) -> Iterator[slice]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHARS_AT_ONCE:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _blocks_of(id_type: pa.DataType, digest: bool, file_a: str, file_b: str):
    """Rows of documents with their pairs as places in the block's list, and one row per block with that list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*map(_file, (file_a, file_b)))
        schema = pa.schema([
            ("block", pa.int64()), ("id", id_type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
            ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("pair", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
        ])
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            pair = np.concatenate([h[4] for h in held])
            used, place = np.unique(pair, return_inverse=True)
            docs = np.bincount(place, minlength=len(used))
            ids = pa.concat_arrays([h[0] for h in held] + [pa.nulls(1, id_type)])
            sizes = np.concatenate([h[1] for h in held] + [np.zeros((1, 4), np.int64)])
            groups = [g for h in held for g in h[2]] + [None]
            per_doc = np.concatenate([h[3] for h in held])
            ends = np.append(np.append(0, np.cumsum(per_doc)), len(place)).astype(np.int32)
            none = np.zeros(len(per_doc) + 1, np.int32)
            times = np.concatenate([h[5] for h in held])
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(times)),
                pa.ListArray.from_arrays(np.append(none, len(used)).astype(np.int32), pa.array(used)),
                pa.ListArray.from_arrays(np.append(none, len(used)).astype(np.int32), pa.array(docs)),
            ]
            n = len(per_doc) + 1
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), ids, *(pa.array(sizes[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists], schema=schema
            )
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            ids, whole = batch.column(0), batch.column(1).to_pylist()
            start = 0
            for part in _batches([t or "" for t in whole]):
                texts = [t or "" for t in whole[part]]
                full = [i for i, t in enumerate(texts) if t]
                places, n_pieces = aligner.align([texts[i] for i in full])
                of = np.repeat(np.arange(len(full)), n_pieces)
                doc, pair, times = _entries(aligner, places, of)
                sizes = np.zeros((len(texts), 4), np.int64)
                groups = [""] * len(texts)
                at = np.array(full, np.int64)
                for k in range(4):
                    sizes[at, k] = np.bincount(of, aligner.sizes[places, k], len(full))
                every, end = list(map(aligner.groups.__getitem__, places.tolist())), np.cumsum(n_pieces)
                for i, p, q in zip(full, (end - n_pieces).tolist(), end.tolist()):
                    told = ";".join(every[p:q])
                    groups[i] = hashlib.sha256(told.encode()).hexdigest() if digest and told else told
                per_doc = np.zeros(len(texts), np.int64)
                per_doc[at] = np.bincount(doc, minlength=len(full))
                held.append((ids[start : start + len(texts)], sizes, groups, per_doc, pair, times))
                start += len(texts)
                size += len(pair)
                if size >= BLOCK_PAIRS:
                    yield block()
                if len(aligner.word) > REMEMBERED:
                    aligner.trim()
        if held:
            yield block()

    return rows


def _file(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _scored(key: tuple, docs: pa.Table, lists: pa.Table) -> pa.Table:
    """The documents of a block with what the corpus-wide counts say about their links."""
    at = lists.column("place").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = lists.column("count").to_numpy(), lists.column("best").to_numpy()
    place = docs.column("place").combine_chunks()
    owner = np.repeat(np.arange(len(docs)), np.diff(place.offsets.to_numpy()))
    used = place.flatten().to_numpy()
    times = docs.column("times").combine_chunks().flatten().to_numpy()
    total, top = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(total, owner, times * count[used])
    np.add.at(top, owner, times * best[used])
    kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return kept.append_column("n_best", pa.array(top)).append_column("count_sum", pa.array(total))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
    file_a: str = "byte_bpe_50k.json", file_b: str = "piece_bpe_32k.model",
) -> DataFrame:
    """Per document: its id, n_a, n_b (tokens), n_groups, n_links, groups (string), n_best and count_sum.

    ``groups`` is `a1,a2|b1;a3|b2,b3`, or with ``digest`` its SHA-256 (lower-case hex; '' without tokens). A link
    is a pair of token occurrences in one group; the count of an id pair is the number of documents that link it; n_best
    are the links whose count is the highest of their A id, count_sum the sum over links. Null and empty
    texts and those whose bytes don't come back have no tokens: zeros and ''. Every row is a document,
    repeated rows and rows without an id too. Other columns are not read, so their names can't clash. Empty in, empty out. The files are
    paths or names in the public tokenizers' folder. Memory is bounded by the block and by the distinct ids of one group.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _BLOCKS.format(id=f"id {field.simpleString()}", groups="string")
    blocks = stash(rows.mapInArrow(_blocks_of(to_arrow_type(field), digest, file_a, file_b), schema), "aligned")
    lists = blocks.where("groups is null").select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("place", "x"))
    lists = lists.select("block", "place", F.col("x.pair").alias("pair"), F.col("x.docs").alias("docs"))
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    of_a = Window.partitionBy("a")  # at most as many rows as B has ids
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).cast("long").alias("best"))
    scored = lists.join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    rows = blocks.where("groups is not null").drop("pair", "docs")
    out = rows.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(
        _scored, f"id {field.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    )
    return out.withColumnRenamed("id", id_col)
