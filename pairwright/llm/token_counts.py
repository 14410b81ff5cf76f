"""Token counts (2) by heap-and-linked-list byte-pair merging over a SentencePiece BPE vocabulary.

The symbols of a text form a linked list; a heap holds the adjacent pairs that are pieces. The pair of
lowest rank (highest score, then leftmost) is popped and merged again and again. The count is that of
the initial symbols minus the merges; identifiers are never made. A character outside the vocabulary
counts its UTF-8 bytes (byte fallback).

No piece has the space mark after another character, and none joins a line break to anything; so a text
falls into chunks that merge on their own. (A text that is not empty gets a space mark in front, as the
model file says.) Counts of chunks are remembered per task in a dictionary
of bounded size; every text is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 300_000  # chunks per task and generation


class Merger:
    """Token counts for one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        joined = [p for p in self.rank if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("a piece has the space mark inside; texts can't be cut before it")
        alone = [c for c in "\n\r\t" if not any(c in p for p in joined)]
        cut = "".join(map(re.escape, alone))
        self.chunk = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+|[{cut}]" if cut else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.prefix = MARK if sp.encode("a", out_type=str)[0].startswith(MARK) else ""
        self.known = _Remembered(self.count_chunk)

    def count(self, text: str | None) -> int:
        """Number of tokens of a whole text; 0 for null and empty texts."""
        if not text:
            return 0
        return sum(map(self.known.__getitem__, self.chunk.findall(self.prefix + text.replace(" ", MARK))))

    def cost(self, char: str) -> int:
        return 1 if char in self.rank else len(char.encode("utf-8", "surrogatepass"))

    def count_chunk(self, chunk: str) -> int:
        symbols = list(chunk)
        n = len(symbols)
        total = sum(map(self.cost, symbols))
        rank = self.rank.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != size:
                continue  # one of the two has been merged meanwhile
            right = symbols[j]
            total -= self.cost(left) + self.cost(right) - 1
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(symbols[i] + symbols[k])
                if r is not None:
                    heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = rank(symbols[h] + symbols[i])
                if r is not None:
                    heappush(heap, (r, h, size + len(symbols[h])))
        return total


class _Remembered(dict):
    """Values of ``make`` by key: the present generation and the one before, each of bounded size."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def n_tokens(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Token count of a text column (long); ``model`` is a name that the public tokenizers' folder has."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        merger = Merger(public_tokenizers.path(model))
        for series in texts:
            yield pd.Series([merger.count(t) for t in series], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, text_col: str = "text", limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    Null counts as empty: 0 bytes, 0 tokens. Special strings in a text are ordinary text. Columns of
    these three names in ``docs`` are replaced. Rows are independent; empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("n_tokens", n_tokens(text, model)).withColumn("n_bytes", F.octet_length(text).cast("long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
