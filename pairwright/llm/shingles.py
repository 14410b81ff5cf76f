"""Word shingles of texts as 64-bit hashes, vectorised over many texts with numpy (runs inside tasks)."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20  # bytes that are hashed at a time; longer texts are cut at white space
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, dtype=_U), np.full(max(n, 64) - 1, _BASE, dtype=_U)]).cumprod(dtype=_U)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word in UTF-8 bytes; words are split at white space, A-Z count as a-z."""
    parts = []
    start = 0
    while start < len(data):
        end = min(start + SEGMENT, len(data))
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        parts.append(_segment(np.frombuffer(data, dtype=np.uint8, count=end - start, offset=start)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=_U)


def _segment(b: np.ndarray) -> np.ndarray:
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, dtype=_U)
    length = last - first
    b = b[solid]
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    offset = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(b)) - np.repeat(offset, length)
    sums = np.add.reduceat(_BYTE[b] * _powers_to(int(length.max()))[place], offset)
    return mix(sums ^ length.astype(_U))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's k-word shingles.

    A text of fewer than k words has its whole word sequence as its one shingle; a text without
    words, or null, has none.
    """
    out = []
    for words in words_of_texts(texts):
        if not len(words):
            out.append(words)
            continue
        n = min(k, len(words))
        h = np.full(len(words) - n + 1, n, dtype=_U)
        for i in range(n):
            h = mix(h * _BASE ^ words[i : len(words) - n + 1 + i])
        out.append(np.unique(h))
    return out


def words_of_texts(texts: list[str | None]):
    """Word hashes of each text. Short texts are hashed together, as far as they fill a segment."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > SEGMENT:
            yield from _together(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        yield from _together(group)


def _together(group: list[bytes]):
    if len(group) == 1:
        yield word_hashes(group[0])
        return
    joined = b"\n".join(group)
    hashes = word_hashes(joined)
    b = np.frombuffer(joined, dtype=np.uint8)
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    ends = np.cumsum([len(g) + 1 for g in group])
    cuts = np.searchsorted(starts, ends)
    low = 0
    for high in cuts:
        yield hashes[low:high]
        low = high
