"""Normalised indel similarity (T5) as an Arrow-batched pandas UDF.

``ratio(a, b) = 100 * 2 * LCS(a, b) / (len(a) + len(b))`` over code points
(indel distance normalised by the total length; a substitution costs 2, so
this is not Levenshtein).  LCS length uses the bit-parallel recurrence of
Allison & Dix / Hyyro (2004) on Python integers: one pass over the shorter text with
bit vectors as long as the longer, i.e. O(len(a) * len(b) / 64) machine-word steps.

Since LCS <= min(len a, len b), ``200 * min / (len a + len b)`` bounds the
ratio from above.  ``reaches_ratio_expr`` ships a pair to Python only when that
bound reaches the caller's threshold; every other row sends two nulls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of a longest common subsequence. What the texts begin and end with alike is counted at once; the loop runs
    over the shorter rest, with bit vectors as long as the longer."""
    if len(a) > len(b):
        a, b = b, a
    same = _common_start(a, b)
    end = _common_start(a[same:][::-1], b[same:][::-1])
    a, b = a[same:len(a) - end], b[same:len(b) - end]
    if not a:
        return same + end
    masks = _places(b, set(a))
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks[ch]
        v = ((v + u) | (v - u)) & full
    return same + end + len(b) - v.bit_count()


def _common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _places(text: str, chars: set[str]) -> dict[str, int]:
    """Per character the places where ``text`` has it, as bits of a number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {c: int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") for c in chars}


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * 2.0 * lcs_length(a, b) / total


def reaches_ratio(a: str, b: str, least: float) -> bool:
    """Whether ``indel_ratio(a, b) >= least``, without the full table where that is out of reach.

    A common subsequence of the needed length leaves at most ``spare`` characters
    unmatched, so the first i characters of a match within the first i + spare of
    b; longer and longer starts of the texts are tried before the whole."""
    if a == b:
        return least <= 100.0
    if len(a) > len(b):
        a, b = b, a
    total = len(a) + len(b)
    needed = least * total / 200.0
    if len(a) < needed - 1e-9:
        return False
    spare = int(total - 2 * needed) + 1
    for i in (64, 256, 1024, 4096, 16384):
        if i >= len(a):
            break
        if lcs_length(a[:i], b[: i + spare]) + (len(a) - i) < needed - 1e-9:
            return False
    return indel_ratio(a, b) >= least


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if (x is None or y is None) else indel_ratio(x, y) for x, y in zip(a, b)]
    return pd.Series(out, dtype="float64")


def indel_ratio_expr(a, b) -> Column:
    """Ratio column."""
    return indel_ratio_udf(_col(a), _col(b))


def reaches_ratio_expr(a, b, least: float) -> Column:
    """Whether the ratio is at least ``least``; null for null texts.  Pairs whose lengths rule it out stay in the JVM."""
    ca, cb = _col(a), _col(b)
    la, lb = F.length(ca), F.length(cb)
    possible = (la + lb == 0) | (F.lit(200.0) * F.least(la, lb) >= F.lit(float(least)) * (la + lb))

    @F.pandas_udf("boolean")
    def reaches(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else reaches_ratio(s, t, least) for s, t in zip(x, y)], dtype="object")

    return F.when(possible, reaches(F.when(possible, ca), F.when(possible, cb))).otherwise(F.lit(False) & possible)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
