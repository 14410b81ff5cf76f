"""Language ID (5) by hyperdimensional profiles.

Every letter (and the word boundary) has a random vector of -1 and 1, fixed by its code point. A letter
n-gram is the product of its letters' vectors, each shifted by its place; a text is the sum of its
n-gram vectors; a language is the sum of the unit vectors of its training texts. Prototypes and texts
are compared by cosine after the mean of all prototypes is taken off, which is what languages share.

Training sums are whole numbers, so they do not depend on how rows are dealt. A prototype has
``DIMENSIONS`` numbers; what reaches the driver is one prototype per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import fraction

DIMENSIONS = 1024
NGRAM = 3
SEGMENT = 1 << 18  # characters that are handled at a time
REMEMBERED = 30_000  # n-gram vectors per task
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
_SCALE = 1 << 16


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Profiles:
    """Vectors of texts. N-gram vectors are remembered up to a bound and made anew beyond it."""

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((REMEMBERED, DIMENSIONS), dtype=np.int8)

    def letter_vector(self, code: int) -> np.ndarray:
        v = self.letter.get(code)
        if v is None:
            bits = np.random.Generator(np.random.Philox(key=code + 1)).integers(0, 2, DIMENSIONS, dtype=np.int8)
            v = self.letter[code] = bits * 2 - 1
        return v

    def ngram_vector(self, key: int) -> np.ndarray:
        v = np.ones(DIMENSIONS, dtype=np.int8)
        for place in range(NGRAM):
            v = v * np.roll(self.letter_vector(key & 0x1FFFFF), place)
            key >>= 21
        return v

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct letter n-grams of a whole text and how often they occur; runs of other characters are one boundary."""
        letters = _letters()
        keys, times = [], []
        tail = np.zeros(1, dtype=np.int64)
        for at in range(0, len(text), SEGMENT):
            part = text[at : at + SEGMENT].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            codes = np.concatenate((tail, np.where(letters[codes], codes, 0)))
            codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
            tail = codes[-(NGRAM - 1) :]
            if at + SEGMENT >= len(text) and codes[-1] != 0:
                codes = np.append(codes, 0)
            if len(codes) >= NGRAM:
                grams = codes[: len(codes) - NGRAM + 1].copy()
                for i in range(1, NGRAM):
                    grams = (grams << 21) | codes[i : len(codes) - NGRAM + 1 + i]
                k, n = np.unique(grams, return_counts=True)
                keys.append(k)
                times.append(n)
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys) == 1:
            return keys[0], times[0]
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, np.concatenate(times)).astype(np.int64)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text, None if it has no letter."""
        keys, times = self.counts(text) if text else ((), ())
        if not len(keys):
            return None
        total = np.zeros(DIMENSIONS, dtype=np.float64)
        for at in range(0, len(keys), REMEMBERED):
            part = keys[at : at + REMEMBERED].tolist()
            new = [k for k in part if k not in self.row]
            if len(self.row) + len(new) > REMEMBERED:
                self.row, new = {}, part
            for k in new:
                self.vectors[len(self.row)] = self.ngram_vector(k)
                self.row[k] = len(self.row)
            rows = self.vectors[[self.row[k] for k in part]].astype(np.float32)
            total += times[at : at + REMEMBERED].astype(np.float32) @ rows
        norm = np.sqrt(total @ total)
        return total / norm if norm else None


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, less their mean, as unit rows.

    Learns from about ``sample`` texts of each language (all if there are fewer), chosen by a hash of
    the id. Rows with a null language are not used. Languages are a closed set of labels: more than
    ``MOST_LANGUAGES`` raise an error, as a model holds a prototype for each.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    sizes = [(r[0], r[1]) for r in known.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()]
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return [], np.zeros((0, DIMENSIONS), dtype=np.float32)
    shares = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample / n))])
    rows = known.where(fraction(F.col(id_col), F.lit("language")) < shares[F.col(lang_col)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                v = profiles.vector(text)
                if v is not None:
                    total.setdefault(lang, np.zeros(DIMENSIONS, dtype=np.int64))
                    total[lang] += np.rint(v * _SCALE).astype(np.int64)
        places = np.arange(DIMENSIONS, dtype=np.int32)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "place": places, "value": v})

    parts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(sums, "lang string, place int, value long")
    cells = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in cells})
    number = {lang: i for i, lang in enumerate(langs)}
    proto = np.zeros((len(langs), DIMENSIONS))
    for r in cells:
        proto[number[r["lang"]], r["place"]] = r["value"]
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    return langs, proto


def predict(text: Column, langs: list[str], prototypes: np.ndarray) -> Column:
    """struct<lang, score>: the nearest prototype and its cosine, 0 to 1. Equal cosines: the first in order.

    Null texts and texts without a letter give ``und`` and 0, as does a model without languages.
    """
    mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    centred = prototypes - mean
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float64)

    @F.pandas_udf("lang string, score double")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiles = Profiles()
        for series in texts:
            out = []
            for text in series:
                v = profiles.vector(text) if langs else None
                if v is None:
                    out.append((UNKNOWN, 0.0))
                    continue
                v = v - mean
                cosines = centred @ v / max(np.sqrt(v @ v), 1e-12)
                best = int(np.argmax(cosines))
                out.append((langs[best], float(min(1.0, max(0.0, cosines[best])))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return nearest(text)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` of ``parts``; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000) -> DataFrame:
    """id, held_out, lang_pred, score for every row of ``docs``; learns from the rows that are not held out.

    Only the text is an input of a prediction. Other columns are not read. Repeated rows get the same
    result. Empty in, empty out.
    """
    out = held_out(id_col, 4, 2)
    langs, prototypes = fit(docs.where(~out).select(id_col, text_col, lang_col), text_col, lang_col, id_col, sample)
    found = docs.select(F.col(id_col), out.alias("held_out"), predict(F.col(text_col), langs, prototypes).alias("_found"))
    return found.select(id_col, "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
