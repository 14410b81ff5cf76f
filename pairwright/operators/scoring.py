"""Vector scoring against a fixed reference set, and encoders.

The reference set of the selection is a parameter (16 target prompts).  Few
vectors are inlined as literal arrays, more are sent as one size-checked matrix, so
scoring every candidate is a projection: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


# J14
def score_against_references(df: DataFrame, refs: Sequence[Sequence[float]], vec: str = "embedding",
                             out: str = "scores", signed: bool = True, literals: int = 64,
                             most_bytes: int = 512 << 20) -> DataFrame:
    """Add ``out``: array of (signed) ``cos^3`` of ``vec`` with each reference, in reference order.

    Up to ``literals`` references become literals of the plan, so that scoring is a projection in the JVM. More are sent to
    the executors once, as a matrix of at most ``most_bytes`` (checked), and multiplied with the vectors of a batch
    block by block; a null vector has null scores."""
    import numpy as np

    if len(refs) > literals:
        matrix = np.array([[float(x) for x in r] for r in refs])
        if matrix.nbytes > most_bytes:
            raise ValueError(f"the references take {matrix.nbytes} bytes; `most_bytes` is {most_bytes}")
        return df.withColumn(out, _matrix_scores(df.sparkSession, matrix, signed)(F.col(vec).cast("array<double>")))
    import math

    sharpen = V.sharpened_signed if signed else V.sharpened_abs
    tmp = df.withColumn("_sv", F.transform(F.col(vec), lambda x: x.cast("double")))
    tmp = tmp.withColumn("_sn", V.norm("_sv"))
    scores = []
    for r in refs:
        rn = math.sqrt(sum(float(x) * float(x) for x in r))
        cos = F.when((F.col("_sn") == 0) | F.lit(rn == 0), F.lit(0.0)).otherwise(
            V.dot("_sv", V.literal_vector(r)) / (F.col("_sn") * F.lit(rn)))
        scores.append(sharpen(cos))
    return tmp.withColumn(out, F.array(*scores)).drop("_sv", "_sn")


REFERENCES_AT_ONCE, SCORES_AT_ONCE = 4096, 1 << 22


def _matrix_scores(spark, matrix, signed: bool) -> Callable[[Column], Column]:
    import numpy as np

    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    units = spark.sparkContext.broadcast(np.divide(matrix, lengths[:, None], out=np.zeros_like(matrix), where=lengths[:, None] > 0))

    @F.pandas_udf("array<double>")
    def scores(vectors: pd.Series) -> pd.Series:
        refs = units.value
        result = np.empty(len(vectors), dtype=object)
        result[:] = None
        given = np.flatnonzero(vectors.notna().to_numpy())
        rows = max(1, SCORES_AT_ONCE // len(refs))
        for i in range(0, len(given), rows):
            at = given[i:i + rows]
            x = np.stack([np.asarray(v, dtype=float) for v in vectors.iloc[at]])
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            cos = np.concatenate([x @ refs[j:j + REFERENCES_AT_ONCE].T for j in range(0, len(refs), REFERENCES_AT_ONCE)], axis=1)
            cubes = cos ** 3 if signed else np.abs(cos ** 3)
            for row, scored in zip(at.tolist(), cubes):
                result[row] = scored
        return pd.Series(result)

    return scores


# T18-T20 on two vector columns
def pair_score(a: str, b: str) -> Column:
    """Evaluation score ``|cos(a, b)^3|``.  Cosine is scale-invariant, so
    scoring L2-normalised embeddings needs no separate normalisation pass."""
    return V.sharpened_abs(V.cosine(a, b))


# M7 encoders -------------------------------------------------------------
def letter_profile(c) -> Column:
    """Deterministic native test encoder: letter counts a..z of a (normalised) text."""
    t = F.col(c) if isinstance(c, str) else c
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("double")
                     for ch in ascii_lowercase])


def encode_hashing(df: DataFrame, text: str, out: str = "embedding", num_features: int = 1 << 10) -> DataFrame:
    """Spark-only encoder: normalised words -> hashed term frequencies -> unit vector.

    This is not a sentence encoder; inject a real one with ``encode_with``."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(T.normalize_prompt(text), f"[{T.WHITESPACE_CLASS}]+"), lambda w: w != F.lit(""))
    tmp = df.withColumn("_words", words)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features).transform(tmp)
    return tf.withColumn(out, V.l2_normalize(vector_to_array("_tf"))).drop("_words", "_tf")


def encode_with(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]],
                out: str = "embedding", batch_size: int = 64, normalize_text: bool = True) -> DataFrame:
    """Encode ``text`` with an injected batch encoder through Arrow batches."""
    from .batch import batch_map

    src = df.withColumn("_enc_in", T.normalize_prompt(text) if normalize_text else F.col(text))
    return batch_map(src, "_enc_in", fn, out, "array<double>", batch_size=batch_size).drop("_enc_in")
