"""Columns named like the operators' own internal ones change no result and crash nothing."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright import llm
from pairwright.llm import (
    decontamination, exact_dedup, html_text, language_id, line_dedup, mixing, near_dedup, quality, secrets, spelling, token_alignment, token_counts, top_k,
)
from pairwright.llm.common import table
from tests.conftest import SF001

SOURCES = "".join(p.read_text() for p in pathlib.Path(llm.__file__).parent.glob("*.py"))
NAMES = sorted(set(re.findall(r"\"(_[a-z][a-z_0-9]*)\"", SOURCES)) | {"block", "hash", "digest", "bucket", "rep", "band", "key", "word", "root", "pos", "part", "row", "value"})

OPERATORS = {
    "mix": lambda s, d: mixing.taken_words(mixing.mix(d)).select("doc_id", "size", "target"),
    "tokens": lambda s, d: token_counts.count_tokens(d).select("doc_id", "n_tokens"),
    "leaks": lambda s, d: decontamination.leaks(d, table(s, SF001, "benchmark")),
    "language": lambda s, d: language_id.identify(d).select("doc_id", "lang_pred"),
    "quality": lambda s, d: quality.score_quality(d, table(s, SF001, "labels")).select("doc_id", "predicted"),
    "lines": lambda s, d: line_dedup.dedup_lines(d).select("doc_id", "text", "n_lines", "n_removed"),
    "secrets": lambda s, d: secrets.find_secrets(d).select("doc_id", secrets.joined(F.col("secrets")).alias("spans")),
    "near": lambda s, d: near_dedup.near_duplicates(d, k=5, threshold=80),
    "exact": lambda s, d: exact_dedup.dedup(d),
    "spelling": lambda s, d: spelling.group_variants(d),
    "alignment": lambda s, d: token_alignment.align(d),
}


def clashing(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in taken])


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    docs = table(spark, SF001, "documents").where("doc_id < 60").coalesce(2)
    plain, odd = (sorted(map(tuple, OPERATORS[name](spark, d).collect()), key=repr) for d in (docs, clashing(docs)))
    assert plain == odd and (plain or name == "leaks")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_all_columns(spark, name, stage):
    docs = clashing(table(spark, SF001, "documents").where("doc_id < 40").coalesce(2))
    out = stage(spark, docs, SF001)
    assert out.columns == docs.columns and out.count() > 0


def test_pages_and_vectors(spark):
    pages, vectors = (table(spark, SF001, t).limit(30) for t in ("pages", "embeddings"))
    assert clashing(pages).transform(html_text.extract_text).count() == pages.count()
    assert sorted(map(tuple, top_k.top_k(clashing(vectors)).collect())) == sorted(map(tuple, top_k.top_k(vectors).collect()))
