import random

import pytest

from pairwright.llm import token_counts

P = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=P.path(MODEL))


def test_counts_equal_the_library():
    merger, sp = token_counts.Merger(P.path(MODEL)), library()
    rng = random.Random(3)
    alphabet = "ab  \n\t\r▁éß漢字😀1234<s></s><0x0A><unk>.,  theTheing\u0000‍́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "   ", "\n", "a" * 5000, " " * 1000, "<s>", "word " * 3000, "x▁▁y", "▁"]
    assert [merger.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    assert merger.count(None) == 0


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    merger, sp = token_counts.Merger(P.path(MODEL)), library()
    text = " ".join(f"word{i % 17}x" for i in range(300))
    assert merger.count(text) == len(sp.encode(text)) and len(merger.known) <= 5


def test_column_and_edge_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "hello world", 9), (3, "hello world", 9), (4, "é" * 5000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(df).orderBy("doc_id").collect()
    sp = library()
    for r, (_, t, _) in zip(got, rows):
        n = len(sp.encode(t or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
