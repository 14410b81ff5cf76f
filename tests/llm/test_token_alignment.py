import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import token_alignment
from pairwright.llm.common import table
from pairwright.llm.queries import QUERIES

from tests.conftest import SF001

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
ENTRY = {i: token_alignment.byte_level(e) for e, i in A.get_vocab().items()}


def piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def brute_groups(text):
    """Groups (A ids, B ids) of a whole text by the libraries and the intersection of the ends."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(ENTRY[i] for i in a) != raw or b"".join(map(piece, b)) != raw:
        return []
    ends_a, ends_b = list(accumulate(len(ENTRY[i]) for i in a)), list(accumulate(len(piece(i)) for i in b))
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def told(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def brute(docs):
    groups = [(i, brute_groups(t)) for i, t in docs]
    links = [[(p, q) for x, y in g for p in x for q in y] for _, g in groups]
    count = Counter(pair for ls in links for pair in set(ls))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    return sorted(
        (i if i is not None else -1, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), told(g),
         sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls))
        for (i, g), ls in zip(groups, links)
    )


def found(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    return sorted(tuple(-1 if n == "doc_id" and r[n] is None else r[n] for n in names) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = QUERIES["op13_token_alignment"](spark, SF001)
    assert set(got.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in brute(docs)]
    assert found(got.withColumnRenamed("groups_sha256", "groups")) == want


ODD = [
    "", " ", "  ", "\n", " \n ", "a", "a ", " a", "a  b", "a \n b", "a\n\nb.\nNt", "it's 's ''s don't.", "x  y", "tab\t b", "▁ a▁b", "<s> </s> <unk> <|endoftext|> <0x41>",
    "中文字符测试" * 50, "\U0001f600\U0001f680" * 20, "é̈ é", "\x00 \x01a", "aaaa" * 500, "0123456789 " * 300, "a.b,c;d:e!f?g)h\"i", "\r\n x", "\x85 y", "�﻿ z", "w" * 5000,
]


def test_odd_texts_and_repeated_rows(spark, monkeypatch):
    docs = [*enumerate(ODD), (90, None), (None, "no id here"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("block", F.lit(1)).withColumn("groups", F.lit(2))
    assert found(token_alignment.align(df)) == brute(docs)
    assert found(token_alignment.align(df.limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n.'s,é中 \t1!"), max_size=40), min_size=1, max_size=20))
def test_pieces_equal_the_libraries_on_whole_texts(texts):
    texts = [t for t in texts if t]
    if not texts:
        return
    places, n = ALIGNER.align(texts)
    ends = np.cumsum(n)
    for t, p, q in zip(texts, ends - n, ends):
        assert ";".join(ALIGNER.groups[i] for i in places[p:q]) == told(brute_groups(t))


ALIGNER = token_alignment.Aligner(*FILES)


def test_table_of_words_is_trimmed_and_still_right(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    aligner = token_alignment.Aligner(*FILES)
    for k in range(6):
        texts = [f"the word{k} and the thing{j}.\nNext" for j in range(10)]
        places, n = aligner.align(texts)
        ends = np.cumsum(n)
        for t, p, q in zip(texts, ends - n, ends):
            assert ";".join(aligner.groups[i] for i in places[p:q]) == told(brute_groups(t))
        aligner.trim()
        assert len(aligner.word) <= 10


def test_many_small_blocks(spark, monkeypatch):
    docs = [(i, f"one two three {i} words, {'x' * (i % 7)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(token_alignment.align(df)) == brute(docs)


@pytest.mark.parametrize("seed", range(5))
def test_shared_cuts_equal_the_intersection(seed):
    rng = np.random.default_rng(seed)
    parts = [(np.cumsum(rng.integers(1, 4, 200)), np.cumsum(rng.integers(1, 9, 90))) for _ in range(5)]
    a, b, stops, base = [], [], [], 0
    for x, y in parts:
        end = max(x[-1], y[-1]) + 1
        a.append(np.append(x, end) + base)
        b.append(np.append(y, end) + base)
        stops.append(sum(map(len, a)))
        base += end
    a, b, stops = np.concatenate(a), np.concatenate(b), np.array(stops)
    got = token_alignment.shared_cuts(a, b, np.append(0, stops[:-1]), stops)
    assert (got == np.isin(a, b)).all()
