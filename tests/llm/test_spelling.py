import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pairwright.llm import spelling
from pairwright.llm.common import table
from pairwright.llm.queries import QUERIES

from tests.conftest import SF001


def neighbours(words):
    """Pairs at one error, over shared one-deletion forms."""
    by_form = {}
    for w in words:
        for form in {(w, -1)} | {(w[:i] + w[i + 1 :], 0) for i in range(len(w))}:
            by_form.setdefault(form[0], set()).add(w)
    near = {w: set() for w in words}
    for group in by_form.values():
        for a in group:
            for b in group:
                if a != b and one_error(a, b):
                    near[a].add(b)
    return near


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_vocabulary(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(vocab):
    near = neighbours(vocab)
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = QUERIES["op12_spelling_variants"](spark, SF001)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute(brute_vocabulary(docs))
    assert found(got) == want
    assert sum(r[1] is not None for r in want) > 20


def test_dense_vocabulary_over_many_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(1500)}
    words |= {"a" * k for k in (5, 6, 7, 8, 30, 31)} | {"un" + w for w in list(words)[:300]}
    vocab = {w: rng.choice([3, 3, 4, 6, 8, 16, 50]) for w in words}
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 100)
    monkeypatch.setattr(spelling, "PORTION", 40)
    monkeypatch.setattr(spelling, "AT_ONCE", 30)
    got = spelling.variants(spark.createDataFrame([*vocab.items(), (None, 9)], "word string, n long"))
    assert found(got) == brute(vocab)


def test_odd_rows(spark):
    long = "ab" * 3000
    docs = [
        (1, "House house HOUSE hose"), (2, None), (None, "houses houses houses houses houses houses houses"), (3, ""), (4, "été hôtel"),
        (5, f"{long} {long} {long}x {long}x"), (5, f"{long} {long} {long}x"), (1, "House house HOUSE hose"), (6, "1 2 3 . , -"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    want = brute(brute_vocabulary(docs))
    assert found(spelling.group_variants(df)) == want and len(want) >= 3
    assert found(spelling.group_variants(df.limit(0))) == []


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert set(got.values()) == {"w070"} and len(got) == 70
