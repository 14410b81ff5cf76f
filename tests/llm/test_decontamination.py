import math
import random
import time

import numpy as np

from pairwright.llm import decontamination

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu", "va", "zi") for b in ("ba", "de", "fo", "gu", "ha", "ji", "kol", "lum", "min", "nor")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 9)) for _ in range(n)).capitalize() + "."


def make(seed=3):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.randint(10, 25)) + " " + sentence(rng, rng.randint(6, 12))) for i in range(30)]
    docs, leaks, near = [], set(), set()
    for d in range(300):
        parts = [sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 12))]
        if d % 10 == 0:
            k = rng.randrange(30)
            text = items[k][1] if d % 20 else items[k][1].upper()
            parts.insert(rng.randint(0, len(parts)), text)
            leaks.add((d, k))
        elif d % 10 == 5:  # a tenth of the words replaced, a word put in
            k = rng.randrange(30)
            words = items[k][1].split()
            for _ in range(len(words) // 10):
                words[rng.randrange(len(words))] = "other"
            words.insert(5, "added")
            parts.append(" ".join(words))
            near.add((d, k))
        docs.append((d, " ".join(parts)))
    return docs, items, leaks, near


def result(spark, docs, items):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, label string")
    return decontamination.leaks(df, bench).collect()


def test_leaks_are_found_and_clean_documents_are_not(spark):
    docs, items, leaks, near = make()
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, docs, items)}
    assert leaks <= got and got <= leaks | near and len(got & near) >= 0.9 * len(near)


def test_item_blocks_give_the_same_rows(spark, monkeypatch):
    docs, items, leaks, _ = make(4)
    whole = {(r["doc_id"], r["item_id"]) for r in result(spark, docs, items)}
    monkeypatch.setattr(decontamination, "ITEMS", 11)
    assert {(r["doc_id"], r["item_id"]) for r in result(spark, docs, items)} == whole


def test_places_long_texts_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", 10 * decontamination.STRIDE)
    docs, items, _, _ = make(5)
    rng = random.Random(9)
    filler = [sentence(rng, 20) for _ in range(300)]
    long = " ".join(filler[:200] + [items[7][1]] + filler[200:])
    got = result(spark, [(1, long), (2, None), (3, ""), (4, items[3][1]), (4, items[3][1])], [*items, (90, None), (91, ""), (92, items[3][1])])
    found = sorted((r["doc_id"], r["item_id"]) for r in got)
    assert found == [(1, 7), (4, 3), (4, 3), (4, 92), (4, 92)]
    row = next(r for r in got if r["doc_id"] == 1)
    assert row["start"] <= 4000 <= row["end"] and row["lcs_share"] == 1.0


def test_empty_tables(spark):
    docs, items, _, _ = make()
    assert result(spark, [], items) == [] and result(spark, docs[:3], []) == [] and result(spark, docs[:3], [(1, None)]) == []


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        assert decontamination.lcs(np.array(a), np.array(b)) == row[-1]


def test_recall_of_verbatim_copies_by_item_length(spark):
    rng = random.Random(12)
    lengths = [n for n in (1, 2, 5, 8, 12, 100, 400, 900) for _ in range(8)]
    plain = lambda n: sentence(rng, n)[:-1].lower()
    items = [(k, "only" + "abcdefgh"[k] if n == 1 else plain(n)) for k, n in enumerate(lengths)]
    docs = [(k, f"{plain(rng.randint(0, 90))} {text} {plain(rng.randint(30, 90))}") for k, text in items]
    docs += [(k, plain(rng.randint(50, 300))) for k in range(1000, 1200)]
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, docs, items)}
    assert {(k, k) for k, _ in items} <= got


def test_short_items_with_a_word_replaced_keep_a_pair():
    rng = random.Random(13)
    for n in (5, 8, 10, 20, 48, 120):
        item = decontamination.Items.of([(1, " ".join(f"w{i}" for i in range(n)))])
        item.frequencies = np.array([rng.randint(1, 99) for _ in item.terms])
        keys, _ = decontamination.rarest_pairs(item, 0.8)
        places = item.places(item.words[0])
        for _ in range(200):
            copy = places.copy()
            copy[rng.sample(range(n), n // 5)] = -1
            pairs = [a * (n + 1) + b for a, b in zip(copy[:-1].tolist(), copy[1:].tolist()) if a >= 0 and b >= 0]
            assert set(pairs) & set(keys.tolist())


def test_paraphrases_of_one_sentence_items(spark):
    rng = random.Random(14)
    items = [(k, f"{sentence(rng, 10)[:-1]} key{k} of{k} it{k} and{k} {sentence(rng, 6).lower()}") for k in range(20)]
    docs = []
    for k, text in items:  # 13 or 14 of 20 words in order, the rare ones among them
        words = text[:-1].split()
        for i in rng.sample([*range(10), *range(14, 20)], 6 + k % 2):
            words[i] = f"else{i}"
        docs.append((k, f"{sentence(rng, 30)} {' '.join(words)}. {sentence(rng, 30)}"))
        words = [f"else{i}" if 10 <= i < 14 or i < 3 else w for i, w in enumerate(text[:-1].split())]  # the rare ones gone
        docs.append((100 + k, f"{sentence(rng, 30)} {' '.join(words)}. {sentence(rng, 30)}"))
    docs += [(k, " ".join(sentence(rng, 20) for _ in range(5))) for k in range(1000, 1100)]
    got = {(r["doc_id"], r["item_id"]) for r in result(spark, docs, items)}
    assert got == {(k, k) for k, _ in items}


def test_space_is_fitted_on_all_passages(spark):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(30)]
    items = decontamination.Items.of([(k, " ".join(rng.choice(names, 12))) for k in range(5)])
    texts = [" ".join(rng.choice(names, rng.integers(0, 130))) for _ in range(40)] + [None, "w1"]
    places = [items.places(decontamination.word_ids(t)).astype(np.int32) for t in texts]
    n_terms = len(items.terms)
    items.weights = np.where(np.arange(n_terms) % 7 > 0, 1.0 + np.arange(n_terms) / 10, 0.0)
    rows = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(places)], "id long, places binary").repartition(3)
    space = decontamination.fit_space(rows, items)
    matrix = []
    for p in places + [items.places(w) for w in items.words]:
        for b in range(-1, len(p) // 24 + 1):
            passage = np.zeros(n_terms)
            np.add.at(passage, [t for t in p[max(b, 0) * 24 : (b + 2) * 24] if t >= 0], 1.0)
            square = (passage * items.weights**2).sum()  # of the words
            if square > 0:
                matrix.append(passage * items.weights / math.sqrt(square))
    gram = np.array(matrix).T @ np.array(matrix)
    latent = space[:, : -decontamination.RESIDUAL]
    # as many dimensions as terms: the space diagonalises the whole matrix
    turned = latent.T @ gram @ latent
    assert np.allclose(turned, np.diag(np.diag(turned)), atol=1e-6)
    assert np.allclose(np.sort(np.diag(turned)), np.sort(np.linalg.eigvalsh(gram)), atol=1e-6)


def test_texts_looked_up_together_have_the_places_of_their_hashes(monkeypatch):
    rng = random.Random(15)
    words = ["Straße", "ΟΔΟΣ", "İstanbul", "naïve", "42", "x", "\u212a", *VOCABULARY]
    items = decontamination.Items.of([(1, " ".join(words[:40])), (2, "x. Ab\u00a0c!"), (3, None), (4, "ΟΔΟΣ.Α")])
    texts = [None, "", " \n", "x", " x\x00X\x1fx ", "ΟΔΟΣ.Α ΟΔΟΣ", "ab\u00a0c AB C", "x " * 5000, "y" * 5000]
    texts += ["".join(rng.choice(words) + rng.choice([" ", ", ", "\t", "-", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for segment in (1, 1000, 1 << 20):
        monkeypatch.setattr(decontamination.shingles, "SEGMENT", segment)
        got = list(items.places_of_texts(texts))
        assert len(got) == len(texts) and all(p.dtype == np.int32 for p in got)
        assert [p.tolist() for p in got] == [items.places(decontamination.word_ids(t)).tolist() for t in texts]
    assert max(p.max(initial=-1) for p in got) >= 0
    none = decontamination.Items.of([])
    assert [p.tolist() for p in none.places_of_texts(["", "a b"])] == [[], [-1, -1]]


def test_looking_up_texts_costs_less_than_hashing_each():
    rng = random.Random(16)
    items = decontamination.Items.of([(k, sentence(rng, 40)) for k in range(100)])
    texts = [sentence(rng, 300) for _ in range(500)]

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    together = least(lambda: list(items.places_of_texts(texts)))
    assert together < 0.8 * least(lambda: [items.places(decontamination.word_ids(t)) for t in texts])


def test_run_sums_equal_reduceat():
    rng = np.random.default_rng(17)
    rows = rng.standard_normal((50, 7))
    for longest in (1, 3, decontamination.RUN, decontamination.RUN + 1, 5000):
        lengths = np.concatenate((rng.integers(1, longest + 1, 20), [longest, 1]))
        index, starts = rng.integers(0, 50, lengths.sum()), np.cumsum(lengths) - lengths
        assert np.allclose(decontamination._run_sums(rows, index, starts), np.add.reduceat(rows[index], starts, axis=0))


def test_document_frequencies_count_documents(spark):
    items = decontamination.Items.of([(1, "a b c d"), (2, "c e")])
    texts = ["a a b zz", "zz", None, "c a c a c", "e", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    frequencies, n = decontamination.document_frequencies(decontamination.encoded(docs, items), items)
    words = [set((t or "").split()) for t in texts]
    assert n == 6 and frequencies.tolist() == [sum(w.as_py() in x for x in words) for w in items.spelled]
