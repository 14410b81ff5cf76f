import random
import unicodedata
import zlib

from pyspark.sql import functions as F

from pairwright.llm import language_id, quality

WORDS = {
    "de": "der die das und ist nicht ein eine schön über straße wir haben gemacht".split(),
    "en": "the and is not a of this that with have been made over there".split(),
    "el": "και το είναι δεν μια του που αυτό έχω κάνει πάνω εκεί".split(),
}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, lang := sorted(WORDS)[i % 3], " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 40)))) for i in range(n)]


def test_language_held_out_accuracy(spark):
    rows = texts(240) + [(1000, "de", None), (1001, "en", "123 ... !!"), (1002, None, "the and this that have been made"), (1003, "en", "")]
    rows += [(1004, "el", "και το είναι " * 30_000), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(i, t, lang, "clash") for i, lang, t in rows], "doc_id long, text string, lang string, score string")
    got = language_id.identify(df, sample=50).collect()
    assert len(got) == len(rows) and got[0]["lang_pred"] == got[-1]["lang_pred"]
    by_id = {r["doc_id"]: r for r in got}
    for i, lang, _ in rows:
        r = by_id[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    for i in (1000, 1001, 1003):
        assert by_id[i]["lang_pred"] == "und"
    assert by_id[1002]["lang_pred"] == "en" and by_id[1004]["lang_pred"] == "el"
    right = [by_id[i]["lang_pred"] == lang for i, lang, _ in texts(240) if by_id[i]["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_language_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    got = language_id.identify(spark.createDataFrame([(1, "some words", None)], schema)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_ngram_counts_do_not_depend_on_segments(monkeypatch):
    profiles = language_id.Profiles()
    text = "Ab c,  d1é " * 40
    whole = profiles.counts(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "SEGMENT", size)
        part = profiles.counts(text)
        assert [x.tolist() for x in part] == [x.tolist() for x in whole]


def test_quality_learns_labels(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [("word" if good else "w$$$") + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 60))]
        docs.append((i, " ".join(words), "clash", i))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None, 1), (1001, "", "x", 2), (1001, "", "x", 2), (1002, "word " * 50_000, "x", 3)]
    labels += [(5000, 1, 0), (1000, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, stats string, score int")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(df, lf).collect()}
    for i in range(400):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5)
    held = [got[i]["predicted"] == int(i % 3 > 0) for i in range(400) if got[i]["held_out"]]
    assert sum(held) / len(held) > 0.95
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1
    kept = quality.keep_good(df, lf)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lf = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(df, lf).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), lf).count() == 0


def test_rules_of_trees_hold_for_separable_rows_and_are_compiled(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.uniform(size=(600, 3))
    labels = ((values[:, 0] > 0.5) & (values[:, 2] <= 0.75)).astype(float)
    rules = quality.tree_rules(values, labels, ("a", "b", "c"))
    assert rules == quality.tree_rules(values, labels, ("a", "b", "c"))
    place = {"a": 0, "b": 1, "c": 2}

    def holds(tests):
        return np.all([(values[:, place[n]] <= bound) == at_most for n, at_most, bound in tests], axis=0)

    held = np.array([holds(t) for t in rules]).T.astype(float)
    weights = quality.lasso(held, labels)
    right = ((weights[0] + held @ weights[1:] > 0) == labels).mean()
    assert right > 0.95
    df = spark.createDataFrame([tuple(map(float, v)) for v in values[:50]], "a double, b double, c double").select(F.struct("a", "b", "c").alias("stats"))
    for tests in rules[:5]:
        assert [r[0] for r in df.select(quality.Rule(tests).column()).collect()] == holds(tests)[:50].tolist()


def test_lasso_is_the_minimum():
    import numpy as np

    rng = np.random.default_rng(4)
    x = (rng.uniform(size=(200, 6)) > 0.5).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=200) * 0.3 > 0.8).astype(float)

    def loss(w):
        z = w[0] + x @ w[1:]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.02 * np.abs(w[1:]).sum()

    best = quality.lasso(x, y, 0.02)
    assert all(loss(best) <= loss(best + d) + 1e-7 for d in rng.normal(size=(500, 7)) * rng.choice([0.001, 0.01, 0.1], size=(500, 1)))
    assert (best[1:] == 0).any()


def test_quality_columns_with_internal_names(spark):
    names = ["_stat_text", "_stat_words", "_stat_lines", "_stats", "_run_doc"]
    df = spark.createDataFrame([(i, f"word{i} " * 9, *"abcde") for i in range(30)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    lf = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    scored = quality.score_quality(df, lf)
    assert {tuple(r[n] for n in names) for r in scored.collect()} == {tuple("abcde")}
    assert quality.keep_good(df, lf).columns == df.columns


def plain_statistics(text):
    """The statistics of one text, restated without Spark."""
    import re

    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    lines = re.split(r"\n+", text)
    chars = max(len(text), 1)

    def share(chosen):
        return sum(c in chosen for c in text) / chars

    return {
        "chars": len(text), "words": len(words), "word_chars": sum(map(len, words)) / max(len(words), 1), "symbol_share": share("#$%&*+/<=>@\\^_`~"),
        "mark_share": share(".,;:!?"), "upper_share": sum(unicodedata.category(c) == "Lu" for c in text) / chars, "digit_share": share("0123456789"),
        "bar_share": share("|"), "distinct_words": len(set(words)) / max(len(words), 1), "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "line_words": len(words) / max(len(lines), 1), "emphasis_share": share("!"),
    }


def test_scores_equal_a_plain_restatement(spark):
    import math

    from pairwright.llm.common import table
    from tests.conftest import SF001

    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    model = quality.learned(docs, labels, "doc_id", "text", "quality")
    assert len(model.rules) >= 3
    for row in quality.statistics(docs.select("doc_id", "text")).withColumn("score", model.score()).collect():
        stats = plain_statistics(row["text"] or "")
        assert all(abs(stats[k] - row["stats"][k]) < 1e-9 for k in stats), row["doc_id"]
        total = model.intercept + sum(r.weight for r in model.rules if all((stats[n] <= b) == at_most for n, at_most, b in r.tests))
        assert abs(row["score"] - 1 / (1 + math.exp(-total))) < 1e-9
