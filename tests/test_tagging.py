"""The tag model: a list-based Viterbi with back pointers, rows to learn from, and the "noun to be participle" test."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from pairwright.functions import tagging
from pairwright.operators import filters as FL

K = range(len(tagging.TAGS))
LETTER = r"[^\W\d_]"
TOKEN = re.compile(rf"{LETTER}+(?:'{LETTER}+)?|[0-9]+(?:[.,][0-9]+)*|[^ \t\n\r\f\v]")


def word_scores(model, word):
    if word in model.words:
        return model.words[word]
    if re.match("[0-9]", word):
        return model.number
    if not re.match(LETTER, word):
        return model.mark
    return next((model.ends[word[-k:]] for k in (3, 2, 1) if word[-k:] in model.ends), model.unknown)


def most_likely(text, model=tagging.DEFAULT):
    """Tags by dynamic programming over the whole text with every tag of every path kept; ties as documented."""
    if text is None or not re.search(r"(?i)\bto\s+be\b", text, re.ASCII):
        return None if text is None else False
    words = [w.lower() for w in TOKEN.findall(text)]
    paths = [(0 if j == tagging.SYMBOL else tagging.IMPOSSIBLE, 0, False, ()) for j in K]
    for i, word in enumerate(words):
        scores = word_scores(model, word)
        new = []
        for j in K:
            best = max((p[0] + model.after[b][j], p[1], p[2], p[3]) for b, p in enumerate(paths))
            tags = (*best[3], j)
            met = best[2] or (i >= 3 and words[i - 2] == "to" and words[i - 1] == "be" and j == tagging.PARTICIPLE
                              and tags[i - 3] == tagging.NOUN)
            nouns = sum((t == tagging.NOUN) << k for k, t in enumerate(reversed(tags[-3:])))
            new.append((best[0] + scores[j], nouns, met, tags))
        paths = new
    return max(p[:3] for p in paths)[2]


REDUNDANT = ["The sentence to be rewritten is short", "a paragraph to be improved", "text to be translated", "Rephrase the email to be sent tomorrow",
             "The article TO BE written. It is to be clear", "the data to be broken", "These are the lines to be removed"]
OTHER = ["I want to be loved", "He decided to be quiet", "Make the text to be more formal", "The message needs to be clear", "words to be 12",
         "She has a wish to be famous", "rewrite it to be funny", "to be", "", "We hope to be invited", "Be brief, to be sure", "They try to be heard"]


def test_phrases(spark):
    df = spark.createDataFrame([(t,) for t in [*REDUNDANT, *OTHER, None]], "t string")
    got = {r[0]: r[1] for r in df.select("t", tagging.noun_to_be_participle("t")).collect()}
    assert got == {**dict.fromkeys(REDUNDANT, True), **dict.fromkeys(OTHER, False), None: None}
    kept = {r[0] for r in FL.reject_redundant_prompt(df, "t").collect()}
    assert kept == {*OTHER, None}


def test_expression_and_sql_equal_the_list_version(spark):
    rng = random.Random(3)
    pool = [*list(tagging.DEFAULT.words)[:150], "to", "be", "to be", "to be", "zorbing", "Blarg", "12", "3.5", ",", "!", "unlisted", "walked", "écrits", "it's", "\n"]
    pool += ["letter to be", "the zorbing to be", "words to be deleted", "to be marked", "plan"] * 6
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 20))) for _ in range(250)]
    want = {t: most_likely(t) for t in texts}
    assert 5 < sum(want.values()) < 200
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert {r[0]: r[1] for r in df.select("text", tagging.noun_to_be_participle("text")).collect()} == want
    source = df.toPandas()  # noqa: F841
    found = duckdb.sql("WITH RECURSIVE " + tagging.redundant_sql("source") + " SELECT text FROM redundant").fetchall()
    assert {r[0] for r in found} == {t for t, v in want.items() if v}


def test_long_text_takes_little(spark):
    text = "the letter was sent and " * 5000 + "the letter to be sent ."
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tagging.noun_to_be_participle("t")).first()[0] is True


def test_learning_counts_rows_and_normalises_tags(spark):
    rows = [(["A", "wug", "to", "be", "blicked"], ["DT", "NNS", "TO", "VB", "VBN"]), (["Wugs", "run"], ["NNP", "VBZ"]),
            (["odd"], ["NN", "NN"]), (None, None), (["?"], ["WEIRD"]), ([], [])]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>")
    model = tagging.TagModel.learn(df)
    words = {("a", "DT"): 1, ("wug", "NN"): 1, ("to", "TO"): 1, ("be", "VB"): 1, ("blicked", "VBN"): 1, ("wugs", "NN"): 1, ("run", "VB"): 1, ("?", "SYM"): 1}
    after = {("SYM", "DT"): 1, ("DT", "NN"): 1, ("NN", "TO"): 1, ("TO", "VB"): 1, ("VB", "VBN"): 1, ("SYM", "NN"): 1, ("NN", "VB"): 1, ("SYM", "SYM"): 1}
    want = tagging.TagModel.from_counts(words, after)
    assert (dict(model.words), dict(model.ends), model.after) == (dict(want.words), dict(want.ends), want.after)
    prompts = spark.createDataFrame([("wugs to be blicked",), ("wugs to be nice",)], "rewrite_prompt string")
    assert [r[0] for r in FL.reject_redundant_prompt(prompts, tagger=model).collect()] == ["wugs to be nice"]
    assert prompts.where(F.lit(False)).select(tagging.noun_to_be_participle("rewrite_prompt", model)).collect() == []


def test_learned_from_its_own_sample_tags_the_sample(spark):
    sentences = [[tuple(x.rsplit("/", 1)) for x in line.split()] for line in tagging.SAMPLE.strip().splitlines()]
    df = spark.createDataFrame([([w for w, _ in s], [t for _, t in s]) for s in sentences], "tokens array<string>, tags array<string>")
    model = tagging.TagModel.learn(df, max_words=50)
    assert len(model.words) <= 50
    plain = " ".join(w for s in sentences for w, _ in s)
    assert most_likely(plain, model) is True
