import hashlib
import random
import re

from pyspark.sql import functions as F

from pairwright.llm import secrets

HEX = "0123456789abcdef"


def brute(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def make(rng):
    kind = rng.randint(0, 6)
    value = "".join(rng.choices(HEX, k=40))
    key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=rng.choice((10, 16))))
    return [f'token = "{value}"', f"PassWord:{value[:11]}", f"api_key='{value}'", key, value[: rng.randint(10, 20)], "plain é words ſecret=aaaaaaaaaaaaaaaa", f"tokentoken=={value}"][kind]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(4)
    rows = [(i, " é ".join(make(rng) + rng.choice(["", " some words", "\n"]) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "token=" + "a" * 200_000), (903, "f" * 100_000), (903, "f" * 100_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, secrets string")
    got = secrets.find_secrets(df, sample=50)
    base = F.filter("secrets", lambda s: s["kind"] != "grammar")
    got = got.select("doc_id", secrets.joined(base).alias("base"), secrets.joined(F.col("secrets")).alias("all")).collect()
    want = dict((i, brute(t or "")) for i, t in rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["base"] == want[r["doc_id"]]
        assert set(r["base"].split(",")) <= set(r["all"].split(","))
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_grammar_finds_the_learned_format():
    rng = random.Random(5)
    values = {"assign": ["ghx_" + "".join(rng.choices(HEX + "ABCDEF", k=32)) for _ in range(60)]}
    words = ["".join(rng.choices(["on", "the", "er", "in", "st"], k=9)) for _ in range(300)]
    model = secrets.learn(values, words)
    new = ["ghx_" + "".join(rng.choices(HEX + "ABCDEF", k=32)) for _ in range(50)]
    assert sum(model.score(v) >= model.threshold for v in new) >= 40
    assert not any(model.score(w) >= model.threshold for w in words)


def test_merging_generalises_a_repeated_pattern():
    automaton = secrets.infer(["ab" * n for n in range(1, 40)] * 5)
    assert len(automaton.moves) <= 8
    assert automaton.likelihood("ab" * 60) > automaton.likelihood("aa" * 60)


def test_nothing_learned_and_empty_table(spark):
    assert secrets.learn({}, []).score("abcdefghijklmnopqrst") < float("inf")
    df = spark.createDataFrame([(1, "no secret here, only quitelongordinarywords")], "doc_id long, text string")
    assert secrets.find_secrets(df).first()["secrets"] == []
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_many_hidden_secrets_among_few_other_runs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices(["on", "the", "er", "in", "st"], k=rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    new = lambda: "ghx_" + "".join(rng.choices(HEX + "ABCDEF", k=32))
    rows = [(i, f'{prose(30)} token = "{new()}" {prose(10)}') for i in range(60)]
    rows += [(i, f"{prose(20)} {new()} {prose(20)}") for i in range(100, 500)]  # no label beside it
    rows += [(i, f"{prose(20)} {'on' * 6}{'the' * (i % 7 + 2)} mail{i % 9}.example.com {prose(20)}") for i in range(600, 640)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [s for s in r["secrets"] if s["kind"] == "grammar"] for r in secrets.find_secrets(df).collect()}
    texts = dict(rows)
    right = [i for i in range(100, 500) if any(texts[i][s["start"] : s["end"]].startswith("ghx_") for s in found[i])]
    assert len(right) >= 360
    assert not any(found[i] for i in range(600, 640))


ALPHABETS = {
    "hex40": (HEX, 40, ""), "upper": ("0123456789ABCDEF", 32, ""), "ghx": (HEX + "ABCDEFXYZwxyz", 36, "ghx_"),
    "mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24, ""), "dotted": ("abcdefghijklmnopqrstuvwxyz0123456789", 30, "sk.live."),
}


def drawn_value(rng, name):
    letters, n, prefix = ALPHABETS[name]
    return prefix + "".join(rng.choices(letters, k=n))


def test_every_labelled_format_is_found_without_its_label_and_identifiers_are_not(spark):
    import uuid

    rng = random.Random(9)
    words = ["".join(rng.choices(["on", "the", "er", "in", "st"], k=rng.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    names = [n for n in ALPHABETS if n != "hex40"]  # unlabelled lower-case hex is a base span anyway
    rows = [(i, f'{prose(20)} token = "{drawn_value(rng, names[i % len(names)])}" {prose(9)}') for i in range(400)]
    planted = {1000 + i: drawn_value(rng, names[i % len(names)]) for i in range(200)}
    rows += [(i, f"{prose(15)} {v} {prose(15)}") for i, v in planted.items()]
    clean = {2000 + i: v for i, v in enumerate(
        [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)] + [str(uuid.UUID(int=rng.getrandbits(128))).upper() for _ in range(60)]
        + [f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(100000, 235959)}Z" for _ in range(40)]
        + ["".join(rng.choices(words, k=4)) for _ in range(60)])}
    rows += [(i, f"{prose(15)} {v} {prose(15)}") for i, v in clean.items()]
    found = {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)

    def whole(i, v):
        return any(s["kind"] == "grammar" and texts[i][s["start"] : s["end"]] == v for s in found[i])

    for name in names:
        mine = [i for i in planted if names[(i - 1000) % len(names)] == name]
        assert sum(whole(i, planted[i]) for i in mine) >= 0.9 * len(mine), name
    assert [clean[i] for i in clean if any(s["kind"] == "grammar" for s in found[i])] == []
