"""T7/T8 JSON from free text; T5/F6 indel ratio against dynamic programming."""

import json
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright import fixed_values as FV
from pairwright.functions import jsonx as J
from pairwright.functions.similarity import indel_ratio, lcs_length
from pairwright.operators import filters as FL

D = FV.DEFAULT_PREDICTED_PROMPT


def test_extract_field_cases(spark):
    cases = [('{"prompt":"a"}', "a"), ('Sure: {"prompt":"a"} done', "a"), ('{"prompt":"a"} x {"b":1}', D),
             ('{"prompt":"a"},{"prompt":"b"}', D), ("{'prompt':'a'}", D), ('{"prompt":"a\nb"}', "a\nb"),
             ('{"prompt":null}', None), ('{"other":"a"}', D), ('{"prompt":"a","prompt":"b"}', "b"),
             ('{"prompt":"a",}', D), ("no braces", D), (None, D)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in df.select(J.extract_field("t", "prompt", D)).collect()]
    assert got == [e for _, e in cases]


def by_json_loads(text, key, default):
    """The same by the standard library: greedy span, one object, raw control characters allowed."""
    found = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        value = json.loads(found[0], strict=False)
    except (TypeError, ValueError):
        return default
    return value.get(key, default)


def test_text_after_the_object_is_refused(spark):
    cases = ['{"prompt":"a"}] [{"prompt":"b"}', '{"prompt":"a"}} {"prompt":"b"}', '{"prompt":"a"}]}', '{"prompt":"a"},"x":{"y":"z"}', '{"prompt":"a"}]',
             '[{"prompt":"a"}]', '{"a":{"prompt":"b"}}', '{"prompt":"}] [{"}', '{"prompt":"a"} {"prompt":"b"}', '{"prompt":"a"}\n\n']
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = [r[0] for r in df.select(J.extract_field("t", "prompt", D)).collect()]
    assert got == [by_json_loads(t.strip(), "prompt", D) for t in cases]


def test_extract_field_equals_json_loads_on_pieces(spark):
    rng = random.Random(8)
    pieces = ['{', '}', '[', ']', '"prompt"', ':', ',', '"a"', '"b}"', '"[{"', '\\', '"', ' ', '{"prompt":"x"}', '{"prompt":"y","n":"1"}', '"q"']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    texts += [x + '{"prompt":"x"}' + y for x in ("", "[", "{", '"') for y in ("", "]", "}", "]}", "} {}", "] [{}", ",{}", ',"a":{}')]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", J.extract_field("t", "prompt", D)).collect()}
    want = {i: by_json_loads(t.strip(), "prompt", D) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], w) for i, w in want.items() if isinstance(w, str | None) and got[i] != w} == {}
    assert sum(w != D for w in want.values()) > 30


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc\U0001F600é", max_size=40), st.text(alphabet="abc\U0001F600é", max_size=40))
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == dp_lcs(a, b)


def test_ratio_examples():
    assert indel_ratio("abcd", "abxd") == 75.0
    assert indel_ratio("same", "same") == 100.0
    assert indel_ratio("abc", "xyz") == 0.0
    assert indel_ratio("", "") == 100.0
    a = "abcdefghijklmnopqrst"
    assert indel_ratio(a, a[:19] + "X") == 95.0


def test_near_identical_drops_exactly_95(spark):
    a = "abcdefghijklmnopqrst"
    rows = [(1, a, a[:19] + "X"), (2, a, a[:18] + "XY"), (3, "short", "a much longer different text"),
            (4, "abcd", "abxd")]
    df = spark.createDataFrame(rows, "id int, original_text string, rewritten_text string")
    kept = sorted(r[0] for r in FL.reject_near_identical(df).collect())
    assert kept == [2, 3, 4]


def test_length_bound_skips_python(spark):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randint(1, 50), "y" * rng.randint(200, 300)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, original_text string, rewritten_text string")
    assert FL.reject_near_identical(df).count() == 50


def test_cutoff_agrees_with_the_ratio():
    from pairwright.functions.similarity import indel_ratio, reaches_ratio
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 400))]
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            k = rng.randint(0, len(b))
            b[k:k + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        a, b = "".join(a), "".join(b)
        for least in (80.0, 95.0, 100.0):
            assert reaches_ratio(a, b, least) == (indel_ratio(a, b) >= least)


def test_json_items_are_ascii_and_parse_back(spark):
    from pairwright.functions.jsonx import to_json_item
    rows = [("é ü", 'quote " and \\ and \n'), ("漢😀", None), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [json.loads(r[0]) for r in df.select(to_json_item(x="a", y="b")).collect()]
    assert got == [{"x": a, "y": b} for a, b in rows]
    assert all(r[0].isascii() for r in df.select(to_json_item(x="a", y="b")).collect())
