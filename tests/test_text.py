"""T1-T4, T6, T11, T13, F2-F4 on hand-made rows the driver data never hits."""

from pyspark.sql import functions as F

from pairwright import fixed_values as FV
from pairwright.functions import text as T
from pairwright.operators import filters as FL


def _one(spark, expr, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def py_normalize(s):
    return "".join(ch for ch in s.lower() if ch.isalnum() or ch.isspace())


def test_strip_matches_python(spark):
    samples = ["\n\t  x y  ", " \u001cabc　", "", "   ", "a b", "\u0085z "]
    assert _one(spark, T.ustrip("t"), samples) == [s.strip() for s in samples]
    assert _one(spark, T.is_blank("t"), ["\n\t", " ", "\u001c", "", " a "]) == [True, True, True, True, False]


def test_normalize_matches_python(spark):
    samples = ["Hello, World! 123", "Ça va? Très bien…", "tab\there\nnew", "naïve café — ½ ⅓", "ΑΒΓ δεζ!"]
    assert _one(spark, T.normalize_prompt("t"), samples) == [py_normalize(s) for s in samples]


def test_first_line(spark):
    assert _one(spark, T.first_line("t"), ["\n  first\nsecond", "only", ""]) == ["first", "only", ""]


def py_strip_preamble(text):
    first = text.strip().split("\n")[0]
    low = first.lower()
    passes = ("##" in first) + 2 * ("**" in first) + (("sure" in low) or ("here's" in low))
    for _ in range(passes):
        text = text.replace(first, "")
    return text


def test_strip_preamble_cases(spark):
    samples = ["Sure, here's it:\nBody text.\nSure, here's it:", "## Title\nBody", "**Title**\nBody **Title**",
               "Sure, only one line", "aabb", "ab\naabb", "\n\t Sure thing\nrest", "plain\ntext"]
    got = _one(spark, T.strip_preamble("t"), samples)
    assert got == [py_strip_preamble(s) for s in samples]
    assert got[3] == ""            # a single preamble line leaves nothing


def test_overlap_second_pass_removes_more(spark):
    # first line "**ab" -> 3 passes (** counts twice) on "**ab**a**abb": deletions join new occurrences
    text = "**ab\n**a**abbb"
    assert _one(spark, T.strip_preamble("t"), [text]) == [py_strip_preamble(text)]


def test_unicode_case_insensitive(spark):
    assert _one(spark, T.contains_ci("t", "sure"), ["ſure", "SURE", "su re"]) == [True, True, False]
    assert _one(spark, T.contains_any_literal("t", FV.REJECT_ANY_WORDS),
                ["JavaScript tips", "visualize it", "plain prose"]) == [True, True, False]


def test_reject_word_groups(spark):
    df = spark.createDataFrame([("Translate this from English to French",), ("Set the tone from here",),
                                ("code of the language",), ("a code",)], "rewrite_prompt string")
    out = FL.reject_if_contains_all(df, "rewrite_prompt", FV.REJECT_ALL_WORD_GROUPS[0])
    out = FL.reject_if_contains_all(out, "rewrite_prompt", FV.REJECT_ALL_WORD_GROUPS[1])
    assert sorted(r[0] for r in out.collect()) == ["Set the tone from here", "a code"]


def test_boilerplate(spark):
    df = spark.createDataFrame([("I'm not able to",), ("CERTAINLY",), ("fine text",)], "rewritten_text string")
    assert [r[0] for r in FL.reject_boilerplate(df).collect()] == ["fine text"]


def test_mean_prompt_blend(spark):
    got = _one(spark, T.blend_with_mean_prompt("t"), ["!!!", "!! ??", "Rewrite this poem {x}"])
    pre, post = FV.MEAN_PROMPT_BASE.split("{}")
    assert got[0] == FV.MEAN_PROMPT
    assert got[1] == pre + " " + post
    vocab = [py_normalize(w) for w in FV.MEAN_PROMPT.split()]
    left = " ".join(w for w in (py_normalize(x) for x in "Rewrite this poem {x}".split()) if w not in vocab)
    assert got[2] == pre + left + post


def test_completion_split(spark):
    rows = spark.createDataFrame([("a [/INST] b [/INST] c",), ("no marker",)], "t string")
    out = rows.select(T.completion_prompt_part("t"), T.completion_target_part("t")).collect()
    assert tuple(out[0]) == ("a ", " b [/INST] c")
    assert tuple(out[1]) == ("no marker", None)


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame([("x",)], "t string").select(T.strip_preamble("t"), T.normalize_prompt("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
