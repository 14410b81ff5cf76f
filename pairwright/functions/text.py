"""String column functions.

All of them are native Spark expressions, so they stay inside whole-stage
codegen.  Python ``str`` semantics are reproduced where the pipeline relies
on them: ``str.strip`` / ``isspace`` (Unicode whitespace, not only U+0020),
``isalnum`` and Unicode case-insensitive matching.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as FV


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's whitespace set (what ``str.strip()`` removes), derived from the
# interpreter's own table so the Spark expressions agree with it.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def _class_escape(chars: str) -> str:
    return "".join(f"\\x{{{ord(ch):x}}}" for ch in chars)


# Regex class body (Java / RE2 syntax) for the whitespace set.
WHITESPACE_CLASS = _class_escape(WHITESPACE)


def regex_quote(text: str) -> str:
    """Quote ``text`` as a literal for Java regex."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# ---------------------------------------------------------------- T4, F8
def ustrip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.trim(_col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    """True when the text is empty after ``ustrip``."""
    return ustrip(c) == F.lit("")


# ---------------------------------------------------------------- T1
def normalize_prompt(c) -> Column:
    """Lower-case, keep only letters, digits and whitespace (no collapsing)."""
    return F.regexp_replace(F.lower(_col(c)), f"[^\\p{{L}}\\p{{N}}{WHITESPACE_CLASS}]", "")


# ---------------------------------------------------------------- T2
def first_line(c) -> Column:
    """Text before the first newline of the stripped text."""
    return F.substring_index(ustrip(c), "\n", 1)


# ---------------------------------------------------------------- matching
def contains_ci(c, word: str) -> Column:
    """Unicode case-insensitive substring test (regex mode, like ``re.I``)."""
    return _col(c).rlike("(?iu)" + regex_quote(word))


def contains_any_ci(c, words: Iterable[str]) -> Column:
    """One regex pass testing every word (case-insensitive)."""
    alternatives = "|".join(regex_quote(w) for w in words)
    return _col(c).rlike(f"(?iu)(?:{alternatives})")


def contains_all_ci(c, words: Iterable[str]) -> Column:
    cond = None
    for w in words:
        term = contains_ci(c, w)
        cond = term if cond is None else (cond & term)
    return cond if cond is not None else F.lit(True)


def contains_any_literal(c, words: Iterable[str]) -> Column:
    """Literal substring test on upper-cased text and words (no regex)."""
    upper = F.upper(_col(c))
    cond = None
    for w in words:
        term = upper.contains(w.upper())
        cond = term if cond is None else (cond | term)
    return cond if cond is not None else F.lit(False)


# ---------------------------------------------------------------- T3
def preamble_passes(first: Column) -> Column:
    """Number of removal passes the first line triggers (0..4).

    Passes run in this order: ``##``; ``**``; ``sure``/``here's``
    (case-insensitive); ``**`` again.  Each pass removes every occurrence of
    the (unchanged) first line from the text.
    """
    has_hash = first.contains(FV.PREAMBLE_MARKERS_HASH).cast("int")
    has_star = first.contains(FV.PREAMBLE_MARKERS_STAR).cast("int")
    has_word = contains_any_ci(first, FV.PREAMBLE_WORDS).cast("int")
    return has_hash + 2 * has_star + has_word


def strip_preamble(c) -> Column:
    """Remove a preamble first line (and its repeats) from a rewritten text."""
    text = _col(c)
    first = first_line(text)
    passes = preamble_passes(first)
    removed = F.aggregate(F.array_repeat(F.lit(0), passes), text,
                          lambda acc, _: F.replace(acc, first, F.lit("")))
    return F.when(passes > 0, removed).otherwise(text)


# ---------------------------------------------------------------- T11, T13
def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{WHITESPACE_CLASS}]+"), lambda w: w != F.lit(""))


def subtract_vocabulary(c, vocabulary_text: str = FV.MEAN_PROMPT) -> Column:
    """Normalise each whitespace word and drop words of ``vocabulary_text``.

    Words that normalise to '' are kept as empty strings, so "!!!" gives ''
    and "!! ??" gives ' '.
    """
    cleaned = F.transform(_words(_col(c)), normalize_prompt)
    if vocabulary_text.isascii():
        # a literal: Spark does not fold higher-order functions and would normalise the vocabulary for every word
        words = dict.fromkeys("".join(ch for ch in w.lower() if ch.isalnum()) for w in vocabulary_text.split())
        vocab_array = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        return F.array_join(F.filter(cleaned, lambda w: ~F.array_contains(vocab_array, w)), " ")
    # bound as a lambda variable: normalised once a row
    vocab_array = F.transform(_words(F.lit(vocabulary_text)), normalize_prompt)
    kept = F.transform(F.array(vocab_array), lambda v: F.filter(cleaned, lambda w: ~F.array_contains(v, w)))[0]
    return F.array_join(kept, " ")


def template_or_default(c, base: str = FV.MEAN_PROMPT_BASE, default: str = FV.MEAN_PROMPT) -> Column:
    """'' -> ``default``; otherwise insert the words into ``base`` at ``{}``."""
    pre, post = base.split("{}", 1)
    words = _col(c)
    return F.when(words == F.lit(""), F.lit(default)).otherwise(F.concat(F.lit(pre), words, F.lit(post)))


def blend_with_mean_prompt(c) -> Column:
    return template_or_default(subtract_vocabulary(c))


# ---------------------------------------------------------------- T15, T16
def join_chunks(chunks) -> Column:
    """Concatenate streamed response chunks held in an array column."""
    return F.array_join(_col(chunks), "")


def completion_prompt_part(c, marker: str = FV.RESPONSE_MARKER) -> Column:
    """Text up to (excluding) the first response marker."""
    return F.substring_index(_col(c), marker, 1)


def completion_target_part(c, marker: str = FV.RESPONSE_MARKER) -> Column:
    """Text after the first response marker; null when there is none."""
    text = _col(c)
    pos = F.instr(text, marker)
    return F.when(pos > 0, F.substr(text, pos + F.lit(len(marker))))
