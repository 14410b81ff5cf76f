"""Quality classifier (6): a sparse ensemble of rules over text statistics.

1. ``statistics``: Spark columns over the whole text.
2. Small trees are grown on labelled rows; every path from a root to a node is a conjunctive rule.
3. A logistic model with lasso weights is fitted on the rules; most weights become zero.
4. The rules that are left are compiled into one Spark column, the score.

Statistics of all rows are computed on the JVM. Fitting uses about ``sample`` rows, chosen by a hash of
the id (all if there are fewer); trees and weights are made from them in one task, so that the driver gets the
rules in one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import WORD, fraction, stash, unused
from pairwright.llm.language_id import held_out

SAMPLE = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.0005
FEATURES, ROWS, CUTS, LEAST = 0.6, 0.7, 32, 5  # share of features per node and rows per tree, cuts per feature, rows per node
STEPS = 600
STATISTICS = (
    "chars", "words", "word_chars", "symbol_share", "mark_share", "upper_share", "digit_share", "bar_share",
    "distinct_words", "repeated_lines", "line_words", "emphasis_share",
)


def statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with the ``STATISTICS`` of each text as struct ``out`` (doubles, never null; 0 for empty texts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    in_text, in_words, in_lines = unused(docs, "_stat_text", "_stat_words", "_stat_lines")
    rows = docs.select("*", text.alias(in_text), words.alias(in_words), F.split(text, r"\n+").alias(in_lines))
    chars = F.length(in_text)
    n = F.size(in_words)

    def share(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(in_text, pattern, ""))) / F.greatest(chars, F.lit(1))

    lines = F.size(in_lines)
    values = {
        "chars": chars,
        "words": n,
        "word_chars": F.aggregate(in_words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1)),
        "symbol_share": share(r"[#$%&*+/<=>@\\^_`~]+"),
        "mark_share": share(r"[.,;:!?]+"),
        "upper_share": share(r"\p{Lu}+"),
        "digit_share": share(r"[0-9]+"),
        "bar_share": share(r"[|]+"),
        "distinct_words": F.size(F.array_distinct(in_words)) / F.greatest(n, F.lit(1)),
        "repeated_lines": 1 - F.size(F.array_distinct(in_lines)) / F.greatest(lines, F.lit(1)),
        "line_words": n / F.greatest(lines, F.lit(1)),
        "emphasis_share": share(r"!+"),
    }
    stats = F.struct(*[F.coalesce(values[name].cast("double"), F.lit(0.0)).alias(name) for name in STATISTICS])
    return rows.withColumn(out, stats).drop(in_text, in_words, in_lines)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, bound) and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: str = "stats") -> Column:
        out = F.lit(True)
        for name, at_most, bound in self.tests:
            value = F.col(f"{stats}.{name}")
            out = out & ((value <= bound) if at_most else (value > bound))
        return out


@dataclass(frozen=True)
class Model:
    """The score of a text is the logistic function of intercept and the weights of the rules that hold."""

    intercept: float = 0.0
    rules: tuple[Rule, ...] = field(default=())

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


Tests = tuple[tuple[str, bool, float], ...]


def tree_rules(values: np.ndarray, labels: np.ndarray, names: tuple[str, ...], seed: int = 7) -> list[Tests]:
    """The conjunctions of all root-to-node paths of ``TREES`` small trees, each grown on a part of the rows."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x, np.arange(1, CUTS) / CUTS, method="lower")) for x in values.T]
    cell = np.stack([np.searchsorted(e, x) for e, x in zip(edges, values.T)], axis=1)
    found: set[Tests] = set()

    def grow(rows: np.ndarray, tests: Tests) -> None:
        if len(tests) == DEPTH or len(rows) < 2 * LEAST or not 0 < labels[rows].sum() < len(rows):
            return
        best = (1e-12, -1, -1)
        for f in rng.permutation(len(names))[: max(1, round(FEATURES * len(names)))]:
            n = np.cumsum(np.bincount(cell[rows, f], minlength=len(edges[f]) + 1))[:-1]
            ones = np.cumsum(np.bincount(cell[rows, f], labels[rows], len(edges[f]) + 1))[:-1]
            fits = (n >= LEAST) & (len(rows) - n >= LEAST)
            if fits.any():
                n, ones, at = n[fits], ones[fits], np.flatnonzero(fits)
                total, m = labels[rows].sum(), len(rows)
                left, right = ones * (n - ones) / n, (total - ones) * (m - n - total + ones) / (m - n)
                gain = total * (m - total) / m - left - right
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(f), int(at[i])))
        gain, f, i = best
        if f < 0:
            return
        below = cell[rows, f] <= i
        for part, at_most in ((rows[below], True), (rows[~below], False)):
            path = (*tests, (names[f], at_most, float(edges[f][i])))
            found.add(simplified(path))
            grow(part, path)

    for _ in range(TREES):
        grow(rng.permutation(len(values))[: max(1, round(ROWS * len(values)))], ())
    return sorted(found)


def simplified(tests: Tests) -> Tests:
    """The same rule with one bound per statistic and side, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, at_most, bound in tests:
        old = best.get((name, at_most), bound)
        best[name, at_most] = min(old, bound) if at_most else max(old, bound)
    return tuple(sorted((name, at_most, bound) for (name, at_most), bound in best.items()))


def lasso(holds: np.ndarray, labels: np.ndarray, penalty: float = LASSO) -> np.ndarray:
    """Intercept and weights of the logistic model with the least mean loss plus ``penalty`` times the sum of the
    absolute weights, by accelerated proximal gradient steps."""
    x = np.concatenate([np.ones((len(holds), 1)), holds], axis=1)
    v = np.ones(x.shape[1])
    for _ in range(30):
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step = 4 * len(x) / np.linalg.norm(v)
    weights = ahead = np.zeros(x.shape[1])
    pace = 1.0
    for _ in range(STEPS):
        moved = ahead - step * (x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500))) - labels)) / len(x)
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * penalty, 0)
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / faster * (moved - weights)
        done = np.abs(moved - weights).max() < 1e-6
        weights, pace = moved, faster
        if done:
            break
    return weights


def _fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts))
    if not len(rows):
        return
    rows = rows.sort_values(list(rows.columns))
    labels, values = rows["label"].to_numpy(), rows[list(STATISTICS)].to_numpy()
    rules = tree_rules(values, labels, STATISTICS)
    place = {name: i for i, name in enumerate(STATISTICS)}
    holds = np.ones((len(rows), len(rules)))
    for j, tests in enumerate(rules):
        for name, at_most, bound in tests:
            holds[:, j] *= (values[:, place[name]] <= bound) == at_most
    weights = lasso(holds, labels)
    kept = [(w, t) for w, t in zip(weights[1:].tolist(), rules) if abs(w) > 1e-6]
    yield pd.DataFrame({
        "weight": [float(weights[0]), *(w for w, _ in kept)],
        "names": [[], *([t[0] for t in ts] for _, ts in kept)],
        "at_most": [[], *([t[1] for t in ts] for _, ts in kept)],
        "bounds": [[], *([t[2] for t in ts] for _, ts in kept)],
    })


def fit(labelled: DataFrame, label_col: str) -> Model:
    """Fit on rows with ``stats`` and a 0/1 label, bounded by the caller. Without both labels the score is the label's share."""
    sizes = dict(labelled.groupBy(label_col).count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(math.log(share / (1 - share)))
    rows = labelled.select(F.col(label_col).cast("double").alias("label"), *[F.col(f"stats.{s}").alias(s) for s in STATISTICS])
    schema = "weight double, names array<string>, at_most array<boolean>, bounds array<double>"
    (intercept, *_), *rules = sorted(map(tuple, rows.coalesce(1).mapInPandas(_fit, schema).collect()), key=lambda r: len(r[1]) > 0)
    return Model(intercept, tuple(Rule(tuple(zip(names, at_most, bounds)), weight) for weight, names, at_most, bounds in rules))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE
) -> DataFrame:
    """Label and ``stats`` of about ``sample`` labelled rows whose id is not held out, in the shared folder."""
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, 3, 1)).select(id_col, label_col)
    n = usable.count()
    chosen = usable.where(fraction(F.col(id_col), F.lit("quality")) < min(1.0, sample / max(n, 1)))
    texts = docs.where(~held_out(id_col, 3, 1)).where(fraction(F.col(id_col), F.lit("quality")) < min(1.0, sample / max(n, 1)))
    joined = texts.select(id_col, F.col(text_col).alias("text")).join(chosen.withColumnRenamed(label_col, "label"), id_col)
    return stash(statistics(joined).select("label", "stats"), "training")


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Learns from labelled rows that are not held out; only the text is an input of a score. Null texts
    count as empty and get the score of the empty text. Rows without a label, repeated rows and rows
    without an id are scored like all others; null labels are not used. Without labels every score
    is 0.5. Columns of these three names are replaced. Empty in, empty out.
    """
    model = learned(docs, labels, id_col, text_col, label_col, sample)
    (stats,) = unused(docs, "_stats")
    scored = statistics(docs, text_col, stats).withColumn("score", model.score(stats)).drop(stats)
    scored = scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return scored.withColumn("held_out", held_out(id_col, 3, 1))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    return fit(training_rows(docs, labels, id_col, text_col, label_col, sample), "label")


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with their columns as they are."""
    model = learned(docs, labels, id_col, text_col, label_col, sample)
    (stats,) = unused(docs, "_stats")
    return statistics(docs, text_col, stats).where(model.score(stats) >= 0.5).select(*docs.columns)
