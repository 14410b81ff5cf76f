"""Secret scans (8) with inferred grammars.

Base spans come from fixed patterns. Their values, labelled by kind, are split by their shape (the symbol classes
and marks they use), and each format teaches one probabilistic
automaton: the values of a bounded sample form a prefix tree over symbol classes, and states
whose outgoing frequencies are statistically compatible (Hoeffding bound) are merged, red states
first. Every other run of credential characters in a text is then scored by its log-likelihood
under the automata, per symbol, less that under the background: a bigram model of ordinary words, or an automaton
of a public format (identifiers of the UUID form, times, dotted numbers) where that is higher; runs above the
threshold of an automaton are spans of kind ``grammar``. Base spans always stay. The bigrams and the
thresholds come from words that are too short to be judged and from the labelled values, so that hidden secrets,
however many, don't teach the background or set a threshold. Runs of less than 16 characters are not judged: base hex values
begin there, and likelihoods per symbol of shorter ones overlap with those of words.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import fraction

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of HEX that are long enough
HINTS = ("password", "passwd", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Runs that are too short for a candidate.
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{3,15}(?![A-Za-z0-9+/_.=-])")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
UNSEEN = math.log(1e-4)
FEWEST = 5  # values that make a format
FORMS = ("xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", "XXXXXXXX-XXXX-XXXX-XXXX-XXXXXXXXXXXX", "dddd-dd-ddTddddddZ", "dddd-dd-dd-dd-dd-dd", "ddd.ddd.ddd.ddd-ddddd", "dddddddddddddddddddd")


def symbols(value: str) -> str:
    """A value as symbol classes: d digit, x a-f, l other lower case, X A-F, U other upper case, marks as they are."""
    return value.translate(_CLASSES)


_CLASSES = {c: "d" for c in range(48, 58)} | {c: "x" if c < 103 else "l" for c in range(97, 123)} | {c: "X" if c < 71 else "U" for c in range(65, 91)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches per kind that are long enough."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def other_runs(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters that no base span touches; spans are in order of their start."""
    ends, most = [], 0
    for _, _, end in spans:
        most = max(most, end)
        ends.append(most)
    k = 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and ends[k] <= m.start():
            k += 1
        if k == len(spans) or spans[k][1] >= m.end():
            yield m.start(), m.end()


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: per state, symbol -> (next state, log-probability), and that of ending."""

    moves: list[dict[str, tuple[int, float]]]
    final: list[float]

    def likelihood(self, word: str) -> float:
        """Log-likelihood per symbol; a symbol unseen in a state costs ``UNSEEN`` and stays."""
        state, total = 0, 0.0
        for c in word:
            state, p = self.moves[state].get(c, (state, UNSEEN))
            total += p
        return (total + self.final[state]) / (len(word) + 1)


class _Tree:
    """Frequency prefix tree whose states are merged in place."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end = [0]
        for word in words:
            state = 0
            for c in word:
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                state = self.next[state][c]
            self.end[state] += 1

    def total(self, s: int) -> int:
        return self.end[s] + sum(self.count[s].values())

    def compatible(self, a: int, b: int, width: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if not na or not nb:
                continue
            bound = width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.end[a] / na - self.end[b] / nb) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > bound:
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree under b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]


def infer(words: list[str], alpha: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the prefix tree of ``words`` (symbol classes)."""
    tree = _Tree(sorted(words))
    width = math.sqrt(0.5 * math.log(2 / alpha))
    red, parent = [0], {}
    for c, s in tree.next[0].items():
        parent[s] = (0, c)
    blue = list(parent)
    while blue:
        blue.sort(key=lambda s: (-tree.total(s), s))
        state = blue.pop(0)
        source, symbol = parent[state]
        for r in red:
            if tree.compatible(r, state, width):
                tree.next[source][symbol] = r
                tree.fold(r, state)
                break
        else:
            red.append(state)
        parent = {s: (r, c) for r in red for c, s in tree.next[r].items() if s not in red}
        blue = list(parent)
    number = {s: i for i, s in enumerate(red)}
    moves, final = [], []
    for s in red:
        n = tree.total(s)
        moves.append({c: (number[tree.next[s][c]], math.log(k / n)) for c, k in tree.count[s].items()})
        final.append(math.log(tree.end[s] / n) if tree.end[s] else UNSEEN)
    return Automaton(moves, final)


@dataclass
class Model:
    """One automaton per format with its own threshold, the background, and the threshold of ``score``."""

    automata: list[Automaton]
    limits: list[float]
    bigrams: dict[str, float]
    public: list[Automaton]
    threshold: float

    def background(self, word: str) -> float:
        ordinary = sum(self.bigrams.get(word[max(0, i - 1) : i + 1], STRANGE) for i in range(len(word))) / (len(word) + 1)
        return max([ordinary, *(a.likelihood(word) for a in self.public)])

    def scores(self, value: str) -> list[float]:
        """What each automaton says beyond the background."""
        word = symbols(value)
        background = self.background(word)
        return [a.likelihood(word) - background for a in self.automata]

    def score(self, value: str) -> float:
        """How far the value is above the threshold of a format, for the format it suits best."""
        return max((x - limit for x, limit in zip(self.scores(value), self.limits)), default=-math.inf)


#: A pair of symbols that no ordinary word has: a tenth of the background is spread over all symbols.
STRANGE = math.log(0.1 / 10)


def shape(value: str) -> str:
    """The symbol classes and marks of a value; hexadecimal digits and letters of one case are one class."""
    found = set(symbols(value))
    if "l" in found:
        found.add("x")
    if "U" in found:
        found.add("X")
    return "".join(sorted(found))


def formats(values: dict[str, list[str]]) -> list[list[str]]:
    """The labelled values by kind and shape; rare shapes of a kind go together."""
    out = []
    for _, words in sorted(values.items()):
        by_shape: dict[str, list[str]] = defaultdict(list)
        for v in words:
            by_shape[shape(v)].append(v)
        rare = [v for vs in by_shape.values() if len(vs) < FEWEST for v in vs]
        out += [vs for _, vs in sorted(by_shape.items()) if len(vs) >= FEWEST]
        out += [rare] if len(rare) >= FEWEST else []
    return out


def public_formats(n: int = 200, seed: int = 11) -> list[Automaton]:
    """Automata of formats that are no secrets, from strings drawn by their form."""
    rng = random.Random(seed)
    letters = {"x": "ddddddddddxxxxxx", "X": "ddddddddddXXXXXX", "d": "d"}
    return [infer(["".join(rng.choice(letters.get(c, c)) for c in form) for _ in range(n)]) for form in FORMS]


def learn(values: dict[str, list[str]], ordinary: list[str], quantile: float = 0.05) -> Model:
    """A model from labelled values and ordinary words, which must not hold what is to be judged.

    The threshold of a format is the ``quantile`` of its own values' scores, or the score that one in a
    thousand strings drawn from the bigrams exceeds if that is higher. Without labelled values nothing
    is above it.
    """
    groups = formats(values)
    automata = [infer([symbols(v) for v in words]) for words in groups]
    pairs: Counter[str] = Counter()
    for v in ordinary:
        word = symbols(v)
        pairs.update(word[max(0, i - 1) : i + 1] for i in range(len(word)))
    firsts: dict[str, int] = defaultdict(int)
    for pair, n in pairs.items():
        firsts[pair[:-1]] += n
    bigrams = {p: math.log(0.9 * n / firsts[p[:-1]] + 0.01) for p, n in pairs.items()}
    model = Model(automata, [0.0] * len(automata), bigrams, public_formats() if automata else [], 0.0)
    if not automata:
        model.threshold = math.inf
        return model
    strangers = [model.scores(v) for v in drawn(pairs, sorted(len(v) for words in groups for v in words))]
    for i, words in enumerate(groups):
        own = sorted(model.scores(v)[i] for v in words)
        others = sorted(x[i] for x in strangers) or [-math.inf]
        model.limits[i] = max(own[int(quantile * len(own))], others[int(0.999 * len(others))], 0.0)
    return model


_SHOWN = {"d": "0", "x": "a", "l": "z", "X": "A", "U": "Z"}  # a character of each class


def drawn(pairs: Counter[str], lengths: list[int], n: int = 5000, seed: int = 8) -> list[str]:
    """``n`` strings drawn from counts of bigrams, of the given lengths in turn; none without bigrams."""
    after: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
    for pair, k in sorted(pairs.items()):
        after[pair[:-1]][0].append(pair[-1])
        after[pair[:-1]][1].append(k)
    rng, out = random.Random(seed), []
    for i in range(n if pairs else 0):
        word = ""
        while len(word) < lengths[i % len(lengths)]:
            word += rng.choices(*after[word[-1:] if word[-1:] in after else ""])[0]
        out.append("".join(_SHOWN.get(c, c) for c in word))
    return out


def fit(docs: DataFrame, id_col: str, text_col: str, sample: int = 1000, most_chars: int = 128) -> Model:
    """Learn from the base spans of ``docs``: about ``sample`` distinct values of each kind, chosen by a hash,
    of at most ``most_chars`` symbols, and about ten times as many words of about twice ``sample`` documents.
    These bounds hold for what is learned from; the scan itself covers all texts."""

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                found = {(k, ASSIGN.match(text, s, e)[2] if k == "assign" else text[s:e]) for k, s, e in base_spans(text)}
                out.append([{"kind": k, "value": v} for k, v in sorted(found) if len(v) <= most_chars])
            yield pd.Series(out)

    def prose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                parts, at = [], 0
                for _, s, e in base_spans(text):
                    parts.append(text[at:s])  # empty inside another span
                    at = max(at, e)
                words = set(WORD.findall(" ".join([*parts, text[at:]])))
                out.append([{"kind": "ordinary", "value": w} for w in sorted(words)])
            yield pd.Series(out)

    text = F.coalesce(F.col(text_col), F.lit(""))
    few = docs.where(fraction(F.col(id_col), text, F.lit("words")) < min(1.0, 2 * sample / max(docs.count(), 1)))
    found = [rows.select(F.inline(F.pandas_udf(f, "array<struct<kind:string,value:string>>")(text))) for rows, f in ((docs, scan), (few, prose))]
    found = found[0].unionByName(found[1]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("_u", fraction("kind", "value"))
    sizes = dict(found.groupBy("kind").count().collect())  # at most four kinds
    bound = {k: (10 if k == "ordinary" else 1) * sample for k in sizes}
    if not sizes:
        return learn({}, [])
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, bound[k] / n))])
    rows = found.where(F.col("_u") < shares[F.col("kind")]).select("kind", "value").collect()
    by_kind: dict[str, list[str]] = defaultdict(list)
    for kind, value in sorted(map(tuple, rows)):
        by_kind[kind].append(value)
    return learn({k: v for k, v in by_kind.items() if k != "ordinary"}, by_kind.get("ordinary", []))


def spans_of(text: Column, model: Model) -> Column:
    """All spans of a text by start, then kind: array<struct<kind, start, end, score>>; base spans have no score."""

    @F.pandas_udf(SPANS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for text in series:
                spans = base_spans(text)
                found = [(k, s, e, None) for k, s, e in spans]
                for s, e in other_runs(text, spans):
                    score = model.score(text[s:e])
                    if score >= model.threshold:
                        found.append(("grammar", s, e, score))
                found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                out.append([dict(zip(("kind", "start", "end", "score"), x)) for x in found])
            yield pd.Series(out)

    return scan(F.coalesce(text, F.lit("")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000) -> DataFrame:
    """id, secrets (``SPANS``) for every row of ``docs``; positions are code points of the whole text, end exclusive.

    Null and empty texts have no spans. Repeated rows get the same spans. Other columns are not read.
    Empty in, empty out.
    """
    model = fit(docs, id_col, text_col, sample)
    return docs.select(F.col(id_col), spans_of(F.col(text_col), model).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
