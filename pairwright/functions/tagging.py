"""Part-of-speech tags by a bigram model, and the "noun to be participle" test (T6) as one Spark expression.

A word's scores come from a lexicon, else from the longest of its last three, two and one letters that
the model knows; ``score(word, tag) + score(tag before, tag)`` is summed over the most likely sequence of tags
(Viterbi). Scores are whole hundredths of logarithms, so sums are exact and ties are the same everywhere. The
test needs four neighbouring tokens only: each state carries whether its last three tokens are nouns and whether its
path met the pattern, so that no back pointers are kept and a text of any length takes constant space.

``TagModel.learn`` counts tagged rows in Spark; ``DEFAULT`` is counted from a short sample of tagged sentences.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("NN", "VB", "VBN", "JJ", "RB", "DT", "IN", "PRP", "MD", "TO", "CD", "CC", "SYM")
NOUN, PARTICIPLE, SYMBOL = TAGS.index("NN"), TAGS.index("VBN"), TAGS.index("SYM")
TOKEN = r"\p{L}+(?:'\p{L}+)?|[0-9]+(?:[.,][0-9]+)*|[^\s]"
TO_BE = r"(?i)\bto\s+be\b"
SUFFIXES = (3, 2, 1)
IMPOSSIBLE = -1_000_000_000

#: Tagged sentences of this engine's own, for the default model.
SAMPLE = """
the/DT text/NN needs/VB to/TO be/VB rewritten/VBN ./SYM this/DT story/NN has/VB to/TO be/VB told/VBN again/RB ./SYM
the/DT letter/NN is/VB written/VBN in/IN a/DT formal/JJ tone/NN ./SYM make/VB this/DT text/NN more/RB concise/JJ ./SYM
rewrite/VB the/DT paragraph/NN as/IN a/DT poem/NN ,/SYM and/CC keep/VB it/PRP short/JJ ./SYM turn/VB it/PRP into/IN a/DT song/NN ./SYM
there/PRP is/VB a/DT sentence/NN to/TO be/VB improved/VBN ./SYM the/DT style/NN should/MD be/VB clear/JJ and/CC simple/JJ ./SYM
he/PRP wants/VB to/TO be/VB happy/JJ ./SYM she/PRP asked/VB me/PRP to/TO be/VB quiet/JJ ./SYM they/PRP seem/VB to/TO be/VB very/RB busy/JJ ./SYM
we/PRP were/VB given/VBN two/CD examples/NN ./SYM you/PRP can/MD use/VB three/CD words/NN ./SYM i/PRP would/MD like/VB to/TO be/VB a/DT writer/NN ./SYM
the/DT words/NN to/TO be/VB removed/VBN were/VB marked/VBN by/IN the/DT teacher/NN ./SYM it/PRP must/MD be/VB done/VBN before/IN noon/NN ./SYM
change/VB the/DT following/JJ message/NN to/TO sound/VB friendly/JJ ./SYM add/VB details/NN about/IN the/DT weather/NN of/IN the/DT island/NN ./SYM
describe/VB a/DT city/NN built/VBN on/IN water/NN with/IN bright/JJ colors/NN ./SYM imagine/VB that/IN the/DT speaker/NN is/VB a/DT pirate/NN ./SYM
the/DT report/NN to/TO be/VB sent/VBN must/MD not/RB be/VB longer/JJ than/IN one/CD page/NN ./SYM write/VB it/PRP slowly/RB and/CC carefully/RB ./SYM
all/DT tasks/NN to/TO be/VB finished/VBN are/VB listed/VBN here/RB ./SYM these/DT questions/NN have/VB been/VBN answered/VBN ./SYM
some/DT people/NN will/MD never/RB be/VB convinced/VBN ,/SYM but/CC others/NN may/MD ./SYM the/DT house/NN was/VB sold/VBN at/IN a/DT good/JJ price/NN ./SYM
his/PRP idea/NN is/VB to/TO be/VB first/JJ ./SYM their/PRP plan/NN to/TO be/VB free/JJ failed/VB ./SYM no/DT reason/NN to/TO be/VB afraid/JJ was/VB found/VBN ./SYM
the/DT main/JJ point/NN to/TO be/VB made/VBN is/VB known/VBN to/IN her/PRP ./SYM if/IN you/PRP need/VB to/TO be/VB there/RB ,/SYM go/VB now/RB ./SYM
explain/VB how/RB the/DT machine/NN works/VB for/IN children/NN ./SYM translate/VB every/DT line/NN from/IN english/NN or/CC french/NN ./SYM
a/DT quick/JJ answer/NN is/VB often/RB better/JJ ./SYM the/DT document/NN was/VB taken/VBN ,/SYM broken/VBN up/IN and/CC hidden/VBN ./SYM
our/PRP team/NN chose/VB the/DT colors/NN to/TO be/VB used/VBN ./SYM your/PRP essay/NN ought/MD to/TO be/VB understood/VBN easily/RB ./SYM
the/DT data/NN to/TO be/VB kept/VBN ,/SYM the/DT files/NN to/TO be/VB deleted/VBN and/CC the/DT names/NN to/TO be/VB read/VBN ./SYM
it/PRP seems/VB to/TO be/VB in/IN order/NN ./SYM he/PRP could/MD n't/RB be/VB seen/VBN ./SYM what/PRP has/VB changed/VBN since/IN then/RB ?/SYM
i/PRP want/VB to/TO be/VB heard/VBN ./SYM we/PRP hope/VB to/TO be/VB invited/VBN ./SYM you/PRP try/VB to/TO be/VB kind/JJ ./SYM they/PRP deserve/VB to/TO be/VB loved/VBN ./SYM
i/PRP have/VB to/TO be/VB careful/JJ ,/SYM you/PRP are/VB going/VB to/TO be/VB late/JJ ./SYM we/PRP expect/VB to/TO be/VB asked/VBN and/CC they/PRP tend/VB to/TO be/VB ignored/VBN ./SYM
please/RB give/VB me/PRP a/DT more/RB creative/JJ version/NN of/IN this/DT statement/NN !/SYM use/VB an/DT informal/JJ voice/NN :/SYM 12/CD words/NN
"""


@dataclass(frozen=True)
class TagModel:
    """Scores per tag (in the order of ``TAGS``) of words and word ends, and of each tag after each other one."""

    words: Mapping[str, tuple[int, ...]]
    ends: Mapping[str, tuple[int, ...]]
    after: tuple[tuple[int, ...], ...]  # after[before][tag]

    @classmethod
    def from_counts(cls, words: Mapping[tuple[str, str], int], after: Mapping[tuple[str, str], int], max_words: int = 5000) -> TagModel:
        """From counts of (lower-case word, tag) and (tag before, tag); the ``max_words`` most frequent words are the lexicon."""
        tags, by_word, by_end = Counter(), Counter(), Counter()
        for (word, tag), n in words.items():
            tags[tag] += n
            by_word[word] += n
            for k in SUFFIXES:
                if word[-k:].isalpha():
                    by_end[word[-k:], tag] += 1
        total = sum(tags.values())
        share = {t: (tags[t] + 1) / (total + len(TAGS)) for t in TAGS}

        def scores(counts: list[int], strength: float) -> tuple[int, ...]:
            # counts pulled towards the shares of the tags, over the share of the tag
            n = sum(counts)
            return tuple(round(100 * math.log((c + strength * share[t]) / (n + strength) / share[t])) for c, t in zip(counts, TAGS))

        kept = sorted(by_word, key=lambda w: (-by_word[w], w))[:max_words]
        open_ends = {e for e, _ in by_end}
        follows = Counter(after)
        rows = []
        for before in TAGS:
            n = sum(follows[before, t] for t in TAGS)
            rows.append(tuple(round(100 * math.log((follows[before, t] + 2 * share[t]) / (n + 2))) for t in TAGS))
        return cls(
            {w: scores([words.get((w, t), 0) for t in TAGS], 0.1) for w in kept},
            {e: scores([by_end[e, t] for t in TAGS], 1.0) for e in sorted(open_ends)},
            tuple(rows),
        )

    @classmethod
    def learn(cls, tagged: DataFrame, tokens: str = "tokens", tags: str = "tags", max_words: int = 5000, least: int = 1) -> TagModel:
        """Count tagged rows: two arrays of equal length per row, tags as in ``TAGS`` (others count as the longest
        of these that they begin with, else SYM; NNS as NN). Rows of unequal length or null are not used. The driver gets the
        counts of the ``max_words`` most frequent pairs of a word seen ``least`` times and a tag."""
        rows = tagged.where((F.size(tokens) == F.size(tags)) & (F.size(tags) > 0)).select(F.col(tokens).alias("w"), F.col(tags).alias("g"))

        def named(tag: Column) -> Column:
            out = F.lit("SYM")
            for known in sorted(TAGS, key=len):
                out = F.when(tag.startswith(known), F.lit(known)).otherwise(out)
            return out

        items = rows.select(F.explode(F.arrays_zip("w", "g")).alias("x")).select(F.lower("x.w").alias("word"), named(F.col("x.g")).alias("tag"))
        words = items.groupBy("word", "tag").count().where(F.col("count") >= least).orderBy(F.desc("count"), "word", "tag").limit(max_words)
        # the tag before lies in the same row; the first follows a symbol
        steps = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.struct(
            F.when(i > 0, F.get("g", i - 1)).alias("p"), F.get("g", i).alias("g")))).alias("s"))
        after = steps.groupBy(named(F.col("s.p")).alias("p"), named(F.col("s.g")).alias("g")).count()
        return cls.from_counts({(r[0], r[1]): r[2] for r in words.collect()}, {(r[0], r[1]): r[2] for r in after.collect()}, max_words)

    @cached_property
    def unknown(self) -> tuple[int, ...]:
        """Scores of a word of which no end is known: a noun, unless what is before says otherwise."""
        return tuple(0 if t == "NN" else -100 if t in ("VB", "VBN", "JJ", "RB") else -700 for t in TAGS)

    @cached_property
    def mark(self) -> tuple[int, ...]:
        return tuple(0 if t == "SYM" else -2000 for t in TAGS)

    @cached_property
    def number(self) -> tuple[int, ...]:
        return tuple(0 if t == "CD" else -2000 for t in TAGS)

    def scores(self, word: Column) -> Column:
        """Scores of a lower-case token."""
        ends = [_lookup(self.ends, F.right(word, F.lit(k))) for k in SUFFIXES]
        return F.coalesce(
            _lookup(self.words, word), F.when(word.rlike("^[0-9]"), _array(self.number)),
            F.when(~word.rlike(r"^\p{L}"), _array(self.mark)), *ends, _array(self.unknown),
        )


def _array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _lookup(table: Mapping[str, tuple[int, ...]], key: Column) -> Column:
    # one constant for the whole table
    constant = F.from_json(F.lit(json.dumps(table)), "map<string,array<int>>")
    return F.try_element_at(constant, key)


def _counted_sample() -> TagModel:
    pairs = [tuple(item.rsplit("/", 1)) for item in SAMPLE.split()]
    words = Counter((w.lower(), t) for w, t in pairs)
    after = Counter(zip(["SYM", *(t for _, t in pairs)], [t for _, t in pairs]))
    return TagModel.from_counts(words, after)


DEFAULT = _counted_sample()


def noun_to_be_participle(c, model: TagModel = DEFAULT) -> Column:
    """Whether four tokens in a row are a noun, "to", "be" and a past participle in the most likely tags; null for null.

    Texts without "to be" are not tagged."""
    text = F.col(c) if isinstance(c, str) else c
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)
    before = F.array(*[_array(row[j] for row in model.after) for j in range(len(TAGS))])  # by tag, then tag before

    def path(score, nouns, met) -> Column:
        return F.struct(score.cast("long").alias("score"), nouns.cast("int").alias("nouns"), met.alias("met"))

    start = F.struct(
        F.lit(0).alias("to_be"),
        F.array(*[path(F.lit(0 if j == SYMBOL else IMPOSSIBLE), F.lit(0), F.lit(False)) for j in range(len(TAGS))]).alias("paths"),
    )

    def step(state: Column, word: Column) -> Column:
        best = F.transform(before, lambda row: F.array_max(F.zip_with(
            state["paths"], row, lambda p, w: path(p["score"] + w, p["nouns"], p["met"]))))
        best = F.zip_with(best, model.scores(word), lambda p, e: F.struct(p.alias("p"), e.alias("e")))
        here = state["to_be"] == 2
        paths = F.transform(best, lambda b, j: path(
            b["p"]["score"] + b["e"],
            F.shiftleft(b["p"]["nouns"], 1).bitwiseAND(F.lit(7)).bitwiseOR(F.when(j == NOUN, 1).otherwise(0)),
            b["p"]["met"] | (here & (j == PARTICIPLE) & (b["p"]["nouns"] >= 4)),
        ))
        to_be = F.when(word == "to", 1).when((word == "be") & (state["to_be"] == 1), 2).otherwise(0)
        return F.struct(to_be.alias("to_be"), paths.alias("paths"))

    found = F.aggregate(words, start, step, lambda state: F.array_max(state["paths"])["met"])
    return F.when(text.rlike(TO_BE), found).when(text.isNotNull(), F.lit(False))


def redundant_sql(source: str, column: str = "text", model: TagModel = DEFAULT) -> str:
    """DuckDB CTEs for a recursive query that end with ``redundant(text)``: the texts of ``source`` that the test is true for.

    The model's tables are relations and the most likely path is found row by row."""

    def rows(table: Mapping[str, tuple[int, ...]]) -> str:
        return ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', {list(v)})" for k, v in table.items())

    after = ", ".join(f"({i}, {j}, {w})" for i, row in enumerate(model.after) for j, w in enumerate(row))
    return rf"""
        lexicon(word, scores) AS (VALUES {rows(model.words)}),
        word_end(word, scores) AS (VALUES {rows(model.ends)}),
        follows(before, tag, w) AS (VALUES {after}),
        asked AS (SELECT DISTINCT {column} AS text FROM {source} WHERE regexp_matches({column}, '(?i)\bto\s+be\b')),
        listed AS (SELECT text, list_transform(regexp_extract_all(text, '\p{{L}}+(?:''\p{{L}}+)?|[0-9]+(?:[.,][0-9]+)*|[^\s]'), lambda x: lower(x)) AS ws FROM asked),
        token AS (SELECT text, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n, ws FROM listed),
        scored AS (
          SELECT t.text, t.i, t.n, i > 2 AND ws[i - 2] = 'to' AND ws[i - 1] = 'be' AS here,
                 CASE WHEN l.scores IS NOT NULL THEN l.scores
                      WHEN regexp_matches(t.word, '^[0-9]') THEN {list(model.number)}
                      WHEN NOT regexp_matches(t.word, '^\p{{L}}') THEN {list(model.mark)}
                      ELSE coalesce(x3.scores, x2.scores, x1.scores, {list(model.unknown)}) END AS scores
          FROM token t LEFT JOIN lexicon l ON l.word = t.word
          LEFT JOIN word_end x3 ON x3.word = right(t.word, 3) LEFT JOIN word_end x2 ON x2.word = right(t.word, 2)
          LEFT JOIN word_end x1 ON x1.word = right(t.word, 1)),
        walk AS (
          SELECT text, 0 AS i, j AS tag, CASE WHEN j = {SYMBOL} THEN 0 ELSE {IMPOSSIBLE} END::BIGINT AS score, 0 AS nouns, false AS met
          FROM asked, range({len(TAGS)}) r(j)
          UNION ALL
          SELECT b.text, b.i, b.tag, best.score + s.scores[b.tag + 1], ((best.nouns * 2) & 7) + CASE WHEN b.tag = {NOUN} THEN 1 ELSE 0 END,
                 best.met OR (s.here AND b.tag = {PARTICIPLE} AND best.nouns >= 4)
          FROM (SELECT k.text, k.i + 1 AS i, f.tag::BIGINT AS tag, max({{score: k.score + f.w, nouns: k.nouns, met: k.met}}) AS best
                FROM walk k JOIN follows f ON f.before = k.tag GROUP BY k.text, k.i + 1, f.tag) b
          JOIN scored s ON s.text = b.text AND s.i = b.i),
        redundant AS (
          SELECT w.text FROM walk w JOIN (SELECT DISTINCT text, n FROM token) t ON t.text = w.text AND t.n = w.i
          GROUP BY w.text HAVING max({{score: score, nouns: nouns, met: met}}).met)"""
