"""Named jobs P1-P6, each a lazy composition of operators.

P1 is one scan with row-local expressions up to the final ``distinct``; the
only Python stage (exact near-identity ratio) sees just the rows whose length
bound allows a high ratio.  P2 shuffles three times (semi join on prompts,
keep-first aggregate, frequency aggregate); every grouping is an aggregate
with map-side combine, so hot keys are collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, IntegerType, LongType, ShortType, StringType

from .. import fixed_values as FV
from ..functions import jsonx as J
from ..functions import tagging
from ..functions import templates as TPL
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import batch as M
from ..operators import dedupe as D
from ..operators import filters as FL
from ..operators import joins as JN
from ..operators import sampling as K
from ..operators import scoring as SC
from ..operators import selection as SEL
from ..session import written
from ..sources.files import write_csv

PAIR_COLUMNS = ("id", "original_text", "rewrite_prompt", "rewritten_text", "cluster")


# ------------------------------------------------------------------ P1
def clean_pairs(df: DataFrame, reject_any_words: Sequence[str] = FV.REJECT_ANY_WORDS,
                word_groups: Sequence[Sequence[str]] = FV.REJECT_ALL_WORD_GROUPS,
                phrases: Sequence[str] = FV.BOILERPLATE_PHRASES,
                max_ratio: float | None = FV.NEAR_IDENTICAL_MAX_RATIO, tagger=None,
                observed: StageCounts | None = None) -> DataFrame:
    """P1. ``observed`` counts the rows after each filter while the result is computed (A11 as a by-product);
    ``max_ratio=None`` leaves out the near-identity stage."""
    seen = observed.after if observed is not None else lambda frame, _: frame
    out = seen(df, "input")
    out = seen(FL.drop_null_rows(out), "drop_null_rows")
    out = seen(FL.reject_if_contains_all(out, "rewrite_prompt", word_groups[0]), "reject_translate")
    out = seen(FL.reject_if_contains_any(out, "rewrite_prompt", reject_any_words), "reject_words")
    for i, group in enumerate(word_groups[1:]):
        out = seen(FL.reject_if_contains_all(out, "rewrite_prompt", group), f"reject_group_{i + 2}")
    out = strip_once(out)
    out = seen(FL.reject_identical(out, "rewritten_text", "original_text"), "reject_identical")
    out = seen(FL.reject_boilerplate(out, "rewritten_text", phrases), "reject_boilerplate")
    if max_ratio is not None:
        out = seen(FL.reject_near_identical(out, "original_text", "rewritten_text", max_ratio), "reject_near_identical")
    out = seen(FL.reject_redundant_prompt(out, "rewrite_prompt", tagger), "reject_redundant")
    out = D.distinct_rows(out.select(*PAIR_COLUMNS))
    out = FL.drop_null_rows(out)
    return out.withColumn("rewritten_text", T.ustrip("rewritten_text"))


# A11
class StageCounts:
    """Rows after each stage of one run, as metrics of that run: no job of their own."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation]] = []

    def after(self, df: DataFrame, stage: str) -> DataFrame:
        metric = Observation()
        self.stages.append((stage, metric))
        return df.observe(metric, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[int, str, int]]:
        """(stage_no, stage, rows); waits for the first action on the observed frame."""
        return [(i, stage, metric.get["rows"]) for i, (stage, metric) in enumerate(self.stages)]


def strip_once(df: DataFrame, col: str = "rewritten_text") -> DataFrame:
    """``strip_preamble`` on ``col``, evaluated once per row: the filters that follow
    test the output of a generator, through which Catalyst doesn't push them."""
    kept = [c for c in df.columns if c != col]
    out = df.select(*kept, F.explode(F.array(T.strip_preamble(col))).alias(col))
    return out.select(*df.columns)


def stage_flags(df: DataFrame, reject_any_words: Sequence[str] = FV.REJECT_ANY_WORDS,
                word_groups: Sequence[Sequence[str]] = FV.REJECT_ALL_WORD_GROUPS,
                phrases: Sequence[str] = FV.BOILERPLATE_PHRASES,
                max_ratio: float | None = FV.NEAR_IDENTICAL_MAX_RATIO,
                stripped: str = "_stripped") -> list[tuple[str, object]]:
    """Per-row "passes stage" conditions of P1's filters, in order
    (``max_ratio=None`` leaves out the near-identity stage); ``stripped`` names
    the column with the rewritten text less its preamble."""
    nn = F.lit(True)
    for c in df.columns:
        nn = nn & F.col(c).isNotNull()
    prompt = F.col("rewrite_prompt")
    stripped = F.col(stripped)
    fl = [("drop_null_rows", nn),
          ("reject_translate", ~T.contains_all_ci(prompt, word_groups[0])),
          ("reject_words", ~T.contains_any_literal(prompt, reject_any_words))]
    for i, group in enumerate(word_groups[1:]):
        fl.append((f"reject_group_{i + 2}", ~T.contains_all_ci(prompt, group)))
    fl += [("reject_identical", stripped != F.col("original_text")),
           ("reject_boilerplate", ~T.contains_any_ci(stripped, phrases))]
    if max_ratio is not None:
        fl.append(("reject_near_identical", ~FL.near_identical_flag("original_text", stripped, max_ratio)))
    fl.append(("reject_redundant", ~tagging.noun_to_be_participle(prompt)))
    return fl


# A11
def stage_counts(df: DataFrame, **kw) -> DataFrame:
    """Rows left after each P1 filter, in one aggregate pass."""
    flags = stage_flags(df, **kw)
    cum = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("s0")]
    for i, (_, cond) in enumerate(flags, start=1):
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.sum(F.when(cum, 1).otherwise(0)).cast("long").alias(f"s{i}"))
    names = ["input"] + [n for n, _ in flags]
    row = df.select("*", F.explode(F.array(T.strip_preamble("rewritten_text"))).alias("_stripped")).agg(*aggs)
    stack = ", ".join(f"{i}, '{n}', s{i}" for i, n in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {stack}) as (stage_no, stage, rows)")


# ------------------------------------------------------------------ P2
def build_final(cleaned: DataFrame, old: DataFrame, variations: DataFrame,
                min_count: int = FV.MIN_ROWS_PER_ORIGINAL, order: str = "id") -> DataFrame:
    """Union (cleaned first), known prompts only, first row per
    (original, prompt), non-blank, originals with at least ``min_count`` rows.

    Keep-first over ``(source, order)`` also performs the exact-duplicate
    removal of the union: the first row of a key is the first copy of itself."""
    cols = list(PAIR_COLUMNS)
    both = D.union_all(cleaned.select(*cols).withColumn("_src", F.lit(0)),
                       old.select(*cols).withColumn("_src", F.lit(1)))
    both = JN.keep_known_prompts(both, variations)
    both = FL.drop_null_rows(both)
    both = D.dedupe_keep_first(both.withColumn("_ord", F.col(order)),
                               ["original_text", "rewrite_prompt"], ["_src", "_ord"] + [c for c in cols if c not in ("original_text", "rewrite_prompt")])
    both = FL.reject_blank(both, ["rewrite_prompt", "rewritten_text"])
    return JN.keep_frequent(both.select(*cols), "original_text", min_count)


# ------------------------------------------------------------------ P5
#: Types whose equal values have one text form, so that equal rows have equal hash keys.
ONE_FORM = (BooleanType, ByteType, ShortType, IntegerType, LongType, StringType, DateType)


def evaluation_set(old: DataFrame, new: DataFrame, splits: DataFrame, seed=1, literal: bool = False,
                   digests: tuple[DataFrame, DataFrame] | None = None, key: str | None = None) -> DataFrame:
    """Non-train rows of both sets, without originals seen in training,
    balanced to equal size, unioned, de-duplicated and non-blank.

    ``literal=True`` keeps unmatched clusters as null splits (then dropped),
    as the original script did; the default treats them as ``train``.
    ``digests`` are both sets with the SHA-256 of the originals in the place of texts, where these are cheaper to
    make: the search for leaks then moves no texts. ``key`` adds a column that tells the rows apart; the result is
    then a filter over a written frame, which reads the same however often it is used."""
    default = None if literal else FV.DEFAULT_SPLIT
    o, n, *narrow = (FL.drop_null_rows(JN.assign_split(d, splits, default)) for d in (old, new, *(digests or ())))
    train = [JN.train_keys(d) for d in narrow or (o, n)]
    if not literal:
        o, n, *narrow = (d.where(F.col("split") != F.lit(FV.DEFAULT_SPLIT)) for d in (o, n, *narrow))
    side, sample = "_evaluation_side", "_evaluation_sample"
    cols = ["original_text", *[c for c in n.columns if c != "original_text"]]
    if ([(f.name, f.dataType) for f in o.schema] == [(f.name, f.dataType) for f in n.schema]
            and all(type(f.dataType) in ONE_FORM and f.dataType == type(f.dataType)() for f in n.schema)):
        # equal rows of both sides are one row with its copies, written once: a histogram and the cut read it
        asked = D.union_all(*(d.select("original_text") for d in narrow)) if narrow else None
        both = D.union_all(n.withColumn(side, F.lit("new")), o.withColumn(side, F.lit("old")))
        rows = D.distinct_rows(JN.remove_leaks(both, *train, asked=asked), side, ("old", "new"))
        rows = rows.withColumn(sample, K.hash_key(seed, cols))
        if key is not None:
            rows = rows.withColumn(key, F.monotonically_increasing_id())
        sides = written(rows, "sides")
        out = K.balance_copies(sides, sample, (f"{side}_old", f"{side}_new")).drop(sample, f"{side}_old", f"{side}_new")
    else:
        o, n = (written(JN.remove_leaks(d, *train, asked=k), name)
                for d, k, name in zip((o, n), narrow or (None, None), ("old_side", "new_side")))
        o_s, n_s = K.balance_samples(o, n, seed)
        out = D.distinct_rows(D.union_all(n_s, o_s))
        if key is not None:
            out = written(out.withColumn(key, F.monotonically_increasing_id()), "evaluation_set")
    out = FL.drop_null_rows(out)
    return FL.reject_blank(out, ["rewritten_text", "rewrite_prompt", "original_text"])


# ------------------------------------------------------------------ P6
def evaluate_rows(eval_set: DataFrame, predictor: Callable | str = M.constant_prediction,
                  encoder: Callable | None = None, key: str | None = None) -> tuple[DataFrame, list[str]]:
    """Predict prompts from a frame without the truth, re-attach the truth by position, then score
    ``|cos^3|`` of the encoded (normalised) truth and prediction.

    ``predictor`` is a function or the name of a module (or Python file) with ``predict``; it maps the frame
    to one with ``rewrite_prompt`` in the same order, or to that and the names of further columns to keep.
    ``encoder`` maps a text Column to a vector Column (native); the default
    is the letter-profile test encoder. ``key`` is the column that ``evaluation_set`` added under that name;
    without it the frame is written first, so that its order stays."""
    encoder = encoder or SC.letter_profile
    if isinstance(predictor, str):
        predictor = M.load_predictor(predictor)
    held = eval_set
    if key is None:
        key = "_evaluation_row"
        held = written(eval_set.withColumn(key, F.monotonically_increasing_id()), "evaluation_input")
    pred, extra = M.run_predictor(held.drop("rewrite_prompt", key), predictor)
    pred = JN.attach_truth(pred.select("rewrite_prompt", *extra), held.withColumnRenamed("rewrite_prompt", "rewrite_prompt_og"), key)
    scored = (pred.withColumn("_na", T.normalize_prompt("rewrite_prompt_og"))
                  .withColumn("_np", T.normalize_prompt("rewrite_prompt"))
                  .withColumn("_a", encoder(F.col("_na")))
                  .withColumn("_p", encoder(F.col("_np")))
                  .withColumn("score", SC.pair_score("_a", "_p"))
                  .drop("_na", "_np", "_a", "_p"))
    cols = ["original_text", "rewritten_text", "rewrite_prompt_og", "rewrite_prompt", "score", "cluster", *extra]
    return scored.select(*cols), extra


def evaluate(eval_set: DataFrame, predictor: Callable | str = M.constant_prediction,
             encoder: Callable | None = None, path: str | None = None, key: str | None = None) -> dict:
    """Rows with their scores and the two summaries (frames); the rows are written once, as Parquet
    into the shared folder and, with ``path``, as CSV."""
    rows, _ = evaluate_rows(eval_set, predictor, encoder, key)
    rows = written(rows, "evaluation")
    if path:
        write_csv(rows, path)
    return {"rows": rows, "score": A.describe(rows, "score"),
            "cluster_score": A.describe_by_cluster(rows, "score", "cluster")}


# ------------------------------------------------------------------ P4
def training_set(final: DataFrame, splits: DataFrame, max_size: int | None = None, seed=1,
                 max_tokens: int = FV.MAX_TRAINING_TOKENS, counter=None) -> DataFrame:
    """Train rows as JSON input/output items rendered into the training
    template, kept when shorter than ``max_tokens`` tokens, with the prompt
    and completion parts split at the response marker."""
    train = FL.filter_split(JN.assign_split(final, splits, FV.DEFAULT_SPLIT), FV.DEFAULT_SPLIT)
    train = K.sample_max(train.select(*PAIR_COLUMNS), max_size, seed)
    items = train.select(
        "id",
        J.to_json_item(original_text="original_text", rewritten_text="rewritten_text").alias("input"),
        J.to_json_item(prompt="rewrite_prompt").alias("output"))
    items = items.withColumn("text", TPL.training_text("input", "output"))
    items = FL.filter_max_tokens(items, "text", max_tokens, counter)
    items = (items.withColumn("prompt_part", T.completion_prompt_part("text"))
                  .withColumn("completion_part", T.completion_target_part("text")))
    return K.seeded_shuffle(items, seed, ["id", "input", "output"])


# ------------------------------------------------------------------ P3
def sampled_target(scored: DataFrame, share: float, closeness: float, seed=0) -> tuple[list[float], float] | None:
    """Mean profile of the candidates whose seeded hash is below ``share`` (None if there are none), and
    ``closeness`` of its largest distance from the mean profile of all."""
    chosen = scored.where(F.conv(F.substring(K.hash_key(f"target{seed}", ["id"]), 1, 8), 16, 10).cast("long") < F.lit(int(share * 16 ** 8)))
    k = chosen.select(F.size("scores")).first()
    if k is None:
        return None
    target, overall = (list(A.mean_profile(d, "scores", k[0]).first()[0]) for d in (chosen, scored))
    return target, closeness * SEL.profile_energy(overall, target)


def select_prompts(pairs: DataFrame, variations: DataFrame, per_cluster: int = FV.PROMPTS_PER_CLUSTER,
                   size: int = FV.SELECTION_SIZE, seed=0, encoder: Callable | None = None,
                   profile=FV.REFERENCE_PROFILE, tolerance: float = FV.SELECTION_TOLERANCE,
                   target_share: float | None = None, closeness: float = 0.25) -> DataFrame:
    """Cluster prompts (+ variations), sample per cluster, encode, score
    against the encoded reference prompts, select greedily.

    The target is the profile's scores or, with ``target_share``, the mean
    profile of that share of the candidates (chosen by a hash); the tolerance
    is then ``closeness`` of its distance from the mean of all."""
    spark = pairs.sparkSession
    encoder = encoder or SC.letter_profile
    prompts = K.sample_per_group(JN.cluster_prompts(pairs, variations), "cluster", "prompt", per_cluster, seed)
    # equal hashes of different prompts get neighbouring ids
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("prompt")).orderBy("prompt")) - 1
    cand = (prompts.withColumn("id", F.xxhash64("prompt") + nth)
                   .withColumn("_norm", T.normalize_prompt("prompt"))
                   .withColumn("embedding", encoder(F.col("_norm"))).drop("_norm"))
    refs_df = spark.createDataFrame([(i, p) for i, p, _ in profile], "ref_id int, prompt string")
    refs = [list(r["e"]) for r in refs_df.orderBy("ref_id").withColumn("_norm", T.normalize_prompt("prompt"))
            .select(encoder(F.col("_norm")).alias("e")).collect()]
    scored = written(SC.score_against_references(cand, refs, "embedding", "scores").select("id", "prompt", "scores"), "scored")
    target = [t for _, _, t in profile]
    if target_share is not None:
        target, tolerance = sampled_target(scored, target_share, closeness, seed) or (target, tolerance)
    ids = SEL.select_until(scored, target, tolerance, size, seed)
    chosen = spark.createDataFrame([(int(i), n) for n, i in enumerate(ids)], "id long, rank int")
    return scored.join(chosen, "id", "inner").select("rank", "prompt").orderBy("rank")
