"""Distributed batch map with an injected function (M1-M8).

``batch_map`` runs ``fn(list) -> list`` over fixed-size slices of each Arrow
batch of its input column.  ``fn`` is built once per partition (pass a
factory for heavy clients or models).  A failing slice yields nulls and an
error text and the job goes on, like a failed API call in a generation loop.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..functions import jsonx as J
from ..functions import templates as TPL
from ..functions import text as T
from ..session import shared_folder


def batch_map(df: DataFrame, in_col: str, fn: Callable | None, out_col: str,
              out_type: str = "string", batch_size: int = 16, error_col: str | None = None,
              fn_factory: Callable[[], Callable] | None = None, window: int = 64) -> DataFrame:
    """``df`` with the function's result for ``in_col``; only that column goes to Python.

    Model batches run over the borders of Arrow batches, so only the last one of a partition may be short. Within
    ``window`` batches the inputs are sorted by length, so that a batch pads little; results keep the order of rows."""
    if fn is None and fn_factory is None:
        raise ValueError("pass fn or fn_factory")

    @F.pandas_udf(f"value {out_type}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = fn_factory() if fn_factory is not None else fn
        held: list = []

        def results(values: list) -> pd.DataFrame:
            order = sorted(range(len(values)), key=lambda i: len(values[i]) if isinstance(values[i], str) else 0)
            outs, errs = [None] * len(values), [None] * len(values)
            for i in range(0, len(values), batch_size):
                at = order[i:i + batch_size]
                try:
                    res = list(f([values[j] for j in at]))
                    if len(res) != len(at):
                        raise ValueError(f"function returned {len(res)} results for {len(at)} inputs")
                    for j, value in zip(at, res):
                        outs[j] = value
                except Exception as exc:  # a failed call becomes null, the run goes on
                    for j in at:
                        errs[j] = repr(exc)
            return pd.DataFrame({"value": pd.Series(outs, dtype="object"), "error": pd.Series(errs, dtype="object")})

        for series in batches:
            held += series.tolist()
            while len(held) >= batch_size * window:
                yield results(held[:batch_size * window])
                held = held[batch_size * window:]
        if held:
            yield results(held)

    # explode keeps one call per row however often its fields are used
    done = df.select("*", F.explode(F.array(run(F.col(in_col)))).alias("_result"))
    done = done.withColumn(out_col, F.col("_result.value"))
    if error_col:
        done = done.withColumn(error_col, F.col("_result.error"))
    return done.drop("_result")


# M1
def batch_generate(df: DataFrame, prompt_col: str, fn: Callable | None = None, batch_size: int = 16,
                   out_col: str = "generated", error_col: str | None = "error",
                   fn_factory: Callable[[], Callable] | None = None) -> DataFrame:
    return batch_map(df, prompt_col, fn, out_col, "string", batch_size, error_col, fn_factory)


# M2
def predict_prompts(df: DataFrame, fn: Callable | None = None, batch_size: int = 16,
                    use_mean_prompt: bool = False, fn_factory: Callable | None = None,
                    out: str = "rewrite_prompt") -> DataFrame:
    """Render the recovery instruction per row, generate, take the ``prompt``
    field (default "Make this text better"), optionally blend with the mean prompt."""
    src = df.withColumn("_instruction", TPL.inference_instruction(
        J.to_json_item(original_text="original_text", rewritten_text="rewritten_text")))
    gen = batch_generate(src, "_instruction", fn, batch_size, "_reply", None, fn_factory)
    pred = J.extract_field("_reply", "prompt", FV.DEFAULT_PREDICTED_PROMPT)
    if use_mean_prompt:
        pred = T.blend_with_mean_prompt(pred)
    return gen.withColumn(out, pred).drop("_instruction", "_reply")


# M8 / T14
def constant_prediction(df: DataFrame, prompt: str = FV.BASELINE_MEAN_PROMPT,
                        out: str = "rewrite_prompt") -> DataFrame:
    """Baseline predictor: the same prompt for every row."""
    return df.withColumn(out, F.lit(prompt))


def run_predictor(df: DataFrame, predictor: Callable) -> tuple[DataFrame, list[str]]:
    """Call a ``predict(df)`` that returns a frame or ``(frame, extra_columns)``."""
    res = predictor(df)
    if isinstance(res, tuple):
        return res[0], list(res[1])
    return res, []


def load_predictor(module: str) -> Callable:
    """The ``predict`` function of a predictor: a module name, or the path of a Python file, from any folder. What it
    defines goes to the executors by value, so they need not find the module."""
    if module.endswith(".py"):
        name = os.path.splitext(os.path.basename(module))[0]
        spec = importlib.util.spec_from_file_location(name, module)
        found = importlib.util.module_from_spec(spec)
        sys.modules[name] = found
        spec.loader.exec_module(found)
    else:
        found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return found.predict


# M3 / K9 / T9
# Fixed value: the fields of a prompt description.
EXAMPLE_SCHEMA = (
    "array<struct<prompt:string,"
    "input_characteristics:struct<type:string,style:string,domain:string,sentiment:string,"
    "complexity:string,length:string,specific_characteristics:string>,"
    "transformation_characteristics:struct<type_of_transformation:string>,"
    "output_characteristics:struct<type:string,style:string,domain:string,sentiment:string,"
    "complexity:string,length:string,specific_characteristics:string>>>"
)


def prompt_requests(spark, n_requests: int, per_request: int = FV.PROMPTS_PER_REQUEST,
                    models=FV.TEXT_MODELS) -> DataFrame:
    """One row per (request, model) with the rendered prompt-creation request."""
    from .joins import fan_out

    reqs = spark.range(n_requests).withColumnRenamed("id", "request_id")
    return fan_out(reqs, models, "model").withColumn("request", TPL.prompt_creation_request(F.lit(per_request)))


def explode_examples(df: DataFrame, reply: str = "generated") -> DataFrame:
    """Rows of the ``examples`` list found in each reply (none on failure)."""
    return df.select("*", F.explode(J.parse_field_as(reply, "examples", EXAMPLE_SCHEMA)).alias("example")) \
             .select("example.*", "model")


def generate_prompts(spark, fns: dict, n_total: int = FV.PROMPTS_TO_GENERATE,
                     per_request: int = FV.PROMPTS_PER_REQUEST, sink: str | None = None) -> DataFrame:
    """Request prompt descriptions until ``n_total`` rows exist (may overshoot).

    Every round is appended to ``sink`` (by default a folder of its own in the shared folder) and
    counted there, so each request is made once.  A round that adds no row raises an error that
    says how many there are; a later call goes on from them."""
    from ..sources.resumable import append_new_rows, read_or_empty

    sink = sink or f"{shared_folder(spark)}/prompts-{uuid.uuid4().hex}"
    have = read_or_empty(spark, sink, None).count()
    while have < n_total:
        n_requests = -(-(n_total - have) // (per_request * len(fns)))
        reqs = prompt_requests(spark, n_requests, per_request, tuple(fns))
        append_new_rows(explode_examples(_by_model(reqs, "request", fns, 1, "generated")), sink)
        before, have = have, read_or_empty(spark, sink, None).count()
        if have == before:
            raise RuntimeError(f"a round of {n_requests} requests per model gave no prompt; {have} of {n_total} are in {sink}")
    return read_or_empty(spark, sink, None)


def _by_model(requests: DataFrame, in_col: str, fns: dict, batch_size: int, out_col: str) -> DataFrame:
    """One pass over ``requests`` (with a ``model`` column): each row goes to its model's function."""
    names = F.struct(F.col("model").alias("model"), F.col(in_col).alias("text"))

    def run(rows: list) -> list:
        out = [None] * len(rows)
        for model in fns:
            own = [i for i, r in enumerate(rows) if r is not None and r["model"] == model]
            for at in range(0, len(own), batch_size):
                part = own[at:at + batch_size]
                try:
                    replies = list(fns[model]([rows[i]["text"] for i in part]))
                except Exception:  # a failed call becomes null, the run goes on
                    continue
                if len(replies) == len(part):
                    for i, reply in zip(part, replies):
                        out[i] = reply
        return out

    @F.pandas_udf("string")
    def call(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(run(rows.to_dict("records")), dtype="object")

    return requests.select("*", F.explode(F.array(call(names))).alias(out_col))


# M4
def generate_texts(prompts: DataFrame, fns: dict, batch_size: int = 1) -> DataFrame:
    """One text per (description, model); rows without text are dropped."""
    from .joins import cross_models

    req = prompts.withColumn("_req", TPL.text_from_description_request(F.to_json("input_characteristics")))
    out = _by_model(cross_models(req.drop("model"), tuple(fns)), "_req", fns, batch_size, "original_text")
    return out.where(F.col("original_text").isNotNull() & (F.col("original_text") != "")).drop("_req")


# M5
def generate_variations(prompts: DataFrame, existing: DataFrame, fn: Callable, col: str = "rewrite_prompt",
                        retry_incomplete: bool = False) -> DataFrame:
    """Long-form variations ``(original, pos, variation)`` for prompts not yet in the map."""
    from .joins import cross_instructions, pending_originals

    todo = pending_originals(prompts, existing, col, retry_incomplete).withColumnRenamed(col, "original")
    req = cross_instructions(todo).withColumn("_req", TPL.variation_request("original", "instruction"))
    gen = batch_generate(req, "_req", fn, 1, "_reply", None)
    return (gen.select("original", "pos", J.extract_field("_reply", "prompt", None).alias("variation"))
               .where(F.col("variation").isNotNull()))


# M6
def rewrite_worklist(pairs: DataFrame, variations: DataFrame, selected: DataFrame,
                     new_rows: DataFrame | None = None, seed=0) -> DataFrame:
    """Work items ``(original_text, rewrite_prompt, cluster, is_selected, order_key, request)``.

    Parents already processed are skipped, selected parents come first, and
    each item carries the rendered two-turn chat request."""
    from .joins import expand_variations, processed_parents, selected_parents
    from .sampling import hash_key

    processed = processed_parents(variations, new_rows) if new_rows is not None else None
    parents = variations.select("original").distinct()
    if processed is not None:
        parents = parents.join(processed, "original", "left_anti")
    chosen = selected_parents(variations, selected, processed).withColumn("is_selected", F.lit(True))
    flagged = (parents.join(chosen, "original", "left")
               .withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
               .withColumn("order_key", hash_key(seed, ["original"])))
    items = expand_variations(pairs, variations).join(
        flagged.withColumnRenamed("original", "parent_prompt"), "parent_prompt", "inner")
    return (items.withColumn("request", TPL.chat_prompt("rewrite_prompt", "original_text"))
                 .select("original_text", "rewrite_prompt", "cluster", "parent_prompt", "pos",
                         "is_selected", "order_key", "request")
                 .orderBy(F.col("is_selected").desc(), "order_key", "pos", "original_text"))


def with_pair_id(df: DataFrame, cols: tuple[str, ...] = ("original_text", "rewrite_prompt", "rewritten_text"),
                 out: str = "id") -> DataFrame:
    """``df`` with an id where it has none: ``sha2`` over the pair columns that are there, null-safe."""
    if out in df.columns:
        return df
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null")) for c in cols if c in df.columns]
    return df.withColumn(out, F.sha2(F.concat_ws("\u0001", *parts), 256))


def generate_rewrites(work: DataFrame, sink: str, fn: Callable | None = None, batch_size: int = 2,
                      fn_factory: Callable | None = None) -> DataFrame:
    """A rewritten text for every work item (``request``), kept in ``sink`` under its id.

    Items that the sink has are not requested again; a failed batch is left out and tried by the next
    run.  Items without an id get one from their original text and prompt, so equal items are one."""
    from ..sources.resumable import append_results

    items = with_pair_id(work, ("original_text", "rewrite_prompt")).dropDuplicates(["id"])
    return append_results(
        work.sparkSession, items, sink, "id",
        lambda todo: batch_generate(todo, "request", fn, batch_size, "rewritten_text", "error", fn_factory), "error")
