"""Resumable append sink (S8) that shows each key once.

Instead of rewriting a whole output file after every batch, each run reads
the keys already written, computes only the missing rows, and appends them:
into a folder of its own and, when that is complete, with an entry in the sink's log,
which appears by a rename.  A run that fails leaves no entry, so nothing of it is visible, and lost
tasks are Spark's own business.

An entry lists the entries that its run had seen.  Two runs at the same time may compute the same key;
as neither has seen the other, readers take such keys from the earlier entry only.  No lock
is needed, and every reader sees one row per key at any time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import _exists

LOG, RUNS = "_log", "_runs"


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log of a sink in order: name, folder, seen (names) and keys (columns) of each run."""
    log = f"{path.rstrip('/')}/{LOG}"
    if not _exists(spark, log):
        return []
    found = [json.loads(r["value"]) for r in spark.read.option("wholetext", True).text(log).collect()]
    return sorted(found, key=lambda e: e["name"])


def read_entries(spark: SparkSession, path: str, log: Sequence[dict]) -> DataFrame:
    """The rows of these runs, one per key where the runs have keys."""
    base = path.rstrip("/")

    def rows(entry: dict) -> DataFrame:
        return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{base}/{RUNS}/{entry['name']}")

    out = None
    for i, entry in enumerate(log):
        part = rows(entry)
        # earlier runs that were under way at the same time; empty unless runs overlapped
        blind = [e for e in log[:i] if e["name"] not in entry["seen"] and entry["name"] not in e["seen"]]
        if blind and entry["keys"]:
            taken = rows(blind[0]).select(*entry["keys"])
            for e in blind[1:]:
                taken = taken.unionByName(rows(e).select(*entry["keys"]))
            same = [F.col(f"mine.{k}").eqNullSafe(F.col(f"theirs.{k}")) for k in entry["keys"]]
            part = part.alias("mine").join(taken.alias("theirs"), same, "left_anti").select("mine.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_or_empty(spark: SparkSession, path: str | None, schema) -> DataFrame:
    log = entries(spark, path) if path else []
    if log:
        return read_entries(spark, path, log)
    if schema is None:
        return spark.createDataFrame([], "id long")
    return spark.createDataFrame([], schema)


def pending(spark: SparkSession, inputs: DataFrame, path: str, key: Sequence[str] | str,
            log: Sequence[dict] | None = None) -> DataFrame:
    """Inputs whose key is not in the sink yet (as far as ``log`` goes, by default now)."""
    keys = [key] if isinstance(key, str) else list(key)
    log = entries(spark, path) if log is None else log
    if not log:
        return inputs
    return inputs.join(read_entries(spark, path, log).select(*keys), keys, "left_anti")


def append_new_rows(df: DataFrame, path: str, key: Sequence[str] | str = (), seen: Sequence[dict] = ()) -> None:
    """Write a run and enter it into the log. ``seen`` are the entries that ``df`` leaves the keys of out; rows with
    equal keys within the run are written once."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    base = path.rstrip("/")
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = df.dropDuplicates(keys) if keys else df
    rows.write.parquet(f"{base}/{RUNS}/{name}")
    entry = {"name": name, "seen": [e["name"] for e in seen], "keys": keys, "schema": df.schema.jsonValue()}
    jvm = spark.sparkContext._jvm
    hidden, shown = (jvm.org.apache.hadoop.fs.Path(f"{base}/{LOG}/{n}") for n in (f".{name}", name))
    fs = shown.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hidden)
    out.writeBytes(json.dumps(entry))
    out.close()
    if not fs.rename(hidden, shown):
        raise OSError(f"the log entry {shown} could not be made")


def append_results(spark: SparkSession, inputs: DataFrame, path: str, key: Sequence[str] | str,
                   compute, error_col: str | None = None) -> DataFrame:
    """Compute ``compute(pending_inputs)`` for keys missing from ``path``,
    append them, and return the whole sink.  Rows with an error text in
    ``error_col`` are not written, so the next run tries them again."""
    seen = entries(spark, path)
    rows = compute(pending(spark, inputs, path, key, seen))
    append_new_rows(rows if error_col is None else rows.where(F.col(error_col).isNull()).drop(error_col), path, key, seen)
    return read_or_empty(spark, path, None)
