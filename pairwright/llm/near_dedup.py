"""MinHash near-dedup (9) with fast similarity sketching, banding and exact verification.

1. ``sketches``: each text's distinct k-word shingles are thrown into ``COORDINATES`` bins. In round i an
   element goes to a hashed bin with value (i, hash), smallest value wins; rounds go on until every
   bin is filled, and after as many rounds as there are bins, round by round one bin takes every
   element. So every coordinate fills, and the share of equal coordinates is concentrated around the
   Jaccard similarity. Coordinates are hashed in ``BANDS`` bands of ``ROWS``.
2. Rows with equal shingle sets collapse to one representative; copies are never paired.
3. Representatives that share a band form a bucket. In each bucket one hub is compared with all others
   on full shingle sets; verified links give components. Only buckets that still hold more than one
   component go on.
4. There the members outside the bucket's first component are compared with all its members, block by
   block inside tasks, on signatures of ``SIGNATURE`` bytes. Pairs across components whose share of
   equal bytes is at most five standard deviations below the threshold's are verified on full sets.
   Only those pairs leave a task, each in the first band that it shares; no candidate is capped.

A pair at the threshold misses all bands with probability (1 - 0.85 ** ROWS) ** BANDS, about 4e-7, and
step 4 with about 3e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm import shingles
from pairwright.llm.common import components, spread_join, stash

BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
SIGNATURE = 512
BLOCK = 1024  # members of a bucket that are compared at a time
_U = np.uint64
_LOW = _U((1 << 48) - 1)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of non-empty sets of 64-bit hashes, one row of t coordinates each."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=_U)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    for i in range(2 * t):
        if not len(items):
            break
        h = shingles.mix(items ^ shingles.mix(np.full(1, i + 1, dtype=_U)))
        bins = ((h >> _U(48)) * _U(t) >> _U(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (h & _LOW) | _U(i << 48))
        open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)[owner]
        owner, items = owner[open_], items[open_]
    return out.reshape(n, t)


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shingles.mix(np.arange(1, BANDS + 1, dtype=_U))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingles.shingle_sets(part.column(1).to_pylist(), k)
                full = [s for s in sets if len(s)]
                marks = sketch(full).reshape(len(full), BANDS, ROWS)
                keys = np.broadcast_to(seeds, (len(full), BANDS)).copy()
                for r in range(ROWS):
                    keys = shingles.mix(keys * _U(31) ^ marks[:, :, r])
                bands = iter(keys.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "set_key", "bands"],
                )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingles.shingle_sets(part.column(1).to_pylist(), k)
                bytes_ = (shingles.mix(sketch(sets, SIGNATURE)) & _U(255)).astype(np.uint8)
                columns = [
                    part.column(0),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in bytes_], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "items", "signature"])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (size of the shingle set), set_key (digest of the set, null if empty), bands (keys)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([rows.schema["id"], *_fields("n long, set_key string, bands array<bigint>")])
    return rows.mapInArrow(_sketch_batches(k), out)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``.

    Rows whose shingle sets have 100 * intersection >= threshold * union are linked; component_id is
    the smallest id reachable, kept says that it is the row's own. Null and blank texts have no
    shingles, are linked with nothing and stay. Rows that repeat an id share its component. Rows
    without an id are left out of links and stay, with a null component. Only the two columns are
    read. Empty in, empty out. ``threshold`` is a percentage of at least 80, for which the bands are laid out.
    """
    marks = stash(sketches(docs, id_col, text_col, k), "sketches")
    known = marks.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    reps = stash(
        known.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "representatives"
    )
    single = known.join(reps.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"], "left_semi")
    members = single.select(F.col("id").alias("rep"), "n", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("hub"))
    members = stash(members.join(buckets.where("m > 1"), ["band", "key"]), "members")
    keys = single.select(F.col("id").alias("rep"), "bands")
    joined = _verified_components(docs, id_col, text_col, k, threshold, members, keys)
    reps = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", "copies", F.coalesce("component", "rep").alias("component_id")
    )
    # Empty sets have no key and join nothing.
    linked = spread_join(known.select("id", "n", "set_key"), reps, ["set_key"], "id", "copies", docs.count())
    alone = marks.where(F.col("set_key").isNull() | F.col("id").isNull()).withColumn("component_id", F.col("id"))
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*cols).unionByName(alone.select(*cols)).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def _verified_components(
    docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int, members: DataFrame, keys: DataFrame
) -> DataFrame:
    """node, component over all verified links between members of a bucket; ``keys`` has all bands of each."""
    wanted = members.select(F.col("rep").alias(id_col)).distinct()
    texts = docs.select(id_col, text_col).join(wanted, id_col, "left_semi").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([texts.schema["id"], *_fields("items array<bigint>, signature binary")])
    sets = stash(texts.mapInArrow(_set_batches(k), out).withColumnRenamed("id", "rep"), "sets")

    pairs = members.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    links = stash(verified(pairs.distinct(), sets.drop("signature"), threshold), "links")
    joined = components(links)

    blocks = _blocks(members.drop("hub"), joined)
    marks = sets.select("rep", "signature").join(keys, "rep").join(blocks.select("rep").distinct(), "rep", "left_semi")
    blocks = blocks.join(marks, "rep")
    blocks = blocks.repartition("band", "key", "_q", "_r").sortWithinPartitions("band", "key", "_q", "_r")
    schema = T.StructType([T.StructField(c, members.schema["rep"].dataType) for c in "ab"])
    pairs = blocks.select("band", "key", "_q", "_r", "_role", "rep", "n", "_component", "bands", "signature")
    pairs = stash(pairs.mapInArrow(_compare(threshold, schema), schema), "pairs")
    found = stash(verified(pairs, sets.drop("signature"), threshold), "links")
    if found.isEmpty():
        return joined
    return components(links.unionByName(found))


def _blocks(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of buckets with more than one component, dealt to pairs (_q, _r) of blocks of their bucket.

    Queries are the members outside the bucket's first component. In the pair (q, r) the queries of
    block q (role 1) meet the members of block r (role 2); where there is one pair, a row has both roles (3)
    or, for the first component, role 2.
    """
    bucket = ["band", "key"]
    named = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("_component", F.coalesce("component", "rep")).drop("component")
    mixed = named.groupBy(*bucket).agg(F.min("_component").alias("_min"), F.max("_component").alias("_max"))
    left = stash(named.join(mixed.where("_min <> _max").drop("_max"), bucket).withColumn("_query", F.col("_component") != F.col("_min")), "open")
    sizes = left.groupBy(*bucket).agg(F.ceil(F.sum(F.col("_query").cast("int")) / BLOCK).cast("int").alias("_nq"))
    rows = left.join(sizes, bucket).withColumn("_nr", F.ceil(F.col("m") / BLOCK).cast("int"))
    slot = F.xxhash64("rep")
    whole = (F.col("_nq") == 1) & (F.col("_nr") == 1)

    def dealt(n: str, role: int):
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: _place(n, role, i, slot))

    one = F.array(F.struct(F.lit(0).alias("_q"), F.lit(0).alias("_r"), F.when(F.col("_query"), 3).otherwise(2).alias("_role")))
    queries = F.when(F.col("_query"), dealt("_nr", 1)).otherwise(F.filter(dealt("_nr", 1), lambda _: F.lit(False)))
    places = F.when(whole, one).otherwise(F.concat(queries, dealt("_nq", 2)))
    return rows.select(*bucket, "rep", "n", "_component", F.inline(places))


def _place(n: str, role: int, i, slot):
    if role == 1:  # a query keeps its block q and meets every block r
        q, r = F.pmod(slot, F.col("_nq")), i
    else:
        q, r = i, F.pmod(slot, F.col("_nr"))
    return F.struct(q.cast("int").alias("_q"), r.cast("int").alias("_r"), F.lit(role).alias("_role"))


def _compare(threshold: int, schema: T.StructType):
    """Pairs (a < b) of a query and a member of another component that are likely enough and share no earlier band."""
    t = threshold / 100
    least = SIGNATURE * (t + (1 - t) / 256) - 5 * math.sqrt(SIGNATURE * t * (1 - t))

    def groups(batches: Iterator[pa.RecordBatch]):
        """The rows of each key in turn, as one table; rows come sorted by key."""
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                key = tuple(k[low] for k in keys) if high > low else last
                if key != last and kept:
                    yield pa.Table.from_batches(kept)
                    kept = []
                last = key
                if high > low:
                    kept.append(batch.slice(low, high - low))
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = [[], []]
        for group in groups(batches):
            role = group["_role"].to_numpy()
            n = group["n"].to_numpy()
            component = group["_component"].to_numpy()
            rep = group["rep"].to_numpy()
            band = group["band"][0].as_py()
            bands = np.array(group["bands"].to_pylist(), dtype=np.int64)
            marks = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint8).reshape(len(rep), SIGNATURE)
            members = np.flatnonzero(role >= 2)
            for x in np.flatnonzero(role & 1):
                y = members[component[members] != component[x]]
                y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * threshold]
                y = y[(marks[y] == marks[x]).sum(axis=1) >= least]
                y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
                if len(y):
                    ids[0].append(np.minimum(rep[y], rep[x]))
                    ids[1].append(np.maximum(rep[y], rep[x]))
        if ids[0]:
            pairs = np.unique(np.stack([np.concatenate(c) for c in ids]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f) for c, f in zip(pairs, _arrow(schema))], names=["a", "b"])

    return run


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).types


def verified(pairs: DataFrame, sets: DataFrame, threshold: int, chunk: int = 256) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. A member of many pairs is dealt over several tasks."""
    heavy = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_copies"))
    salted = pairs.join(heavy, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_copies")).cast("int"))
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("_a")).join(heavy, "a")
    left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("_b"))
    both = salted.drop("_copies").join(right, "b").join(left, ["a", "_salt"])
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return both.where(common * 100 >= union * threshold).select("a", "b")
