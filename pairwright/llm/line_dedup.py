"""Line dedup (7) by overlapping three-line windows. DataFrame functions only.

1. A text is cut into lines: a newline or the end of a sentence ends a line, and a line holds at most
   ``LINE_WORDS`` words. A passage put in mid-sentence falls into the same lines only from its first
   sentence end or newline on, and not at all without one. The lines joined give the text again.
2. Every ``WINDOW`` consecutive lines of at least ``MIN_CHARS`` code points together are hashed, trimmed.
3. Windows that occur more than once are found by an aggregation (a frequent window costs one row per
   task) and joined back to their places; all places but the first (smallest doc_id, then position)
   are later occurrences.
4. The covered positions of a document are merged into runs, and the text is put together from what
   lies between the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.llm.common import stash, unused

LINE_WORDS = 12
WINDOW = 3
MIN_CHARS = 60

#: Up to LINE_WORDS words; all but the last do not end a sentence and are followed by blanks on the same line.
LINE = (
    r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09]+){0,%d}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*" % (LINE_WORDS - 1)
)


def lines(text: Column) -> Column:
    """The lines of a text with the white space after them; none for null and for white space alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), 0)


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, pos, hash: one row per window of a document, by the position of its first line."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), lines(F.col(text_col)).alias("_lines"))
    trimmed = F.transform("_lines", lambda line: F.trim(line, F.lit(" \t\n\x0b\x0c\r")))
    marks = F.transform("_trimmed", lambda line: F.struct(F.xxhash64(line).alias("hash"), F.length(line).alias("chars")))

    def window(i: Column) -> Column:
        parts = [F.get("_marks", i + k) for k in range(WINDOW)]
        chars = sum((p["chars"] for p in parts[1:]), parts[0]["chars"])
        return F.struct(i.alias("pos"), F.xxhash64(*[p["hash"] for p in parts]).alias("hash"), chars.alias("chars"))

    starts = F.when(F.size("_marks") >= WINDOW, F.sequence(F.lit(0), F.size("_marks") - WINDOW))
    rows = rows.select("doc", trimmed.alias("_trimmed")).select("doc", marks.alias("_marks"))
    rows = rows.select("doc", F.inline(F.filter(F.transform(starts, window), lambda w: w["chars"] >= MIN_CHARS)))
    return rows.select("doc", "pos", "hash")


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, runs: the merged runs [start, end) of lines that later occurrences cover, in order."""
    places = windows(docs, id_col, text_col)
    repeated = stash(
        places.groupBy("hash").agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("_doc")).where("_n > 1").select("hash", "_doc"),
        "repeated",
    )
    found = places.join(repeated, "hash").select("doc", "pos", "hash", (F.col("doc") == F.col("_doc")).alias("_in_first"))
    same = Window.partitionBy("doc").orderBy("hash", "pos")
    found = found.withColumn("_start", F.when(~F.col("hash").eqNullSafe(F.lag("hash").over(same)), F.col("pos")))
    first_pos = F.last("_start", ignorenulls=True).over(same)
    later = found.withColumn("_first", first_pos).where(~F.col("_in_first") | (F.col("pos") > F.col("_first")))
    order = Window.partitionBy("doc").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(order) > WINDOW, F.lit(True))
    later = later.withColumn("_fresh", fresh.cast("long")).withColumn("_run", F.sum("_fresh").over(order))
    runs = later.groupBy("doc", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + WINDOW).alias("end"))
    return runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the lines of later occurrences removed from the text, plus n_lines, n_removed (long).

    Null texts stay null; empty texts, texts of white space and texts of fewer than three lines have no
    window and stay as they are, as do rows without an id. Rows that repeat an id count as one
    document: the same place in the same id is no later occurrence. A text may become empty; its row
    stays. Other columns are kept; without ``counts`` the columns are those of ``docs``. Empty in, empty out.
    """
    run_doc, runs, cut = unused(docs, "_run_doc", "_runs", "_text_lines")
    found = later_runs(docs, id_col, text_col).withColumnRenamed("doc", run_doc).withColumnRenamed("runs", runs)
    rows = docs.join(found, F.col(id_col) == F.col(run_doc), "left").withColumn(cut, lines(F.col(text_col)))
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(cut)))
    between = F.zip_with(ends, starts, lambda end, start: F.array_join(F.slice(cut, end + 1, start - end), ""))
    text = F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(F.array_join(between, ""))
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    extra = [F.size(cut).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *(extra if counts else []))
