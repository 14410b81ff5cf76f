import re
from collections import defaultdict

from pyspark.sql import functions as F

from pairwright.llm import line_dedup

PASSAGE = " ".join(f"passage{i}" + (". Then" if i % 17 == 16 else "") for i in range(60)) + "."


def brute(rows):
    pattern = re.compile(line_dedup.LINE)
    lines = {i: pattern.findall(t or "") for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(lines):
        cut = [x.strip(" \t\n\x0b\x0c\r") for x in lines[i]]
        for p in range(len(cut) - 2):
            window = tuple(cut[p : p + 3])
            if sum(map(len, window)) < line_dedup.MIN_CHARS:
                continue
            if window in seen:
                gone[i] |= {p, p + 1, p + 2}
            seen.add(window)
    return {i: "".join(x for p, x in enumerate(lines[i]) if p not in gone[i]) if gone[i] else t for i, t in rows}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, hash int, _lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    return out.collect()


def test_against_brute_force(spark):
    rows = [(i, f"Start of {i} here. {PASSAGE} End of {i} there.\nlast line {i}") for i in range(0, 40, 2)]
    rows += [(i, f"own words {i} " * 30) for i in range(1, 40, 2)]  # repeats inside one text
    rows += [(100, None), (101, ""), (102, " \n "), (103, "two\nlines"), (104, PASSAGE), (105, PASSAGE + "\n" + PASSAGE), (106, "x" * 100_000)]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert got == brute(rows)
    assert "passage30" in got[0] and all("passage30" not in got[i] for i in range(2, 40, 2))
    assert got[4].startswith("Start of 4 here. ") and got[4].endswith("last line 4") and got[104] == ""


def test_lines_joined_are_the_text(spark):
    texts = ["a b. c\n\nd  e\tf? g! ", "  lead x", "no end", "w " * 500, "a.b.c d\r\ne", "é. ñ\x0b\x0cz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(line_dedup.lines(F.col("t")), "").alias("j"))
    assert all(r["t"] == r["j"] for r in df.collect())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    same = PASSAGE + " one"
    got = run(spark, [(1, same), (1, same), (None, same), (2, same)])
    assert sorted((str(r["doc_id"]), r["text"] == same) for r in got) == [("1", True), ("1", True), ("2", False), ("None", True)]
    assert run(spark, []) == []
