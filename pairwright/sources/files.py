"""File sources and sinks (S1-S7) with explicit schemas.

Quoted multi-line CSV and JSON documents that are one array or object are read in many
tasks (``csv_records``, ``json_items``): running sums over the splits of a file tell each split what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

PAIR_SCHEMA = ("id string, original_text string, rewrite_prompt string, "
               "rewritten_text string, cluster int")

# Strings a pandas CSV reader turns into missing values (besides the empty field).
NA_STRINGS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


# S1
def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of quoted CSV files as ``(file, record, text)``, whole and numbered from 0 in each file, read in many tasks.

    A line begins a record if the quotes before it, from the start of its file, are even in number (a doubled quote
    counts twice). Spark splits files by bytes and says where a split begins; the quotes and beginnings of each split are
    summed up, and running sums over the splits of a file tell each split what came before. A task holds the lines of
    one split; only the records at its borders meet those of its neighbours."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    within = Window.partitionBy("file", "split").orderBy("place")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)

    def starts(parity: int):
        return F.sum(F.when(F.col("before") == parity, 1).otherwise(0))

    # one row per split: its quotes, and its beginnings if it begins outside or inside of quotes
    splits = lines.groupBy("file", "split").agg((F.sum("quotes") % 2).alias("odd"), starts(0).alias("outside"), starts(1).alias("inside"))
    of_file = Window.partitionBy("file").orderBy("split")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("parity", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("begins", F.when(F.col("parity") == 0, F.col("outside")).otherwise(F.col("inside")))
    splits = splits.select(F.col("file").alias("_file"), F.col("split").alias("_split"), "parity",
                           (F.coalesce(F.sum("begins").over(earlier), F.lit(0)) - 1).alias("last"))
    lines = lines.join(splits, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split"))).drop("_file", "_split")
    begins = F.when(F.col("before") == F.col("parity"), 1).otherwise(0)
    lines = lines.withColumn("record", F.col("last") + F.sum(begins).over(within))
    parts = lines.groupBy("file", "split", "record", "last").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("lines"))
    parts = parts.withColumn("text", F.array_join(F.transform("lines", lambda x: x["value"]), "\n"))
    ends = F.max("record").over(Window.partitionBy("file", "split"))
    parts = parts.withColumn("inner", (F.col("record") > F.col("last") + 1) & (F.col("record") < ends))
    inner = parts.where("inner").select("file", "record", "text")
    border = parts.where("not inner").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("texts"))
    border = border.select("file", "record", F.array_join(F.transform("texts", lambda x: x["text"]), "\n").alias("text"))
    return inner.unionByName(border).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read_pairs_csv(spark: SparkSession, path: str, schema: str | StructType = PAIR_SCHEMA,
                   na_values=NA_STRINGS) -> DataFrame:
    """Header CSV with quoted multi-line fields and doubled quotes; NA strings -> null.

    Columns are found by their name in the header of the first file, in any order; others are
    left out.  Whole numbers may be written with a fraction of zero ("3.0");
    a value that is not of its column's type becomes null.  One file is read in as many tasks as it has splits."""
    typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    header = spark.read.option("header", True).option("multiLine", True).options(**options).csv(path).columns
    text = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    records = csv_records(spark, path).where((F.col("record") > 0) & (F.trim("text") != ""))
    raw = records.select(F.from_csv("text", text.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    raw = raw.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(header)])
    return raw.select(*[_parsed(F.when(~F.col(f.name).isin(list(na_values)), F.col(f.name)), f) for f in typed.fields])


def _parsed(text: Column, field: StructField) -> Column:
    if not isinstance(field.dataType, IntegralType):
        return text.try_cast(field.dataType).alias(field.name)
    number = text.try_cast("double")
    whole = F.coalesce(text.try_cast(field.dataType), F.when(number == F.rint(number), number.try_cast(field.dataType)))
    return whole.alias(field.name)


# S2-S5
def _running(value: Column) -> Column:
    """Sum of ``value`` over the earlier rows of a split."""
    earlier = Window.partitionBy("file", "split").orderBy("place", "token").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _with_earlier_splits(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the file before it: one number per split is summed up and joined."""
    rows = rows.withColumn("_value", value)
    totals = rows.groupBy("file", "split").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("file").alias("_file"), F.col("split").alias("_split"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    joined = rows.join(starts, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    return joined.withColumn(name, F.col("_start") + _running(F.col("_value"))).drop("_value", "_start", "_file", "_split")


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """The elements of the array, or the members of the object, that a JSON file is: ``(file, item, text)``, read in many tasks.

    The file is cut at its quotes. Running sums tell, one after another, which parts lie in a string (quotes after an odd number of
    backslashes don't count), how deep a bracket lies, and how many commas of the outermost level came before. As with
    ``csv_records`` a task holds one split of the file, and only items at its borders meet those of its neighbours."""
    parts = spark.read.option("lineSep", '"').text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.lit(0).alias("token"))
    ends = F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 0  # the quote after this part begins or ends a string
    parts = _with_earlier_splits(parts, ends.cast("long"), "quotes").withColumn("inside", F.col("quotes") % 2 == 1)
    # a part goes with the quote after it; outside of strings it falls into brackets, commas and the rest
    quote = F.lit('"')
    outside = F.concat(F.regexp_extract_all("value", F.lit(r"[\[\]{},]|[^\[\]{},]+"), 0), F.array(quote))
    tokens = parts.select("file", "split", "place", "inside", F.posexplode(
        F.when(F.col("inside"), F.array(F.concat("value", quote))).otherwise(outside)).alias("token", "text"))
    step = F.when(F.col("inside"), 0).when(F.col("text").isin("[", "{"), 1).when(F.col("text").isin("]", "}"), -1).otherwise(0)
    tokens = _with_earlier_splits(tokens, step, "depth")
    outer = ~F.col("inside") & (((F.col("depth") == 0) & (step == 1)) | ((F.col("depth") == 1) & (step == -1)))
    comma = ~F.col("inside") & (F.col("text") == ",") & (F.col("depth") == 1)
    tokens = _with_earlier_splits(tokens.withColumn("comma", comma).withColumn("outer", outer | (F.col("depth") < 1)), comma.cast("long"), "item")
    kept = tokens.where(~F.col("outer") & ~F.col("comma"))
    pieces = kept.groupBy("file", "split", "item").agg(F.sort_array(F.collect_list(F.struct("place", "token", "text"))).alias("xs"))
    pieces = pieces.withColumn("text", F.array_join(F.transform("xs", lambda x: x["text"]), ""))
    of_split = Window.partitionBy("file", "split")
    border = (F.col("item") == F.min("item").over(of_split)) | (F.col("item") == F.max("item").over(of_split))
    pieces = pieces.withColumn("border", border).select("file", "split", "item", "text", "border")
    whole = pieces.where("border").groupBy("file", "item").agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("xs"))
    whole = whole.select("file", "item", F.array_join(F.transform("xs", lambda x: x["text"]), "").alias("text"))
    return pieces.where("not border").select("file", "item", "text").unionByName(whole).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


# S2
def read_records_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON array of objects -> rows; a missing file gives an empty frame."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return json_items(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


def _members(spark: SparkSession, path: str, value: str) -> DataFrame:
    member = F.concat(F.lit("{"), "text", F.lit("}"))
    return json_items(spark, path).select(F.explode(F.from_json(member, f"map<string,{value}>")))


# S3
def read_variations_json(spark: SparkSession, path: str) -> DataFrame:
    """``{original: [variation, ...]}`` -> ``(original, pos, variation)``.

    An original with an empty list keeps one row with null pos/variation."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "original string, pos int, variation string")
    kv = _members(spark, path, "array<string>").toDF("original", "vs")
    return kv.select("original", F.posexplode_outer("vs").alias("pos", "variation"))


# S4
def read_string_list_json(spark: SparkSession, path: str, out: str = "prompt") -> DataFrame:
    element = F.concat(F.lit("["), "text", F.lit("]"))
    return json_items(spark, path).select(F.from_json(element, "array<string>")[0].alias(out))


# S5
def read_split_map_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"<cluster>": "<split>"}`` -> ``(cluster int, split string)``."""
    return _members(spark, path, "string").toDF("k", "split").select(F.col("k").cast("int").alias("cluster"), "split")


# S6
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("quoteAll", False).csv(path))


# S7
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
