"""Sources: delimited files in unknown encoding, nested JSON, splits, logs, text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.schemas import SRC_ANNOTATED, SRC_ANNOTATED_MAP
from labelmill.storage import materialize


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding)``: utf-8 if every line of the file is valid UTF-8, else latin-1.

    Files are read as splittable lines, not as whole blobs; a line break never falls inside a character.
    """
    lines = spark.read.text(path)
    valid = F.min(F.is_valid_utf8("value"))
    return (
        lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(valid.alias("valid"))
        .select("path", F.when(F.col("valid"), "utf-8").otherwise("latin-1").alias("encoding"))
    )


FILES_SENT = 20_000  # encodings of files, a path of some 100 bytes each, that may be sent to all tasks


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with quoted line breaks, each file in its own encoding; column names are ASCII.

    One plan for all files: they are read byte by byte, which keeps quotes, commas and line breaks apart in both encodings, and the
    texts of files in UTF-8 are decoded in the plan. Encodings are a table joined on the path; no list of files reaches the driver.
    """
    encodings = materialize(file_encodings(spark, path), "encodings")
    few = encodings.limit(FILES_SENT + 1).count() <= FILES_SENT
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False, "encoding": "ISO-8859-1"}
    rows = spark.read.options(**options).schema(schema).csv(path).withColumn("_path", F.col("_metadata.file_path"))
    known = encodings.select(F.col("path").alias("_path"), F.col("encoding").alias("_encoding"))
    rows = rows.join(F.broadcast(known) if few else known, "_path")

    def decoded(name: str) -> Column:
        raw = F.col("`" + name.replace("`", "``") + "`")
        return F.when(F.col("_encoding") == "utf-8", F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8")).otherwise(raw)

    return rows.select(*[(decoded(f.name) if f.dataType.simpleString() == "string" else F.col("`" + f.name.replace("`", "``") + "`")).alias(f.name)
                         for f in schema.fields])


def explode_posts(documents: DataFrame, json: str = "value", key: str = "post_id") -> DataFrame:
    """JSON objects keyed by record id -> one row per record."""
    records = F.from_json(F.col(json), SRC_ANNOTATED_MAP)
    return documents.select(F.explode(records).alias(key, "_post")).select(key, "_post.*")


def _json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every comma: ``(_file, _block, _at, _piece)``, and what a piece does to the state of a JSON scan.

    ``_quotes``: whether it holds an odd number of quotes; ``_outer`` and ``_inner``: how much deeper it goes if it starts outside
    and inside a string. An escape never reaches over a comma.
    """
    bare = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    depth = lambda x: F.regexp_count(x, F.lit(r"[{\[]")) - F.regexp_count(x, F.lit(r"[}\]]"))
    runs = F.transform(F.col("_bare"), lambda x, i: F.struct((i % 2).alias("odd"), depth(x).cast("long").alias("d")))
    total = lambda odd: F.aggregate(F.filter("_runs", lambda r: r["odd"] == odd), F.lit(0).cast("long"), lambda n, r: n + r["d"])
    read = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_piece"), bare.alias("_bare"))
    return read.withColumn("_runs", runs).select(
        "_file", "_block", "_at", "_piece", ((F.size("_bare") - 1) % 2).cast("long").alias("_quotes"), total(0).alias("_outer"), total(1).alias("_inner"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, value)``: the entries of files that hold one JSON object each, every entry as an object of its own.

    Files are read in byte ranges, so one object of any size is read by many tasks. Within a range, pieces between commas are
    numbered by how the scan would go on if the range began outside or inside a string; one row for each range then tells
    its true state, and with it which commas part entries. ``record`` counts a file's entries from 0. Blank files: none.
    """
    here, files = Window.partitionBy("_file", "_block").orderBy("_at"), Window.partitionBy("_file").orderBy("_block")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    # ``_deep0``, ``_deep1``: the step in depth of a piece if its range starts outside, inside a string.
    tagged = _json_pieces(spark, path).withColumn("_odd", before("_quotes", here) % 2)
    tagged = tagged.withColumns({"_deep0": F.when(F.col("_odd") == 0, F.col("_outer")).otherwise(F.col("_inner")),
                                 "_deep1": F.when(F.col("_odd") == 0, F.col("_inner")).otherwise(F.col("_outer"))})
    tagged = tagged.withColumns({"_up0": before("_deep0", here), "_up1": before("_deep1", here)})
    tagged = materialize(tagged.select("_file", "_block", "_at", "_piece", "_quotes", "_odd", "_deep0", "_deep1", "_up0", "_up1"), "json-pieces")
    ranges = tagged.groupBy("_file", "_block").agg(F.sum("_quotes").alias("_quotes"), F.sum("_deep0").alias("_deep0"), F.sum("_deep1").alias("_deep1"))
    ranges = ranges.withColumn("_inside", before("_quotes", files) % 2)
    ranges = ranges.withColumn("_deep", F.when(F.col("_inside") == 0, F.col("_deep0")).otherwise(F.col("_deep1")))
    ranges = ranges.select("_file", "_block", "_inside", before("_deep", files).alias("_from"))
    # The comma before a piece parts two entries if it stands outside strings at depth 1.
    outside = (F.col("_inside") + F.col("_odd")) % 2 == 0
    depth = F.col("_from") + F.when(F.col("_inside") == 0, F.col("_up0")).otherwise(F.col("_up1"))
    parted = tagged.join(ranges, ["_file", "_block"]).select("_file", "_block", "_at", "_piece", (outside & (depth == 1)).cast("long").alias("_new"))
    parted = parted.withColumn("_nth", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = parted.groupBy("_file", "_block").agg(F.sum("_new").alias("_of")).select("_file", "_block", before("_of", files).alias("_start"),
                                                                                           F.sum("_of").over(Window.partitionBy("_file")).alias("_last"))
    entries = parted.join(firsts, ["_file", "_block"]).groupBy(F.col("_file").alias("path"), (F.col("_start") + F.col("_nth")).alias("record"), "_last").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "_piece"))).alias("_pieces"))
    body = F.array_join(F.transform("_pieces", lambda x: x["_piece"]), ",")
    opened = F.when(F.col("record") == 0, F.regexp_replace("_body", r"^[\s\x{FEFF}]*\{", "")).otherwise(F.col("_body"))
    # The last entry of a file brings the object's closing brace; any other is closed by one brace less than it opens.
    value = F.concat(F.lit("{"), opened, F.when(F.col("record") == F.col("_last"), "").otherwise("}"))
    whole = entries.select("path", "record", "_last", body.alias("_body")).select("path", "record", value.alias("value"))
    return whole.filter(~F.col("value").rlike(r"^[\s{}]*$"))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Files with one keyed JSON object each, read by as many tasks as they have byte ranges."""
    return explode_posts(read_records(spark, path))


def read_annotated_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same posts as JSON lines: on each line either one record with its ``post_id``, or an object keyed by it."""
    lines = spark.read.text(path)
    record = F.from_json("value", SRC_ANNOTATED)
    keyed = F.map_entries(F.from_json("value", SRC_ANNOTATED_MAP))
    posts = [F.col(f"_one.{f}") for f in SRC_ANNOTATED.fieldNames()[1:]]
    alone = F.array(F.struct(F.col("_one.post_id").alias("key"), F.struct(*posts).alias("value")))
    each = lines.withColumn("_one", record).select(F.explode(F.when(F.col("_one.post_id").isNotNull(), alone).otherwise(keyed)).alias("_post"))
    return each.select(F.col("_post.key").alias("post_id"), "_post.value.*")


def read_splits(tables: list[DataFrame]) -> DataFrame:
    """All splits of one corpus as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


BUCKETS = 1 << 16


def first_rows(df: DataFrame, n: int, key: str = "row_id", ranked: int = 100_000) -> DataFrame:
    """The first ``n`` rows in the order of a unique integer key; rows without a key are never among them.

    A histogram over the key range finds the bucket in which the cut falls. While it holds more than ``ranked`` rows, as when a few
    keys lie far off, its own range is cut into buckets again: at most four times for 64-bit keys. Only the rows of
    the last bucket are sorted, the table itself is just filtered, and a few numbers reach the driver.
    """
    name = "`" + key.replace("`", "``") + "`"
    keys = df.select(F.col(name).cast("bigint").alias("k"))
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    if low is None or n <= 0:
        return df.filter(F.lit(False))
    cut, need = high, n
    while low < high:
        width = (high - low) // BUCKETS + 1
        bucket = F.expr(f"(CAST(k AS DECIMAL(20,0)) - CAST('{low}' AS DECIMAL(20,0))) div {width}")
        inside = keys.filter(F.col("k").between(low, high))
        counts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.withColumn("upto", F.sum("rows").over(Window.orderBy("b")))  # at most 65,536 rows
        edge = counts.filter((F.col("upto") >= need) & (F.col("upto") - F.col("rows") < need)).first()
        if edge is None:  # fewer rows than asked for
            break
        need -= edge["upto"] - edge["rows"]
        low, high = low + edge["b"] * width, min(high, low + (edge["b"] + 1) * width - 1)
        cut = high
        if need < edge["rows"] <= ranked:
            cut = inside.filter(F.col("k").between(low, high)).orderBy("k").limit(need).agg(F.max("k")).first()[0]
        if need == edge["rows"] or edge["rows"] <= ranked:
            break
    return df.filter(F.col(name) <= cut)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, one event per line."""
    return spark.read.schema(schema).json(path)


# The score names of the text report and their columns.
REPORT_SCORES = {
    "accuracy": r"Accuracy:\s*([\d\.]+)",
    "precision_macro": r"Precision \(Macro\):\s*([\d\.]+)",
    "recall_macro": r"Recall \(Macro\):\s*([\d\.]+)",
    "f1_macro": r"F1 \(Macro\):\s*([\d\.]+)",
    "roc_auc_macro": r"ROC-AUC \(Macro\):\s*([\d\.]+)",
}
CLASS_LINE = r"(Safe|Offensive|Hate Speech)\s+([\d\.]+)\s+([\d\.]+)\s+([\d\.]+)\s+(\d+)"


def _number(text: Column, pattern: str) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def parse_report(df: DataFrame, text: str = "value") -> DataFrame:
    """Overall scores of a text report; a missing score reads 0."""
    return df.select(*[_number(F.col(text), p).alias(name) for name, p in REPORT_SCORES.items()])


def parse_report_classes(df: DataFrame, text: str = "value") -> DataFrame:
    """Per-class precision, recall, F1 and support of a text report."""
    lines = df.select(F.explode(F.regexp_extract_all(text, F.lit(CLASS_LINE), F.lit(0))).alias("line"))
    part = lambda i: F.regexp_extract("line", CLASS_LINE, i)
    return lines.select(
        part(1).alias("name"), part(2).cast("double").alias("precision"), part(3).cast("double").alias("recall"),
        part(4).cast("double").alias("f1"), part(5).cast("bigint").alias("support"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)
