"""Thread store: written per-thread metadata JSON and summary documents.

Two layouts:
* ``table`` (default, scales): one parquet table partitioned by root
  (threads / archive) with columns folder, thread_key, metadata_json,
  summary_markdown.  No per-thread files or driver loops.
* ``folders``: the original on-disk layout ``<root>/<folder>/thread_metadata.json``
  (indented JSON) and ``thread_summary.md``; readable so existing output
  directories can be loaded, and writable through Spark's partitioned text
  writer (``folder=<name>`` directories).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

METADATA_SCHEMA = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("thread_name", T.StringType()),
    T.StructField("email_count", T.LongType()),
    T.StructField("participants", T.ArrayType(T.StringType())),
    T.StructField("participant_count", T.LongType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("duration_days", T.LongType()),
    T.StructField("total_attachments", T.LongType()),
    T.StructField("is_urgent", T.BooleanType()),
    T.StructField("has_delay", T.BooleanType()),
    T.StructField("is_transport", T.BooleanType()),
    T.StructField("is_customs", T.BooleanType()),
])
METADATA_FIELDS = [f.name for f in METADATA_SCHEMA.fields]
METADATA_FILE = "thread_metadata.json"
SUMMARY_FILE = "thread_summary.md"


def metadata_json() -> Column:
    """The metadata record as JSON text (dates as ISO strings, non-ASCII kept)."""
    return F.to_json(F.struct(*[F.col(c) for c in METADATA_FIELDS]))


def write_store(threads: DataFrame, path: str, with_summary: bool = True, mode: str = "overwrite") -> str:
    """S5 + S6 (table layout).  ``threads`` needs thread_key, folder, is_archived, the
    metadata fields and (optionally) summary_markdown."""
    cols = [F.when(F.col("is_archived"), F.lit(C.ARCHIVE_ROOT)).otherwise(F.lit(C.ACTIVE_ROOT)).alias("root"),
            "folder", "thread_key", metadata_json().alias("metadata_json")]
    if with_summary:
        cols.append("summary_markdown")
    threads.select(*cols).write.mode(mode).partitionBy("root").parquet(path)
    return path


def read_store(spark: SparkSession, path: str, root: str | None = C.ACTIVE_ROOT) -> DataFrame:
    """S3 + S4 + X36 (table layout): metadata parsed with a fixed schema; missing summary -> ''."""
    df = spark.read.parquet(path)
    if root is not None:
        df = df.filter(F.col("root") == root)  # partition pruning
    parsed = F.from_json("metadata_json", METADATA_SCHEMA)
    out = df.select("root", "folder", "thread_key", parsed.alias("m"),
                    F.coalesce(F.col("summary_markdown"), F.lit("")).alias("summary_text")
                    if "summary_markdown" in df.columns else F.lit("").alias("summary_text"))
    return out.select("root", "folder", "thread_key", "m.*", "summary_text").withColumns({
        "start_time": F.col("start_date").try_cast("timestamp_ntz"),
        "end_time": F.col("end_date").try_cast("timestamp_ntz")})


def write_folders(threads: DataFrame, path: str) -> str:
    """Folder layout through Spark's partitioned writers: metadata as JSON lines and the
    document as text, in ``<path>/<kind>/root=<r>/folder=<name>/thread_key=<key>/``: two threads whose
    names give one folder name stay apart.  One directory per thread is heavy on the driver's commit;
    the table layout (``write_store``) is the default, this one is for hand-over."""
    base = threads.select(
        F.when(F.col("is_archived"), F.lit(C.ARCHIVE_ROOT)).otherwise(F.lit(C.ACTIVE_ROOT)).alias("root"),
        "folder", "thread_key", *[F.col(c) for c in METADATA_FIELDS], "summary_markdown")
    base.select("root", "folder", "thread_key", *METADATA_FIELDS).write.mode("overwrite") \
        .partitionBy("root", "folder", "thread_key").json(f"{path}/metadata")
    base.select("root", "folder", "thread_key", F.col("summary_markdown").alias("value")).write.mode("overwrite") \
        .partitionBy("root", "folder", "thread_key").text(f"{path}/summary")
    return path


def read_reference_folders(spark: SparkSession, threads_dir: str) -> DataFrame:
    """S3 + S4 + J2 over the original layout: every sub-folder with a metadata file is a thread;
    folders without it are skipped; the summary document is joined left (absent -> '')."""
    # file paths are percent-encoded; a plus sign stands for itself there
    encoded = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    folder = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    # a name filter, unlike a path pattern, may match no file at all
    meta = (spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("pathGlobFilter", METADATA_FILE)
            .option("recursiveFileLookup", True).json(threads_dir).withColumn("folder", folder))
    docs = (spark.read.option("pathGlobFilter", SUMMARY_FILE).option("recursiveFileLookup", True)
            .text(threads_dir, wholetext=True).select(folder.alias("folder"), F.col("value").alias("summary_text")))
    return (meta.join(docs, "folder", "left")
            .withColumn("summary_text", F.coalesce(F.col("summary_text"), F.lit("")))
            .withColumn("end_time", F.col("end_date").try_cast("timestamp_ntz")))


def write_lines(lines: DataFrame, path: str, order: list[str], partition_by: list[str] | None = None,
                text_col: str = "line") -> str:
    """S8 / S10 / S7 sinks: write numbered lines as text in their order.  A global ``orderBy``
    range-partitions the lines, so a large report or a hot thread's timeline is written by
    many tasks as consecutive part files (read them back in file-name order); nothing is
    gathered into one writer.  ``partition_by`` (e.g. a folder column) gives one directory per
    thread."""
    df = lines.orderBy(*order)
    cols = (partition_by or []) + [F.col(text_col).alias("value")]
    w = df.select(*cols).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)
    return path


def write_sheet(sheet: DataFrame, path: str) -> str:
    """The 12-column sheet as CSV with a header row, newest start first."""
    sheet.write.mode("overwrite").option("header", True).csv(path)
    return path
