"""Versioned thread store (S6, J8): threads change root by a new version of their buckets.

Layout: ``data/version=<v>/root=<r>/bucket=<b>/`` holds the rows (folder, thread_key, metadata_json,
summary_markdown) and ``manifest/version=<v>/`` one small file that says, for every root and bucket, which
version's data counts.  A change writes the whole buckets it touches under a new version and then the
manifest, in one file and so in one rename; until then readers see the version before, and a
change that was cut off (a lost driver, a lost executor) is overwritten when it is run again.  Readers take
the latest manifest and read only the directories it names.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..operators import lifecycle as L
from ..session import written
from .stored import METADATA_SCHEMA, metadata_json

BUCKETS = 64
ROW_SCHEMA = "folder string, thread_key string, metadata_json string, summary_markdown string, root string, bucket int, version int"
MANIFEST_SCHEMA = "root string, bucket int, data_version int, version int"


def bucket_of(folder: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(buckets)).cast("int")


def _root(archived: Column) -> Column:
    return F.when(archived, F.lit(C.ARCHIVE_ROOT)).otherwise(F.lit(C.ACTIVE_ROOT))


def thread_rows(threads: DataFrame) -> DataFrame:
    """Store rows of summarised threads: ``is_archived``, ``folder``, the metadata fields and the document."""
    return threads.select("folder", "thread_key", metadata_json().alias("metadata_json"), "summary_markdown",
                          _root(F.col("is_archived")).alias("root"))


def _write(rows: DataFrame, path: str, version: int, buckets: int, observe: tuple = ()) -> DataFrame:
    """The rows as the data of a version; returns the manifest entries of what was written.  ``observe``
    (an Observation and aggregates) counts the rows as they are written."""
    target = f"{path}/data/version={version}"
    dealt = rows.withColumn("bucket", bucket_of(F.col("folder"), buckets)).repartition("root", "bucket")
    ((dealt.observe(*observe) if observe else dealt)
     .write.mode("overwrite").partitionBy("root", "bucket").parquet(target))
    back = rows.sparkSession.read.schema("folder string, root string, bucket int").parquet(target)
    return back.select("root", "bucket").distinct().withColumn("data_version", F.lit(version))


def _commit(entries: DataFrame, path: str, version: int) -> None:
    """At most one row per root and bucket: one file, visible by one rename."""
    entries.select("root", "bucket", "data_version").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")


def create_store(rows: DataFrame, path: str, buckets: int = BUCKETS, observe: tuple = ()) -> str:
    """Version 0 of a store from ``thread_rows`` (or rows of that shape)."""
    _commit(_write(rows, path, 0, buckets, observe), path, 0)
    return path


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, DataFrame]:
    """The latest (or the given) committed version and its entries."""
    every = spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    v = every.agg(F.max("version")).first()[0] if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed version below {path}")
    return v, every.where(F.col("version") == v).select("root", "bucket", F.col("data_version").alias("version"))


def read_rows(spark: SparkSession, path: str, root: str | None = None, version: int | None = None) -> DataFrame:
    """The rows that count now: data directories joined with the manifest (roots times buckets rows), by
    which Spark prunes the directories it reads."""
    entries = manifest(spark, path, version)[1]
    rows = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/data")
    if root is not None:
        rows = rows.where(F.col("root") == root)
    return rows.join(F.broadcast(entries), ["root", "bucket", "version"], "left_semi").drop("version")


def archive_outcomes(spark: SparkSession, path: str, p: Params) -> DataFrame:
    """J8's decision over a store: an outcome per folder of the active root."""
    active = read_rows(spark, path, C.ACTIVE_ROOT)
    parsed = active.where("metadata_json IS NOT NULL").select("folder", F.from_json("metadata_json", METADATA_SCHEMA).alias("m")) \
        .groupBy("folder").agg(F.max("m.end_date").alias("end_date"))  # a folder counts once, by its latest thread
    return L.archive_transition(active.select("folder"), parsed, read_rows(spark, path, C.ARCHIVE_ROOT).select("folder"), p)


def apply_archive(spark: SparkSession, path: str, p: Params, buckets: int = BUCKETS) -> DataFrame:
    """J8 applied: folders whose outcome is 'moved' lie in the archive root afterwards.  Returns the
    outcomes.  Running it again changes nothing more, whether or not the run before came to its end."""
    outcomes = written(archive_outcomes(spark, path, p), "archive-outcomes")
    moved = outcomes.where("outcome = 'moved'").select("folder", bucket_of(F.col("folder"), buckets).alias("bucket"))
    touched = [r[0] for r in moved.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return outcomes
    version, entries = manifest(spark, path)
    rows = read_rows(spark, path).where(F.col("bucket").isin(*touched)).drop("bucket")
    changed = rows.join(moved.select("folder", F.lit(True).alias("_moved")), "folder", "left").withColumn(
        "root", _root(F.coalesce("_moved", F.lit(False)) | (F.col("root") == C.ARCHIVE_ROOT))).drop("_moved")
    new = _write(changed, path, version + 1, buckets)
    kept = entries.where(~F.col("bucket").isin(*touched)).select("root", "bucket", F.col("version").alias("data_version"))
    _commit(kept.unionByName(new), path, version + 1)
    return outcomes
