"""A whole run with its statistics (A7): every output is written, and counted by the pass that writes it.

The counts are observed on the rows as they go to the writer, in the last stage of each write, where a
task counts once whatever is lost and run again.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lifecycle as L
from ..sources import versions as V
from .job import ThreadJob


@dataclass(frozen=True)
class RunStats:
    threads_found: int
    threads_processed: int
    emails_moved: int
    summaries_created: int
    timelines_created: int
    errors: int
    reviewed: int
    drafts: int
    skipped: int


def write_observed(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **counts: Column) -> dict[str, int]:
    """Write ``df`` as Parquet; the named aggregates of the rows written."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return {n: v or 0 for n, v in seen.get.items()}


def run(job: ThreadJob, path: str) -> RunStats:
    """Write the outputs of a job below ``path``: the thread table, the versioned store of summaries, routes,
    timelines, rejects, the attention queue and the drafts."""
    every = F.count(F.lit(1))
    threads = write_observed(job.scored, f"{path}/threads", threads=every)
    routes = write_observed(job.routes, f"{path}/routes", messages=every)
    summaries = Observation()
    rows = V.thread_rows(job.with_participants(job.markdown).withColumn("folder", X.slug("thread_name", "conversation_id")))
    V.create_store(rows, f"{path}/store", observe=(summaries, F.count("summary_markdown").alias("summaries"), every.alias("rows")))
    timelines = write_observed(job.timeline, f"{path}/timelines", threads=F.count_if(F.col("line_no") == 1))
    rejects = write_observed(job.rejects, f"{path}/rejects", messages=every)
    queue = write_observed(job.attention, f"{path}/attention", threads=every)
    replies = L.reply_queue(job.attention, job.summary)
    drafts = write_observed(replies, f"{path}/drafts", drafts=F.count("body"))
    return RunStats(threads["threads"], summaries.get["rows"], routes["messages"], summaries.get["summaries"],
                    timelines["threads"], rejects["messages"], queue["threads"], drafts["drafts"],
                    queue["threads"] - drafts["drafts"])


def stats_frame(spark, stats: RunStats) -> DataFrame:
    """The statistics as a row."""
    values = asdict(stats)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} bigint" for n in values))
