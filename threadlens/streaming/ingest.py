"""Incremental ingest of arriving messages with Structured Streaming.

The analysed tool is batch-only; nothing here adds an operator.  The map-side
part of the pipeline (folder exclusion, thread key, bounded features) is
stateless, so it runs unchanged on a stream: new message files are featurised
as they land and appended to a feature table.  Thread-level outputs are then
computed in batch from that table (``ThreadJob.from_features``), so bodies are
read once, when they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Params
from ..operators import features as FE
from ..sources.messages import MESSAGE_SCHEMA, split_rejects


def message_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of message files with the canonical schema."""
    r = spark.readStream.schema(MESSAGE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def feature_stream(messages: DataFrame, p: Params, key: str = "conversation_id") -> DataFrame:
    """Stateless F1 + thread key + bounded features on a streaming (or batch) frame."""
    valid, _ = split_rejects(messages)
    return FE.featurize(FE.with_thread_key(FE.exclude_folders(valid, p.excluded_folders), key), p)


def reject_stream(messages: DataFrame) -> DataFrame:
    """The rows that ``feature_stream`` leaves out (no time, no id, malformed), with the reason; append
    them to a table of their own (``append_features`` writes any frame)."""
    return split_rejects(messages)[1]


def append_features(features: DataFrame, path: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Append featurised rows to a parquet table; the checkpoint (in the shared folder)
    gives exactly-once file output across restarts and lost executors."""
    w = (features.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
