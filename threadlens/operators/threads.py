"""Thread grouping and thread-level aggregates.

All aggregates here are partial+final (map-side combine): counts, sums,
bool_or, min_by/max_by over the total order ``(received_time, message_id)``
and a distinct sender count.  No message list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X


def identify_threads(features: DataFrame, min_messages: int) -> DataFrame:
    """A1 + F4: conversations with at least ``min_messages`` messages."""
    return (features.groupBy("thread_key")
            .agg(F.count(F.lit(1)).alias("email_count"),
                 F.min_by("conversation_id", "ord").alias("conversation_id"))
            .filter(F.col("email_count") >= F.lit(min_messages)))


def thread_facts(messages: DataFrame, p: Params, min_messages: int | None = None) -> DataFrame:
    """A4, X1, X5 from the envelope alone: names, endpoints and ages of the kept threads.  No body."""
    as_of = X.ntz_literal(p.as_of)
    mm = p.min_messages if min_messages is None else min_messages
    ends = ("conversation_id", "message_id", "sender", "subject", "received_time")
    agg = messages.groupBy("thread_key").agg(
        F.count(F.lit(1)).alias("email_count"),
        F.min_by(F.struct(*ends), "ord").alias("_first"), F.max_by(F.struct(*ends), "ord").alias("_last"))
    days = X.whole_days(as_of, "_last.received_time")
    return agg.filter(F.col("email_count") >= F.lit(mm)).select(
        "thread_key", "email_count", F.col("_first.conversation_id").alias("conversation_id"),
        X.thread_name("_first.subject", "_first.received_time").alias("thread_name"),
        F.col("_first.received_time").alias("start_time"), F.col("_last.received_time").alias("end_time"),
        F.col("_first.message_id").alias("first_message_id"), F.col("_first.sender").alias("first_sender"),
        F.col("_first.subject").alias("first_subject"), F.col("_last.message_id").alias("last_message_id"),
        F.col("_last.sender").alias("last_sender"), days.alias("days_since_last"),
        (days > p.archive_days).alias("is_archived"))


def thread_metadata(features: DataFrame, p: Params, min_messages: int | None = None) -> DataFrame:
    """A2 (+A4, X1, X3, X5): one row per kept thread with metadata and endpoint facts."""
    agg = features.groupBy("thread_key").agg(*_meta_aggregates())
    mm = p.min_messages if min_messages is None else min_messages
    if mm > 1:
        agg = agg.filter(F.col("email_count") >= F.lit(mm))
    return agg.select(*_meta_columns(p))


@X.per_session
def _meta_aggregates() -> list:
    first = F.min_by(F.struct("conversation_id", "message_id", "sender", "subject", "received_time"), "ord")
    last = F.max_by(F.struct("message_id", "sender", "sender_address", "cc", "received_time",
                             "asks_score", "asks_insight", "waiting_on"), "ord")
    return [
        F.count(F.lit(1)).alias("email_count"),
        F.count_distinct("sender").alias("participant_count"),
        first.alias("_first"),
        last.alias("_last"),
        F.sum("attachment_count").cast("bigint").alias("total_attachments"),
        F.bool_or("is_urgent").alias("is_urgent"),
        F.bool_or("has_delay").alias("has_delay"),
        F.bool_or("is_transport").alias("is_transport"),
        F.bool_or("is_customs").alias("is_customs"),
    ]


@X.per_session
def _meta_columns(p: Params) -> list:
    as_of = X.ntz_literal(p.as_of)
    return [
        "thread_key",
        F.col("_first.conversation_id").alias("conversation_id"),
        X.thread_name("_first.subject", "_first.received_time").alias("thread_name"),
        "email_count",
        F.col("participant_count").cast("bigint").alias("participant_count"),
        F.col("_first.received_time").alias("start_time"),
        F.col("_last.received_time").alias("end_time"),
        X.whole_days("_last.received_time", "_first.received_time").alias("duration_days"),
        "total_attachments",
        "is_urgent", "has_delay", "is_transport", "is_customs",
        F.col("_first.message_id").alias("first_message_id"),
        F.col("_first.sender").alias("first_sender"),
        F.col("_first.subject").alias("first_subject"),
        F.col("_last.message_id").alias("last_message_id"),
        F.col("_last.sender").alias("last_sender"),
        F.col("_last.sender_address").alias("last_sender_address"),
        F.col("_last.cc").alias("last_cc"),
        F.col("_last.asks_score").alias("last_asks_score"),
        F.col("_last.asks_insight").alias("last_asks_insight"),
        F.col("_last.waiting_on").alias("last_waiting_on"),
        X.whole_days(as_of, "_last.received_time").alias("days_since_last"),
    ]


def participants(messages: DataFrame) -> DataFrame:
    """The sender list of each thread, sorted: only for outputs that show it (as long as a thread has
    distinct senders; the shared metadata carries the count alone)."""
    return messages.select("thread_key", "sender").distinct().groupBy("thread_key").agg(
        F.array_sort(F.collect_list("sender")).alias("participants"))


def sender_counts(features: DataFrame) -> DataFrame:
    """A3: messages per (thread, sender) with the sender's first appearance."""
    return features.groupBy("thread_key", "sender").agg(
        F.count(F.lit(1)).alias("n_emails"), F.min("ord").alias("first_ord"))


def flag_labels(df: DataFrame) -> F.Column:
    """URGENT / DELAY / TRANSPORT / CUSTOMS labels of the set flags, in order."""
    return X.labels([(F.col("is_urgent"), C.FLAG_NAMES[0]), (F.col("has_delay"), C.FLAG_NAMES[1]),
                     (F.col("is_transport"), C.FLAG_NAMES[2]), (F.col("is_customs"), C.FLAG_NAMES[3])])


def scan_only(meta: DataFrame) -> DataFrame:
    """Participant / flag overview without side effects; flags joined by ', ' or 'None'."""
    labels = flag_labels(meta)
    return meta.select("thread_key", "thread_name", "email_count", "participant_count",
                       F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(F.lit("None")).alias("flags"))
