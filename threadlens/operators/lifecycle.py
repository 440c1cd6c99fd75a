"""Run lifecycle as tables.

The mailbox side effects of the original (moving mail, creating folders,
drafts and follow-up flags) become routing / draft / mark tables that a
writer or client can apply; every decision is a join or a column rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X
from . import render as R
from .features import mail_only

L = F.lit


def routing(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """J5 (+X2, F6): every message of a kept thread -> target root and folder slug."""
    t = scored.select("thread_key", "is_archived",
                      X.slug("thread_name", "conversation_id").alias("target_folder"))
    return messages.select("thread_key", "message_id").join(t, "thread_key").select(
        "message_id", "thread_key",
        F.when(F.col("is_archived"), L(C.ARCHIVE_ROOT)).otherwise(L(C.ACTIVE_ROOT)).alias("target_root"),
        "target_folder")


def stored_messages(messages: DataFrame, scored: DataFrame, root: str = C.ACTIVE_ROOT) -> DataFrame:
    """Messages (``thread_key`` attached; features or envelope, no bodies) of the threads stored under
    ``root``, as they sit after routing: ``folder`` = thread folder.  One join on the thread key against
    the one-row-per-thread table."""
    archived = F.col("is_archived") if root == C.ARCHIVE_ROOT else ~F.col("is_archived")
    t = scored.filter(archived).select("thread_key", X.slug("thread_name", "conversation_id").alias("_f"))
    return messages.join(t, "thread_key").withColumn("folder", F.col("_f")).drop("_f")


def existing_scan(stored: DataFrame) -> DataFrame:
    """S2 + F2 + F3: each folder is a thread; mail items only; conversation id defaults to the folder
    name (sender / body defaults are applied by featurize).  Features do not depend on the thread, so a
    stored feature table is only given its new key."""
    m = mail_only(stored)
    return m.withColumn("conversation_id", F.coalesce(F.col("conversation_id"), F.col("folder"))) \
        .withColumn("thread_key", F.col("folder"))


def reply_queue(attention: DataFrame, summary: DataFrame) -> DataFrame:
    """J6 + T4 + X21: draft per attention thread: To = latest sender address, CC when non-empty,
    subject 'Re: name', body = the thread's reply text, else the basic reply."""
    s = summary.select("thread_key", "thread_name", "last_sender_address", "last_cc", "response_needed",
                       "reply_template", "is_urgent", "has_delay")
    return attention.select("thread_key").join(s, "thread_key").select(
        "thread_key",
        F.concat(L("Re: "), F.col("thread_name")).alias("subject"),
        F.col("last_sender_address").alias("to"),
        F.when(F.length(F.coalesce("last_cc", L(""))) > 0, F.col("last_cc")).alias("cc"),
        F.when(F.col("response_needed") & (F.col("reply_template") != L(C.NO_REPLY)), F.col("reply_template"))
        .otherwise(R.basic_reply()).alias("body"))


def followup_marks(messages: DataFrame, attention: DataFrame) -> DataFrame:
    """Every mail item of the selected threads gets the follow-up request and status."""
    return mail_only(messages).select("thread_key", "message_id").join(
        attention.select("thread_key"), "thread_key", "left_semi").select(
        "thread_key", "message_id", L(C.FOLLOWUP_REQUEST).alias("flag_request"),
        L(C.FOLLOWUP_STATUS).alias("flag_status"))


def archive_transition(folders: DataFrame, stored_meta: DataFrame, archive_folders: DataFrame,
                       p: Params) -> DataFrame:
    """J8 + F10: for each folder of the active root: 'no metadata', 'no end date',
    'exists' (old, already in archive), 'moved' (old), or 'kept'."""
    as_of = X.ntz_literal(p.as_of)
    m = stored_meta.select("folder", F.lit(True).alias("_has_meta"),
                           F.col("end_date").try_cast("timestamp_ntz").alias("_end"))
    a = archive_folders.select("folder", F.lit(True).alias("_in_archive")).distinct()
    d = folders.select("folder").distinct().join(m, "folder", "left").join(a, "folder", "left")
    days = X.whole_days(as_of, "_end")
    outcome = (F.when(F.col("_has_meta").isNull(), L("no metadata"))
               .when(F.col("_end").isNull(), L("no end date"))
               .when((days > p.archive_days) & F.col("_in_archive").isNotNull(), L("exists"))
               .when(days > p.archive_days, L("moved"))
               .otherwise(L("kept")))
    return d.select("folder", days.alias("days_since_last"), outcome.alias("outcome"))


def mode_both(new_meta: DataFrame, existing_meta: DataFrame) -> DataFrame:
    """New-mail rows then existing-thread rows; the later run wins per conversation id."""
    from pyspark.sql import Window
    u = (new_meta.select("conversation_id", "thread_name", "email_count", L("new").alias("mode"), L(1).alias("_run"))
         .unionByName(existing_meta.select("conversation_id", "thread_name", "email_count",
                                           L("existing").alias("mode"), L(2).alias("_run"))))
    w = Window.partitionBy("conversation_id").orderBy(F.col("_run").desc(), F.col("thread_name"))
    return u.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_run")


NAME_PREFIX_LEN = len("yyyy-MM-dd - ")
NAME_PREFIX_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} - $"


def folder_name_candidates(folders: DataFrame) -> DataFrame:
    """Every substring of each folder name that starts where a thread-name date prefix
    ('yyyy-MM-dd - ') starts.  A folder name is at most 59 chars, so a folder yields a bounded
    handful of rows; any name of the form X1 produces that occurs in a folder name is one of them."""
    n = F.length("folder")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - NAME_PREFIX_LEN + 1, F.lit(1))),
                      lambda p: F.substring(F.col("folder"), p, F.lit(NAME_PREFIX_LEN)).rlike(NAME_PREFIX_RE))
    return (folders.select("folder", F.explode(starts).alias("p"))
            .select("folder", F.explode(F.sequence(F.col("p") + NAME_PREFIX_LEN - 1, n)).alias("e"), "p")
            .select("folder", F.substring(F.col("folder"), F.col("p"), F.col("e") - F.col("p") + 1).alias("cand"))
            .distinct())


def find_folder_by_name(names: DataFrame, folders: DataFrame) -> DataFrame:
    """J4 as the original looks it up: the first folder (by name) whose name contains the thread
    name.  Exact for thread names (they all begin with the date prefix): candidates are reduced to
    their first folder before the join, so each name meets at most one row, however common it is."""
    first = folder_name_candidates(folders).groupBy(F.col("cand").alias("thread_name")) \
        .agg(F.min("folder").alias("found_folder"))
    return names.select("thread_key", "thread_name").join(first, "thread_name").select("thread_key", "found_folder")


def find_thread(scored: DataFrame) -> DataFrame:
    """The thread's own folder, and ``found_folder``: the first folder of the active root whose
    name contains the thread name (the original's lookup, which misses names that the folder slug cut
    or cleaned).  All of it from the one-row-per-thread table."""
    t = scored.select("thread_key", "thread_name",
                      F.when(F.col("is_archived"), L(C.ARCHIVE_ROOT)).otherwise(L(C.ACTIVE_ROOT)).alias("target_root"),
                      X.slug("thread_name", "conversation_id").alias("target_folder"))
    active = t.filter(F.col("target_root") == C.ACTIVE_ROOT).select(F.col("target_folder").alias("folder")).distinct()
    return t.join(find_folder_by_name(t, active), "thread_key", "left").select(
        "thread_key", "thread_name", "target_root", "target_folder",
        F.col("target_folder").contains(F.col("thread_name")).alias("name_in_folder"), "found_folder")


def fallback_summary(summary: DataFrame) -> DataFrame:
    """The minimal summary of threads that cannot be analysed in full.  Score, level, next action and
    reply are those that can still be computed; the literals stand in where they cannot."""
    return summary.select(
        "thread_key", L(C.METHOD_FALLBACK).alias("method"), "thread_name",
        F.concat(L("Thread with "), F.col("email_count").cast("string"), L(" emails")).alias("executive_summary"),
        F.concat(L("Thread started "), F.col("start_date")).alias("key_events"),
        F.array_join("participants", " | ").alias("stakeholders"),
        L(C.FALLBACK_STATUS).alias("current_status"),
        F.coalesce("next_action", L(C.FALLBACK_NEXT_ACTION)).alias("next_action"),
        F.coalesce(F.col("priority_score").cast("bigint"), L(0)).alias("priority_score"),
        F.coalesce("priority_level", L(C.LEVEL_DEFAULT)).alias("priority_level"),
        F.coalesce("reply_template", L(C.NO_REPLY)).alias("reply_template"))
