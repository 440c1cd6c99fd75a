"""Per-message features, computed map-side before any shuffle.

Every use of a message body is reduced here to small bounded values (flags,
at most 5 action lines, 10 key-point sentences, 1 issue sentence, previews and
snippets of fixed width).  Bodies never cross an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X
from . import phrases as PH

THREAD_KEY_NULL = "\u0000"  # stands in for a NULL conversation id inside thread_key


def exclude_folders(messages: DataFrame, excluded) -> DataFrame:
    """drop messages in an excluded folder; exact, case-sensitive; NULL folder is kept."""
    excluded = tuple(excluded or ())
    if not excluded:
        return messages
    return messages.filter(F.coalesce(~F.col("folder").isin(*excluded), F.lit(True)))


def mail_only(messages: DataFrame) -> DataFrame:
    """mail items only."""
    return messages.filter(F.col("item_class") == F.lit(C.MAIL_ITEM_CLASS))


def with_thread_key(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Thread key = conversation id (new-mail mode) or folder (existing-thread mode).
    A NULL id forms its own group."""
    return messages.withColumn("thread_key", F.coalesce(F.col(key), F.lit(THREAD_KEY_NULL)))


def envelope(messages: DataFrame) -> DataFrame:
    """The columns of a message (with ``thread_key``) that need no body, with the same defaults as
    the features; lazy, so body-free outputs never read a body."""
    return messages.select(
        "thread_key", "conversation_id", "message_id", "received_time", "folder", "item_class",
        F.coalesce(F.col("sender"), F.lit(C.UNKNOWN_SENDER)).alias("sender"), "sender_address", "cc",
        F.coalesce(F.col("subject"), F.lit("")).alias("subject"),
        F.coalesce(F.col("attachment_count"), F.lit(0)).cast("int").alias("attachment_count"),
        F.struct("received_time", "message_id").alias("ord"))


@X.per_session
def _base_columns() -> list:
    body = F.coalesce(F.col("body"), F.lit(""))
    subj = F.coalesce(F.col("subject"), F.lit(""))
    return [
        "thread_key", "conversation_id", "message_id", "received_time", "folder", "item_class",
        F.coalesce(F.col("sender"), F.lit(C.UNKNOWN_SENDER)).alias("sender"),
        "sender_address", "cc",
        subj.alias("subject"),
        F.coalesce(F.col("attachment_count"), F.lit(0)).cast("int").alias("attachment_count"),
        body.alias("_body"), F.lower(body).alias("_lb"), F.lower(subj).alias("_ls"),
        # the issue keyword is a column of its own so the sentence lambda reads it, not recomputes it
        X.first_listed(F.lower(body), C.issue_keywords()).alias("_issue_kw"),
    ]


@X.per_session
def _feature_columns(p: Params) -> list:
    lb, ls, b = F.col("_lb"), F.col("_ls"), F.col("_body")

    def flag(words):
        return X.contains_any(lb, words) | X.contains_any(ls, words)

    waiting = F.coalesce(*[
        F.when(lb.contains(ph), F.concat(F.lit(C.WAITING_PREFIX),
                                         F.substring(lb, F.instr(lb, F.lit(ph)), C.WAITING_CHARS),
                                         F.lit(C.WAITING_SUFFIX)))
        for ph in C.WAITING_PHRASES])
    # the body is split into sentences once, and only where some word occurs; the one-element array
    # binds the sentences for the searches, each of which runs only if its word occurs
    def first_with(sents, w):
        return F.get(F.filter(sents, lambda x: x["low"].contains(w) & (F.length(x["text"]) < C.KEY_POINT_MAX_LEN)), F.lit(0))

    def key_sentences(sents):
        return F.filter(F.array(*[
            F.struct(F.lit(i).alias("word_pos"), F.when(lb.contains(w), first_with(sents, w)["text"]).alias("text"))
            for i, w in enumerate(C.IMPORTANT_WORDS)]), lambda x: x["text"].isNotNull())
    kp = F.when(X.contains_any(lb, C.IMPORTANT_WORDS), F.get(F.transform(F.array(X.sentences(b)), key_sentences), F.lit(0))) \
        .otherwise(F.array().cast("array<struct<word_pos:int,text:string>>"))
    issue_kw = F.col("_issue_kw")
    issue_sent = F.when(issue_kw.isNotNull(), X.first_sentence_with(b, issue_kw, C.ISSUE_MAX_LEN))
    return [
        "thread_key", "conversation_id", "message_id", "received_time", "folder", "item_class",
        "sender", "sender_address", "cc", "subject", "attachment_count",
        F.struct("received_time", "message_id").alias("ord"),
        flag(p.keywords_urgent).alias("is_urgent"),
        flag(p.keywords_delay).alias("has_delay"),
        flag(p.keywords_transport).alias("is_transport"),
        flag(p.keywords_customs).alias("is_customs"),
        X.contains_any(lb, C.SCORE_RESPONSE_PHRASES).alias("asks_score"),
        X.contains_any(lb, C.INSIGHT_RESPONSE_PHRASES).alias("asks_insight"),
        waiting.alias("waiting_on"),
        X.action_lines(b).alias("action_lines"),
        kp.alias("key_sentences"),
        F.concat(F.lit("["), X.day_text("received_time"), F.lit("] "), issue_sent).alias("issue"),
        X.preview(b).alias("preview"),
        X.snippet(b).alias("snippet"),
        # only where some keyword holds a space
        *(PH.phrase_columns(p, F.col("subject"), b) if PH.phrases(p) else []),
    ]


def featurize(messages: DataFrame, p: Params) -> DataFrame:
    """Narrow projection of messages (with ``thread_key``) to bounded features."""
    return messages.select(*_base_columns()).select(*_feature_columns(p))


@X.per_session
def _timeline_columns() -> list:
    body = F.coalesce(F.col("body"), F.lit(""))
    return [
        "thread_key", "message_id", "received_time",
        F.coalesce(F.col("sender"), F.lit(C.UNKNOWN_SENDER)).alias("sender"),
        F.coalesce(F.col("subject"), F.lit("")).alias("subject"),
        F.left(X.clean_body(body), F.lit(C.CLEAN_SNIPPET_CHARS)).alias("clean_snippet"),
        F.left(body, F.lit(C.HOVER_CHARS)).alias("hover_body"),
    ]


def timeline_features(messages: DataFrame) -> DataFrame:
    """Per-message columns only the timeline outputs need (cleaned and hover snippets);
    kept out of the shared feature table so summaries never pay for them."""
    return messages.select(*_timeline_columns())


KEYWORD_CHUNK = 500


def keyword_hits(messages: DataFrame, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """(message_id, list_name, keyword) for every keyword contained in the lower-cased
    subject + ' ' + body.  One array filter per KEYWORD_CHUNK keywords, whatever their number:
    no join, nothing broadcast."""
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col("subject"), F.lit("")), F.coalesce(F.col("body"), F.lit(""))))
    pairs = [(name, kw) for name, kws in lists.items() for kw in kws]

    def hits(some):
        arr = F.array(*[F.struct(F.lit(n).alias("list_name"), F.lit(k).alias("keyword")) for n, k in some])
        return F.filter(arr, lambda x: F.col("_t").contains(x["keyword"]))
    chunks = [hits(pairs[i:i + KEYWORD_CHUNK]) for i in range(0, len(pairs), KEYWORD_CHUNK)]
    if not chunks:
        return messages.select("message_id", F.lit("").alias("list_name"), F.lit("").alias("keyword")).limit(0)
    found = chunks[0] if len(chunks) == 1 else F.concat(*chunks)
    return (messages.select("message_id", text.alias("_t")).select("message_id", F.explode(found).alias("h"))
            .select("message_id", "h.list_name", "h.keyword"))
