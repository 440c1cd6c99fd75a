"""Capped per-thread lists.

Each list is a top-k per thread.  ``row_number() <= k`` plans as a partial
``WindowGroupLimit`` before the shuffle and a final one after it, so every map
task sends at most k rows per thread -- a thread of any size costs O(k) shuffle.
Duplicate texts are removed with a partial aggregate (A8) before ranking.
Outputs are long tables ``(thread_key, <rank>, <text>)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= F.lit(k))


def last_messages(features: DataFrame, n: int, cols: Sequence[str]) -> DataFrame:
    """The last n messages of each thread, numbered 1..n in ascending time order."""
    last = top_k(features.select("thread_key", "ord", *cols), ["thread_key"], [F.col("ord").desc()], n, "_from_end")
    w = Window.partitionBy("thread_key").orderBy("ord")
    return last.withColumn("pos", F.row_number().over(w)).withColumnRenamed("_from_end", "from_end")


def thread_events(features: DataFrame, meta: DataFrame, cap: int = C.CAP_EVENTS) -> DataFrame:
    """X13 (+F12): first message, last message, then middle messages with an urgent
    (else delay) keyword in subject/body, in that construction order, capped."""
    hits = top_k(features.filter(F.col("is_urgent") | F.col("has_delay"))
                 .select("thread_key", "ord", "message_id", "received_time", "sender", "is_urgent"),
                 ["thread_key"], [F.col("ord")], cap, "_hit")
    ends = meta.select("thread_key", "first_message_id", "last_message_id")
    middle = (hits.join(ends, "thread_key")
              .filter((F.col("message_id") != F.col("first_message_id")) &
                      (F.col("message_id") != F.col("last_message_id")))
              .select("thread_key",
                      (F.lit(1) + F.row_number().over(Window.partitionBy("thread_key").orderBy("ord"))).alias("pos"),
                      F.concat(F.lit("["), X.minute_text("received_time"), F.lit("] "),
                               F.when(F.col("is_urgent"), F.lit("URGENT: Update from "))
                               .otherwise(F.lit("Delay reported by ")), F.col("sender")).alias("event")))
    first = meta.select("thread_key", F.lit(0).alias("pos"),
                        F.concat(F.lit("["), X.minute_text("start_time"), F.lit("] Thread started by "),
                                 F.col("first_sender"), F.lit(": "), F.col("first_subject")).alias("event"))
    last = meta.filter(F.col("email_count") > 1).select(
        "thread_key", F.lit(1).alias("pos"),
        F.concat(F.lit("["), X.minute_text("end_time"), F.lit("] Latest update from "),
                 F.col("last_sender")).alias("event"))
    allev = first.unionByName(last).unionByName(middle)
    return top_k(allev, ["thread_key"], [F.col("pos")], cap, "event_rank").select("thread_key", "event_rank", "event")


def stakeholders(sender_counts: DataFrame, cap: int = C.CAP_STAKEHOLDERS) -> DataFrame:
    """X14: 'sender (n emails)' by count desc, ties by first appearance, capped."""
    top = top_k(sender_counts, ["thread_key"], [F.col("n_emails").desc(), F.col("first_ord")], cap, "stakeholder_rank")
    return top.select("thread_key", "stakeholder_rank",
                      F.concat(F.col("sender"), F.lit(" ("), F.col("n_emails").cast("string"),
                               F.lit(" emails)")).alias("stakeholder"))


LAST_COLUMNS = ["received_time", "sender", "subject", "preview", "action_lines"]


def action_items(features: DataFrame, cap: int = C.CAP_ACTIONS, n_messages: int = C.ACTION_MESSAGES,
                 last: DataFrame | None = None) -> DataFrame:
    """request/question lines of the last 3 messages, in message then line order, capped.
    ``last`` may be a wider last-messages table (e.g. the flow's last 5) to share its shuffle."""
    if last is None:
        last = last_messages(features, n_messages, ["action_lines"])
    last = last.filter(F.col("from_end") <= n_messages)
    lines = last.select("thread_key", "pos", F.posexplode("action_lines").alias("line_pos", "action_item"))
    top = top_k(lines, ["thread_key"], [F.col("pos"), F.col("line_pos")], cap, "item_rank")
    return top.select("thread_key", "item_rank", "action_item")


def _first_appearance(items: DataFrame, cap: int, rank: str, text: str) -> DataFrame:
    """A8 + W3: distinct texts per thread ranked by first appearance, capped."""
    dedup = items.groupBy("thread_key", "text").agg(F.min("pos").alias("first_pos"))
    return top_k(dedup, ["thread_key"], [F.col("first_pos")], cap, rank).select(
        "thread_key", rank, F.col("text").alias(text))


def key_points(features: DataFrame, cap: int = C.CAP_KEY_POINTS) -> DataFrame:
    """X16: '[sender] sentence' per message and important word, distinct, first 5 by appearance."""
    # the outer explode: for the plain one Spark adds a filter on the array, for which it would be made twice
    exploded = features.select("thread_key", "ord", "sender", F.explode_outer("key_sentences").alias("ks"))
    kp = exploded.where(F.col("ks").isNotNull()).select(
        "thread_key",
        F.concat(F.lit("["), F.col("sender"), F.lit("] "), F.col("ks.text")).alias("text"),
        F.struct(F.col("ord"), F.col("ks.word_pos").alias("word_pos")).alias("pos"))
    return _first_appearance(kp, cap, "point_rank", "key_point")


def thread_issues(features: DataFrame, cap: int = C.CAP_ISSUES) -> DataFrame:
    """Per message the sentence of the first issue keyword found; distinct, first 5."""
    # the filter stays above the explode: below it the issue would be made twice
    it = features.select("thread_key", F.explode_outer(F.array("issue")).alias("text"), F.col("ord").alias("pos")) \
        .where(F.col("text").isNotNull())
    return _first_appearance(it, cap, "issue_rank", "issue")


def conversation_flow(features: DataFrame, n: int = C.FLOW_MESSAGES, last: DataFrame | None = None) -> DataFrame:
    """Last 5 messages as (date, sender, subject, preview), ascending."""
    if last is None:
        last = last_messages(features, n, ["received_time", "sender", "subject", "preview"])
    return last.select("thread_key", F.col("pos").alias("flow_pos"), X.minute_text("received_time").alias("date"),
                       "sender", "subject", "preview")


def _model_messages_needed() -> int:
    # every chunk 'Email i [yyyy-MM-dd HH:mm] From s: subj. snip. ' has >= 38 chars,
    # so the first ceil(1001/38) messages always fill the cut text
    shortest = len("Email 1 [2024-01-01 00:00] From : . . ")
    return -(-(C.MODEL_INPUT_CHARS + 1) // shortest)


def model_input(features: DataFrame) -> DataFrame:
    """X26: 'Email i [date] From s: subj. snippet. ' over the leading messages, cut at 1000 + '...'.
    Only the leading messages that can reach the cut are ranked and collected."""
    k = _model_messages_needed()
    first = top_k(features.select("thread_key", "ord", "received_time", "sender", "subject", "snippet"),
                  ["thread_key"], [F.col("ord")], k, "i")
    chunk = F.concat(F.lit("Email "), F.col("i").cast("string"), F.lit(" ["), X.minute_text("received_time"),
                     F.lit("] From "), F.col("sender"), F.lit(": "), F.col("subject"), F.lit(". "),
                     F.col("snippet"), F.lit(". "))
    text = first.groupBy("thread_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("i"), chunk.alias("c")))),
                                 lambda x: x["c"]), "").alias("_t"))
    return text.select("thread_key", F.when(F.length("_t") > C.MODEL_INPUT_CHARS,
                                            F.concat(F.left("_t", F.lit(C.MODEL_INPUT_CHARS)), F.lit("...")))
                       .otherwise(F.col("_t")).alias("model_input"))


# the lists of a summary, tagged rows of one table: (cap, order of the fields o1..o4 is ascending)
LIST_CAPS = {"sender": C.CAP_STAKEHOLDERS, "point": C.CAP_KEY_POINTS, "issue": C.CAP_ISSUES,
             "hit": C.CAP_EVENTS, "last": C.FLOW_MESSAGES}


def _candidates(features: DataFrame) -> DataFrame:
    """Tagged candidates of every capped list: (thread_key, tag, o1..o4, text, n, message).  Distinct texts
    (senders, key points, issues) are counted with their first place, in one aggregate; middle events and
    last messages carry the message's columns."""
    micros, mid = X.ntz_micros("received_time"), F.col("message_id")

    def text_row(tag, text, word_pos):
        return F.struct(F.lit(tag).alias("tag"), text.alias("text"), word_pos.alias("word_pos"))

    points = F.transform("key_sentences", lambda k: text_row(
        "point", F.concat(F.lit("["), F.col("sender"), F.lit("] "), k["text"]), k["word_pos"]))
    texts = F.concat(F.array(text_row("sender", F.col("sender"), F.lit(0))), points,
                     F.when(F.col("issue").isNotNull(), F.array(text_row("issue", F.col("issue"), F.lit(0)))).otherwise(F.array()))
    first = F.min(F.struct("o2", "o3", "word_pos"))
    counted = (features.select("thread_key", micros.alias("o2"), mid.alias("o3"), F.explode(texts).alias("x"))
               .select("thread_key", "o2", "o3", "x.*").groupBy("thread_key", "tag", "text")
               .agg(F.count(F.lit(1)).alias("n"), first.alias("f")))
    # senders by count, then all by first appearance
    counted = counted.select("thread_key", "tag", F.when(F.col("tag") == "sender", -F.col("n")).otherwise(0).alias("o1"),
                             "f.o2", "f.o3", F.col("f.word_pos").alias("o4"), "text", "n")

    def message_row(tag, o2, o3, *cols):
        message = F.struct(*[F.col(c) if c in cols else F.lit(None).cast(features.schema[c].dataType).alias(c)
                             for c in ("message_id", "received_time", "sender", "is_urgent", "subject", "preview", "action_lines")])
        return F.struct(F.lit(tag).alias("tag"), o2.alias("o2"), o3.alias("o3"), message.alias("message"))

    hit = message_row("hit", micros, mid, "message_id", "received_time", "sender", "is_urgent")
    last = message_row("last", F.bitwise_not(micros), F.bitwise_not(mid), *LAST_COLUMNS)
    messages = (features.select("thread_key", F.explode(F.when(F.col("is_urgent") | F.col("has_delay"), F.array(last, hit))
                                                        .otherwise(F.array(last))).alias("x"))
                .select("thread_key", "x.tag", F.lit(0).cast("long").alias("o1"), "x.o2", "x.o3", F.lit(0).alias("o4"), "x.message"))
    return counted.unionByName(messages, allowMissingColumns=True)


def list_arrays(features: DataFrame) -> DataFrame:
    """All capped lists of a thread as raw arrays, one row per thread: one aggregate of the distinct texts, one
    window over (thread, list) whose limits run before its exchange, and one aggregate per thread of the few
    rows left."""
    w = Window.partitionBy("thread_key", "tag").orderBy("o1", "o2", "o3", "o4")
    # one limit for the window (the largest cap), so it is cut before the exchange; each list's own cap after
    ranked = (_candidates(features).withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= max(LIST_CAPS.values())))

    def listed(tag, *fields):
        item = F.when((F.col("tag") == tag) & (F.col("rank") <= LIST_CAPS[tag]), F.struct("rank", *fields))
        return F.array_sort(F.collect_list(item)).alias(f"_{tag}")

    return ranked.groupBy("thread_key").agg(
        listed("sender", "text", "n"), listed("point", "text"), listed("issue", "text"), listed("hit", "message"),
        listed("last", "message"))


@X.per_session
def list_columns() -> dict:
    """The lists of a summary row from ``list_arrays`` and the thread's metadata."""
    first = F.concat(F.lit("["), X.minute_text("start_time"), F.lit("] Thread started by "),
                     F.col("first_sender"), F.lit(": "), F.col("first_subject"))
    latest = F.concat(F.lit("["), X.minute_text("end_time"), F.lit("] Latest update from "), F.col("last_sender"))
    # first and last messages are no middle hits; at most CAP_EVENTS hits are kept, two places go to the ends
    middle = F.transform(
        F.filter("_hit", lambda h: (h["message"]["message_id"] != F.col("first_message_id"))
                 & (h["message"]["message_id"] != F.col("last_message_id"))),
        lambda h: F.concat(F.lit("["), X.minute_text(h["message"]["received_time"]), F.lit("] "),
                           F.when(h["message"]["is_urgent"], F.lit("URGENT: Update from "))
                           .otherwise(F.lit("Delay reported by ")), h["message"]["sender"]))
    ends = F.when(F.col("email_count") > 1, F.array(first, latest)).otherwise(F.array(first))
    ascending = F.reverse("_last")
    of_last = F.slice(ascending, F.greatest(F.size(ascending) - (C.ACTION_MESSAGES - 1), F.lit(1)), F.lit(C.ACTION_MESSAGES))
    return {
        "key_events": F.slice(F.concat(ends, middle), 1, C.CAP_EVENTS),
        "stakeholders": F.transform("_sender", lambda x: F.concat(x["text"], F.lit(" ("), x["n"].cast("string"), F.lit(" emails)"))),
        "action_items": F.slice(F.flatten(F.transform(of_last, lambda x: x["message"]["action_lines"])), 1, C.CAP_ACTIONS),
        "key_points": F.transform("_point", lambda x: x["text"]),
        "issues": F.transform("_issue", lambda x: x["text"]),
        "conversation_flow": F.transform(ascending, lambda x: F.struct(
            X.minute_text(x["message"]["received_time"]).alias("date"), x["message"]["sender"].alias("sender"),
            x["message"]["subject"].alias("subject"), x["message"]["preview"].alias("preview"))),
    }
