"""Keywords of several words over a thread's whole text (X3 with spaces).

A thread's text is its messages' ``subject + ' ' + body`` in thread order, joined by one space, so a keyword
with a space can begin in one message and end in a later one, or hold a short message whole.  The text is
never put together.  Every space of a keyword is a place where two messages may meet; a message says, map
side, which places it can end at (its text ends with what stands before the space), which it can begin at,
and which two places it fills the gap between.  Those few numbers are joined with the next message's by
position in the thread, which spreads a hot thread like any other: no thread is one task, and only
messages that touch some place take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..session import written
from .sequence import message_sequence

FLAGS = {"is_urgent": "keywords_urgent", "has_delay": "keywords_delay", "is_transport": "keywords_transport",
         "is_customs": "keywords_customs"}


def phrases(p: Params) -> list[tuple[str, str]]:
    """(flag, keyword) of every keyword that holds a space."""
    return [(flag, kw) for flag, name in FLAGS.items() for kw in getattr(p, name) if " " in kw]


def _places(p: Params) -> list[tuple[int, str, int]]:
    """(number, keyword, position of the space) of every place; keywords once, whatever lists they are in."""
    kws = sorted({kw for _, kw in phrases(p)})
    return [(n, kw, at) for n, (kw, at) in enumerate((kw, i) for kw in kws for i, c in enumerate(kw) if c == " ")]


def phrase_columns(p: Params, subject: Column, body: Column) -> list[Column]:
    """Of each message: the keywords it holds whole (the border of subject and body included), the places it
    ends at and begins at, and the pairs of places it fills the gap between.  Empty for most messages."""
    text = F.lower(F.concat(subject, F.lit(" "), body))
    places = _places(p)
    kws = sorted({kw for _, kw in phrases(p)})

    def numbers(options):  # of those whose test holds
        return F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in options])) if options \
            else F.array().cast("array<int>")

    between = [F.when(text == kw[a + 1:b], F.struct(F.lit(n).alias("from"), F.lit(m).alias("to")))
               for n, kw, a in places for m, other, b in places if kw == other and " " in kw[a + 1:b]]
    return [numbers([(i, text.contains(F.lit(kw))) for i, kw in enumerate(kws)]).alias("phrase_whole"),
            numbers([(n, text.endswith(F.lit(kw[:at]))) for n, kw, at in places]).alias("phrase_ends"),
            numbers([(n, text.startswith(F.lit(kw[at + 1:]))) for n, kw, at in places]).alias("phrase_begins"),
            (F.array_compact(F.array(*between)) if between
             else F.array().cast("array<struct<from:int,to:int>>")).alias("phrase_fills")]


COLUMNS = ["phrase_whole", "phrase_ends", "phrase_begins", "phrase_fills"]


def phrase_hits(features: DataFrame, p: Params) -> DataFrame:
    """(thread_key, keyword): every keyword with a space that occurs in the thread's text, once."""
    kws = sorted({kw for _, kw in phrases(p)})
    places = _places(p)
    touched = F.size("phrase_whole") + F.size("phrase_ends") + F.size("phrase_begins") + F.size("phrase_fills") > 0
    seq = message_sequence(features.select("thread_key", "received_time", "message_id", *COLUMNS))
    some = written(seq.where(touched).select("thread_key", "seq", *COLUMNS), "phrase-places")
    of_whole = F.array(*[F.lit(kw) for kw in kws])
    of_place = F.array(*[F.lit(kw) for _, kw, _ in places])
    hits = some.select("thread_key", F.explode("phrase_whole").alias("i")).select(
        "thread_key", F.get(of_whole, F.col("i")).alias("keyword"))
    at = some.select("thread_key", (F.col("seq") + 1).alias("seq"), F.explode("phrase_ends").alias("place"))
    begins = some.select("thread_key", "seq", F.explode("phrase_begins").alias("place"))
    fills = some.select("thread_key", "seq", F.explode("phrase_fills").alias("f")).select(
        "thread_key", "seq", F.col("f.from").alias("place"), F.col("f.to").alias("to"))
    # merge joins: rows and positions of few distinct values are small as files and many times that unpacked, so
    # by the files' size Spark would broadcast what grows with the messages
    begins, fills = begins.hint("merge"), fills.hint("merge")
    # a keyword fills at most as many whole messages as it has further spaces between two of its places
    longest = max(kw[kw.index(" ") + 1:].count(" ") for kw in kws)
    for _ in range(longest // 2 + 1):
        hits = hits.unionByName(at.join(begins, ["thread_key", "seq", "place"], "left_semi").select(
            "thread_key", F.get(of_place, F.col("place")).alias("keyword")))
        at = at.join(fills, ["thread_key", "seq", "place"]).select(
            "thread_key", (F.col("seq") + 1).alias("seq"), F.col("to").alias("place"))
    return hits.distinct()


def with_phrase_flags(meta: DataFrame, features: DataFrame, p: Params) -> DataFrame:
    """Thread metadata whose flags also count keywords with spaces; unchanged where there are none."""
    found = phrases(p)
    if not found:
        return meta
    if not set(COLUMNS) <= set(features.columns):
        raise ValueError("the feature table was made without these keywords; featurize the messages with them")
    per_thread = phrase_hits(features, p).groupBy("thread_key").agg(*[
        F.bool_or(F.col("keyword").isin(*[kw for f, kw in found if f == flag])).alias(f"_{flag}")
        for flag in FLAGS if any(f == flag for f, _ in found)])
    added = [c for c in per_thread.columns if c != "thread_key"]
    return meta.join(per_thread.hint("merge"), "thread_key", "left").withColumns(
        {c[1:]: F.col(c[1:]) | F.coalesce(c, F.lit(False)) for c in added}).drop(*added)
