"""Report-shaped outputs.

Rankings over all threads are distributed: ordered outputs use a range-
partitioned ``orderBy`` and numbered outputs the bucketed row number, never
an un-partitioned window over the full set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X
from . import scoring as S
from .sequence import bucketed_row_number

L = F.lit


# --------------------------------------------------------------------------- dashboard
def dashboard_rows(summary: DataFrame) -> DataFrame:
    """dashboard projection with defaults for absent fields."""
    def d(c, v):
        return F.coalesce(F.col(c), L(v)) if c in summary.columns else L(v)
    return summary.select(
        "thread_key",
        d("thread_name", "Unknown").alias("name"),
        d("email_count", 0).cast("bigint").alias("emails"),
        d("participant_count", 0).cast("bigint").alias("participants"),
        d("duration_days", 0).cast("bigint").alias("duration_days"),
        d("start_date", "").alias("start_date"),
        d("end_date", "").alias("end_date"),
        d("priority_score", 0).cast("bigint").alias("priority_score"),
        d("priority_level", C.LEVEL_DEFAULT).alias("priority_level"),
        d("response_needed", False).alias("response_needed"),
        d("next_action", C.NEXT_UNKNOWN).alias("next_action"),
        d("is_urgent", False).alias("is_urgent"),
        d("has_delay", False).alias("has_delay"),
        d("is_transport", False).alias("is_transport"),
        d("is_customs", False).alias("is_customs"),
        d("is_archived", False).alias("is_archived"),
    )


@X.per_session
def card_flags() -> Column:
    return X.labels([(F.col("response_needed"), C.RESPONSE_FLAG),
                     (F.col("is_urgent"), f"{C.FLAG_SYMBOLS[0]} {C.FLAG_NAMES[0]}"),
                     (F.col("has_delay"), f"{C.FLAG_SYMBOLS[1]} {C.FLAG_NAMES[1]}"),
                     (F.col("is_transport"), f"{C.FLAG_SYMBOLS[2]} {C.FLAG_NAMES[2]}"),
                     (F.col("is_customs"), f"{C.FLAG_SYMBOLS[3]} {C.FLAG_NAMES[3]}")])


def dashboard_cards(rows: DataFrame) -> DataFrame:
    """F7 + T2 + S9: active threads as cards, highest score first (distributed sort)."""
    return (rows.filter(~F.col("is_archived"))
            .select("thread_key", "name", "priority_level", "priority_score", "emails", "participants",
                    "duration_days", "start_date", "end_date", F.array_join(card_flags(), " | ").alias("flags"),
                    "next_action", "response_needed")
            .orderBy(F.col("priority_score").desc(), F.col("thread_key")))


def dashboard_kpis(rows: DataFrame) -> DataFrame:
    """A5: one KPI row over active threads; no active thread -> no row."""
    a = rows.filter(~F.col("is_archived"))
    return (a.agg(F.count(L(1)).alias("total_threads"),
                  F.count_if(F.col("response_needed")).alias("response_needed"),
                  F.count_if(F.col("priority_level") == "Critical").alias("critical"),
                  F.count_if(F.col("priority_level") == "High").alias("high"),
                  F.count_if(F.col("is_urgent")).alias("urgent"),
                  F.count_if(F.col("has_delay")).alias("delay"))
            .filter(F.col("total_threads") > 0))


# --------------------------------------------------------------------------- review
def attention_queue(scored: DataFrame, p: Params) -> DataFrame:
    """F8 + X31 + T2: threads needing attention, highest score first."""
    return (scored.filter(S.requires_attention(p))
            .select("thread_key", "thread_name", "priority_score", "response_needed", "is_urgent",
                    F.array_join(S.suggested_actions(p), " | ").alias("suggested_actions"))
            .orderBy(F.col("priority_score").desc(), F.col("thread_key")))


# --------------------------------------------------------------------------- report + sheet
def report_totals(meta: DataFrame) -> DataFrame:
    """All / urgent / delay counts."""
    return meta.agg(F.count(L(1)).alias("total_threads"), F.count_if("is_urgent").alias("urgent_threads"),
                    F.count_if("has_delay").alias("delay_threads"))


def number_by_start(meta: DataFrame, p: Params, out: str = "item_no") -> DataFrame:
    """1-based number by start descending (ties by thread key), distributed over ranges of that order."""
    return bucketed_row_number(meta, [], ["-start_time", "thread_key"], out=out)


def report_lines(meta: DataFrame, p: Params) -> DataFrame:
    """Report as numbered lines (section, item_no, item_key, line_no, line); the file is the
    lines in that order, each followed by LF.  Urgent and delay sections are keyed by thread."""
    rule, dash = "=" * C.RULE_WIDTH, "-" * C.RULE_WIDTH
    tot = report_totals(meta)
    as_of = p.as_of.strftime("%Y-%m-%d %H:%M:%S")

    def lines(df, section, item_no, item_key, texts):
        return df.select(L(section).alias("section"), item_no.cast("bigint").alias("item_no"),
                         item_key.alias("item_key"),
                         F.posexplode(F.array(*texts)).alias("line_no", "line")) \
            .withColumn("line_no", F.col("line_no").cast("bigint"))

    nul_no, nul_key = L(None).cast("bigint"), L(None).cast("string")
    header = lines(tot, 0, nul_no, nul_key, [
        L(p.report_title), L(rule), L(""), L(f"Generated: {as_of}"),
        F.concat(L("Total Threads: "), F.col("total_threads").cast("string")), L("")])
    urg_h = lines(tot.filter(F.col("urgent_threads") > 0), 1, nul_no, nul_key, [
        L(""), F.concat(L(f"{C.FLAG_SYMBOLS[0]} URGENT THREADS ("), F.col("urgent_threads").cast("string"), L("):")),
        L(dash)])
    urg = lines(meta.filter("is_urgent"), 2, nul_no, F.col("thread_key"), [
        F.concat(L("  - "), F.col("thread_name")),
        F.concat(L("    Emails: "), F.col("email_count").cast("string"), L(" | Participants: "),
                 F.col("participant_count").cast("string")),
        F.concat(L("    Date: "), F.col("start_date")), L("")])
    del_h = lines(tot.filter(F.col("delay_threads") > 0), 3, nul_no, nul_key, [
        L(""), F.concat(L(f"{C.FLAG_SYMBOLS[1]} THREADS WITH DELAYS ("), F.col("delay_threads").cast("string"),
                        L("):")), L(dash)])
    dly = lines(meta.filter("has_delay"), 4, nul_no, F.col("thread_key"), [
        F.concat(L("  - "), F.col("thread_name")),
        F.concat(L("    Emails: "), F.col("email_count").cast("string"), L(" | Duration: "),
                 F.col("duration_days").cast("string"), L(" days")), L("")])
    all_h = lines(tot, 5, nul_no, nul_key, [L(""), L("ALL THREADS:"), L(dash)])
    numbered = number_by_start(meta, p)
    alls = lines(numbered, 6, F.col("item_no"), F.col("thread_key"), [
        F.concat(F.col("item_no").cast("string"), L(". "), F.col("thread_name")),
        F.concat(L("   Emails: "), F.col("email_count").cast("string"), L(" | Participants: "),
                 F.col("participant_count").cast("string"), L(" | Duration: "),
                 F.col("duration_days").cast("string"), L(" days")),
        F.concat(L("   "), F.col("start_date"), L(" to "), F.col("end_date")), L("")])
    out = header
    for part in (urg_h, urg, del_h, dly, all_h, alls):
        out = out.unionByName(part)
    return out


SHEET_COLUMNS = ("Thread Name", "Emails", "Participants", "Start Date", "End Date", "Duration (days)",
                 "Attachments", "Urgent", "Delay", "Transport", "Customs", "Conversation ID")


def export_sheet(meta: DataFrame) -> DataFrame:
    """Twelve renamed columns, flags as symbols, newest start first."""
    def sym(flag, i):
        return F.when(F.col(flag), L(C.FLAG_SYMBOLS[i])).otherwise(L(""))
    return (meta.select(F.col("thread_name").alias(SHEET_COLUMNS[0]), F.col("email_count").alias(SHEET_COLUMNS[1]),
                        F.col("participant_count").alias(SHEET_COLUMNS[2]), F.col("start_date").alias(SHEET_COLUMNS[3]),
                        F.col("end_date").alias(SHEET_COLUMNS[4]), F.col("duration_days").alias(SHEET_COLUMNS[5]),
                        F.col("total_attachments").alias(SHEET_COLUMNS[6]), sym("is_urgent", 0).alias(SHEET_COLUMNS[7]),
                        sym("has_delay", 1).alias(SHEET_COLUMNS[8]), sym("is_transport", 2).alias(SHEET_COLUMNS[9]),
                        sym("is_customs", 3).alias(SHEET_COLUMNS[10]),
                        F.col("conversation_id").alias(SHEET_COLUMNS[11]))
            .orderBy(F.col(SHEET_COLUMNS[3]).desc(), F.col(SHEET_COLUMNS[11])))


# --------------------------------------------------------------------------- timelines
def sender_palette(features: DataFrame) -> DataFrame:
    """A10: distinct senders per thread with a 0-based palette slot in sender order."""
    senders = features.select("thread_key", "sender").distinct()
    return bucketed_row_number(senders, ["thread_key"], ["sender"], out="_slot").select(
        "thread_key", "sender", (F.col("_slot") - 1).alias("color_slot"))


def _subject_cut(c) -> Column:
    return F.when(F.length(c) > C.POINT_SUBJECT_CUT, F.concat(F.left(c, L(C.POINT_SUBJECT_CUT)), L("..."))) \
        .otherwise(c)


def timeline_points(seq: DataFrame, palette: DataFrame) -> DataFrame:
    """Chart points (0-based position, time, labels, legend name, colour slot)."""
    return seq.join(palette, ["thread_key", "sender"]).select(
        "thread_key", "message_id", (F.col("seq") - 1).alias("y"), X.minute_text("received_time").alias("time"),
        F.concat(F.left("sender", L(C.POINT_SENDER_CHARS)), L("\n"),
                 F.left(_subject_cut(F.col("subject")), L(C.POINT_SUBJECT_CHARS))).alias("label"),
        F.concat(L("Email "), F.col("seq").cast("string")).alias("tick"),
        F.left("sender", L(C.LEGEND_CHARS)).alias("legend"), "color_slot")


def sender_series(seq: DataFrame) -> DataFrame:
    """A9 + X29: one row per point of each sender's series (long form, ordered by y)."""
    hover = F.concat(L("<b>"), F.col("sender"), L("</b><br>"), F.col("subject"), L("<br>"),
                     X.minute_text("received_time"), L("<br><i>"), F.col("hover_body"), L("...</i>"))
    return seq.select("thread_key", "sender", F.left("sender", L(C.LEGEND_CHARS)).alias("series_name"),
                      (F.col("seq") - 1).alias("y"), X.minute_text("received_time").alias("x"),
                      F.concat(L("Email "), F.col("seq").cast("string")).alias("text"), "subject",
                      hover.alias("hover_text"))


SERIES_CHUNK = 1000


def sender_series_chunks(seq: DataFrame, size: int = SERIES_CHUNK) -> DataFrame:
    """The series of each sender as arrays (positions, times, labels, subjects, hover texts), in chunks of
    at most ``size`` points numbered in order; ``first`` is the sender's first position.  Points are numbered
    within (thread, sender) by the split numbering, so a sender of any size is many bounded rows."""
    points = sender_series(seq).select("thread_key", "sender", "series_name", "y", "x", "text", "subject", "hover_text")
    numbered = bucketed_row_number(points, ["thread_key", "sender"], ["y"], out="_point")
    chunk = F.floor((F.col("_point") - 1) / size).cast("bigint")
    fields = ("y", "x", "text", "subject", "hover_text")
    grouped = numbered.groupBy("thread_key", "sender", "series_name", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_points"))
    return grouped.select("thread_key", "sender", "series_name", "chunk",
                          *[F.col("_points").getField(f).alias(f) for f in fields])


def gantt(seq: DataFrame) -> DataFrame:
    """Interval to the next message, last one +1 hour; task/resource labels."""
    finish = F.coalesce(F.col("next_time"), F.col("received_time") + F.expr("INTERVAL 1 HOUR"))
    return seq.select("thread_key", "message_id", F.left("sender", L(C.GANTT_TASK_CHARS)).alias("task"),
                      X.iso_text("received_time").alias("start"), X.iso_text(finish).alias("finish"),
                      F.left("subject", L(C.GANTT_RESOURCE_CHARS)).alias("resource"))
