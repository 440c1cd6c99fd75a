"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the oracle SQL.

Every query reads the generated tables through the messages adapter and runs
over whole tables.  Arrays are presented as ' | '-joined strings and times as
ISO / minute text so the Spark and DuckDB results hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import TEST_PARAMS as P
from ..functions import text as X
from ..sources.messages import messages_from_conversations, messages_with_faults
from . import oracle as O
from .job import ThreadJob

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_JOBS: dict[tuple, object] = {}
_TABLES = ("conversations", "documents", "events")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables below a path were last changed, so that what is kept for a path is for its present data."""
    jvm, out = spark._jvm, []
    for t in _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append(fs.getFileStatus(path).getModificationTime() if fs.exists(path) else None)
    return tuple(out)


def kept(spark: SparkSession, sf_dir: str, kind: str, make: Callable):
    """What ``make`` gives, once per session, input (and its state) and kind: repeated queries share a job's
    features or a written store."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, _state(spark, sf_dir))
    if key not in _JOBS:
        _JOBS[key] = make()
    return _JOBS[key]


def job(spark: SparkSession, sf_dir: str) -> ThreadJob:
    return kept(spark, sf_dir, "conversations", lambda: ThreadJob(messages_from_conversations(spark, sf_dir), P))


def register(name: str, sql: str | None = None, adapter: str = O.ADAPTER):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = O.with_base(sql, adapter=adapter)
        return fn
    return deco


def joined(c: str) -> F.Column:
    return F.array_join(F.col(c), " | ")


META_COLS_SQL = """thread_key, conversation_id, thread_name, email_count, array_to_string(participants, ' | ') AS participants,
participant_count, start_date, end_date, duration_days, total_attachments, is_urgent, has_delay, is_transport, is_customs"""


def meta_cols(df: DataFrame) -> DataFrame:
    return df.select("thread_key", "conversation_id", "thread_name", "email_count",
                     joined("participants").alias("participants"), "participant_count", "start_date", "end_date",
                     "duration_days", "total_attachments", "is_urgent", "has_delay", "is_transport", "is_customs")


# --------------------------------------------------------------------------- sources / filters
@register("message_scan", f"""
SELECT message_id, conversation_id, folder, sender, subject, {O.iso('received_time')} AS received_time,
       attachment_count, length(body) AS body_chars FROM msgs""")
def q_message_scan(spark, sf):
    m = messages_from_conversations(spark, sf)
    return m.select("message_id", "conversation_id", "folder", "sender", "subject",
                    X.iso_text("received_time").alias("received_time"), "attachment_count",
                    F.length("body").cast("int").alias("body_chars"))


@register("exclude_folders", "SELECT message_id, folder FROM kept")
def q_exclude_folders(spark, sf):
    return job(spark, sf).kept.select("message_id", "folder")


@register("identify_threads", "SELECT thread_key, conversation_id, email_count FROM meta")
def q_identify_threads(spark, sf):
    from ..operators.threads import identify_threads
    return identify_threads(job(spark, sf).envelope, P.min_messages).select(
        "thread_key", "conversation_id", "email_count")


@register("thread_metadata", f"SELECT {META_COLS_SQL} FROM meta")
def q_thread_metadata(spark, sf):
    j = job(spark, sf)
    return meta_cols(j.with_participants(j.scored))


@register("keyword_flags", """
SELECT thread_key, is_urgent, has_delay, is_transport, is_customs FROM meta""")
def q_keyword_flags(spark, sf):
    return job(spark, sf).meta.select("thread_key", "is_urgent", "has_delay", "is_transport", "is_customs")


@register("thread_name", "SELECT thread_key, thread_name FROM meta")
def q_thread_name(spark, sf):
    return job(spark, sf).facts.select("thread_key", "thread_name")


@register("days_since", "SELECT thread_key, end_date, days_since_last FROM meta")
def q_days_since(spark, sf):
    return job(spark, sf).facts.select("thread_key", "end_date", "days_since_last")


# --------------------------------------------------------------------------- lists
@register("thread_events", "SELECT thread_key, event_rank, event FROM events")
def q_thread_events(spark, sf):
    return job(spark, sf).events.select("thread_key", F.col("event_rank").cast("bigint"), "event")


@register("stakeholders", "SELECT thread_key, stakeholder_rank, stakeholder FROM stakeholders")
def q_stakeholders(spark, sf):
    return job(spark, sf).stakeholders.select("thread_key", F.col("stakeholder_rank").cast("bigint"), "stakeholder")


@register("action_items", "SELECT thread_key, item_rank, action_item FROM action_items")
def q_action_items(spark, sf):
    return job(spark, sf).action_items.select("thread_key", F.col("item_rank").cast("bigint"), "action_item")


@register("key_points", "SELECT thread_key, point_rank, key_point FROM key_points")
def q_key_points(spark, sf):
    return job(spark, sf).key_points.select("thread_key", F.col("point_rank").cast("bigint"), "key_point")


@register("thread_issues", "SELECT thread_key, issue_rank, issue FROM issues")
def q_thread_issues(spark, sf):
    return job(spark, sf).issues.select("thread_key", F.col("issue_rank").cast("bigint"), "issue")


@register("conversation_flow", "SELECT thread_key, flow_pos, date, sender, subject, preview FROM flow")
def q_conversation_flow(spark, sf):
    return job(spark, sf).flow.select("thread_key", F.col("flow_pos").cast("bigint"), "date", "sender",
                                      "subject", "preview")


# --------------------------------------------------------------------------- scoring / insights
@register("priority_score", "SELECT thread_key, priority_score, priority_level FROM scored")
def q_priority_score(spark, sf):
    return job(spark, sf).scored.select("thread_key", "priority_score", "priority_level")


@register("priority_factors", "SELECT thread_key, array_to_string(priority_factors, ' | ') AS factors FROM scored")
def q_priority_factors(spark, sf):
    return job(spark, sf).scored.select("thread_key", joined("priority_factors").alias("factors"))


@register("thread_status", "SELECT thread_key, current_status FROM scored")
def q_thread_status(spark, sf):
    return job(spark, sf).scored.select("thread_key", "current_status")


@register("response_needed", "SELECT thread_key, response_needed, last_responder FROM scored")
def q_response_needed(spark, sf):
    return job(spark, sf).scored.select("thread_key", "response_needed", "last_responder")


@register("waiting_on", "SELECT thread_key, waiting_on FROM scored")
def q_waiting_on(spark, sf):
    return job(spark, sf).scored.select("thread_key", "waiting_on")


@register("next_action", "SELECT thread_key, next_action FROM scored")
def q_next_action(spark, sf):
    return job(spark, sf).scored.select("thread_key", "next_action")


@register("archive_split", f"""
SELECT thread_key, days_since_last, is_archived,
       CASE WHEN is_archived THEN '{C.ARCHIVE_ROOT}' ELSE '{C.ACTIVE_ROOT}' END AS target_root FROM scored""")
def q_archive_split(spark, sf):
    s = job(spark, sf).facts
    return s.select("thread_key", "days_since_last", "is_archived",
                    F.when(F.col("is_archived"), F.lit(C.ARCHIVE_ROOT)).otherwise(F.lit(C.ACTIVE_ROOT))
                    .alias("target_root"))


# --------------------------------------------------------------------------- summary / render
SUMMARY_SQL = """thread_key, method, thread_name, executive_summary, current_status,
array_to_string(key_events, ' | ') AS key_events, array_to_string(stakeholders, ' | ') AS stakeholders,
array_to_string(action_items, ' | ') AS action_items, array_to_string(issues, ' | ') AS issues,
array_to_string(key_points, ' | ') AS key_points, response_needed, next_action, waiting_on, last_responder,
priority_score, priority_level, array_to_string(priority_factors, ' | ') AS factors, reply_template"""


def summary_cols(df: DataFrame) -> DataFrame:
    return df.select("thread_key", "method", "thread_name", "executive_summary", "current_status",
                     joined("key_events").alias("key_events"), joined("stakeholders").alias("stakeholders"),
                     joined("action_items").alias("action_items"), joined("issues").alias("issues"),
                     joined("key_points").alias("key_points"), "response_needed", "next_action", "waiting_on",
                     "last_responder", "priority_score", "priority_level",
                     joined("priority_factors").alias("factors"), "reply_template")


@register("thread_summary", f"SELECT {SUMMARY_SQL} FROM summary")
def q_thread_summary(spark, sf):
    return summary_cols(job(spark, sf).summary)


@register("executive_summary", "SELECT thread_key, executive_summary FROM summary")
def q_executive_summary(spark, sf):
    return job(spark, sf).summary.select("thread_key", "executive_summary")


@register("reply_template", "SELECT thread_key, reply_template FROM summary")
def q_reply_template(spark, sf):
    return job(spark, sf).summary.select("thread_key", "reply_template")


@register("summary_markdown", "SELECT thread_key, is_archived, summary_markdown FROM md")
def q_summary_markdown(spark, sf):
    return job(spark, sf).markdown.select("thread_key", "is_archived", "summary_markdown")


# --------------------------------------------------------------------------- per-message operators
from datetime import timedelta  # noqa: E402

from ..operators import extract as E  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import keywords as KW  # noqa: E402
from ..operators import lifecycle as LC  # noqa: E402
from ..operators import model as M  # noqa: E402
from ..operators import outputs as OUT  # noqa: E402
from ..operators import render as R  # noqa: E402
from ..operators import scoring as S  # noqa: E402
from ..operators import threads as T  # noqa: E402
from ..session import scratch_path  # noqa: E402
from ..sources import messages as MS  # noqa: E402
from ..sources import stored as ST  # noqa: E402
from ..sources import versions as V  # noqa: E402
from . import run as RUN  # noqa: E402


@register("mail_only", f"SELECT message_id, item_class FROM msgs WHERE item_class = {C.MAIL_ITEM_CLASS}")
def q_mail_only(spark, sf):
    return FE.mail_only(messages_from_conversations(spark, sf)).select("message_id", "item_class")


def faulty_job(spark, sf) -> ThreadJob:
    return kept(spark, sf, "faulty", lambda: ThreadJob(messages_with_faults(spark, sf), P))


@register("rejects", """
SELECT message_id, CASE WHEN received_time IS NULL THEN 'no received_time' ELSE 'no message_id' END AS reject_reason
FROM msgs WHERE received_time IS NULL OR message_id IS NULL""", adapter=O.FAULTY_ADAPTER)
def q_rejects(spark, sf):
    return faulty_job(spark, sf).rejects.select("message_id", "reject_reason")


KW_LISTS = {"urgent": C.KEYWORDS_URGENT, "delay": C.KEYWORDS_DELAY,
            "transport": C.KEYWORDS_TRANSPORT, "customs": C.KEYWORDS_CUSTOMS}


@register("keyword_hits", " UNION ALL ".join(
    f"SELECT message_id, {O.q(n)} AS list_name, {O.q(k)} AS keyword FROM msgs "
    f"WHERE contains(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), {O.q(k)})"
    for n, ks in KW_LISTS.items() for k in ks))
def q_keyword_hits(spark, sf):
    return FE.keyword_hits(messages_from_conversations(spark, sf), KW_LISTS)


@register("keyword_table_hits", """
SELECT message_id, list_name, keyword
FROM (SELECT message_id, lower(coalesce(subject, '') || ' ' || coalesce(body, '')) AS text FROM msgs) m
JOIN (SELECT DISTINCT lang AS list_name, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS keyword FROM documents) k
  ON contains(m.text, k.keyword)""")
def q_keyword_table_hits(spark, sf):
    """J3 with tens of thousands of keywords from a table: every word of six letters or more that the
    documents hold, a list per language, looked for in the messages."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("lang").alias("list_name"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"))).alias("keyword"))
    return KW.keyword_table_hits(messages_from_conversations(spark, sf), words.distinct())


@register("clean_body", "SELECT message_id, clean_body FROM cb")
def q_clean_body(spark, sf):
    m = messages_from_conversations(spark, sf)
    return m.select("message_id", X.clean_body(F.coalesce(F.col("body"), F.lit(""))).alias("clean_body"))


@register("message_sequence", "SELECT thread_key, message_id, rn AS seq FROM kf")
def q_message_sequence(spark, sf):
    return job(spark, sf).sequenced.select("thread_key", "message_id", "seq")


@register("last_messages", f"""
SELECT thread_key, message_id, row_number() OVER (PARTITION BY thread_key ORDER BY rn) AS pos,
       rn_desc <= {C.ACTION_MESSAGES} AS in_last3
FROM kf WHERE rn_desc <= {C.FLOW_MESSAGES}""")
def q_last_messages(spark, sf):
    j = job(spark, sf)
    last = E.last_messages(j.kept_features, C.FLOW_MESSAGES, ["message_id"])
    return last.select("thread_key", "message_id", F.col("pos").cast("bigint"),
                       (F.col("from_end") <= C.ACTION_MESSAGES).alias("in_last3"))


@register("thread_endpoints", """
SELECT thread_key, first_message_id, last_message_id, first_sender, last_sender, start_date, end_date FROM meta""")
def q_thread_endpoints(spark, sf):
    return job(spark, sf).facts.select("thread_key", "first_message_id", "last_message_id", "first_sender",
                                        "last_sender", "start_date", "end_date")


@register("sender_counts", f"""
SELECT thread_key, sender, count(*) AS n_emails, {O.iso('min(received_time)')} AS first_seen
FROM kf GROUP BY thread_key, sender""")
def q_sender_counts(spark, sf):
    return job(spark, sf).sender_counts.select("thread_key", "sender", "n_emails",
                                               X.iso_text(F.col("first_ord.received_time")).alias("first_seen"))


@register("thread_slug", f"""
SELECT thread_key, thread_name, {O.slug_sql('thread_name', 'conversation_id')} AS folder_slug FROM meta""")
def q_thread_slug(spark, sf):
    return job(spark, sf).facts.select("thread_key", "thread_name",
                                      X.slug("thread_name", "conversation_id").alias("folder_slug"))


ORACLE_MODEL_INPUT = f"""
SELECT thread_key, CASE WHEN length(t) > {C.MODEL_INPUT_CHARS} THEN left(t, {C.MODEL_INPUT_CHARS}) || '...'
       ELSE t END AS model_input
FROM (SELECT thread_key, string_agg('Email ' || rn::VARCHAR || ' [' || {O.minute('received_time')} || '] From '
             || sender || ': ' || subject || '. ' || snippet || '. ', '' ORDER BY rn) AS t FROM kf GROUP BY 1)"""


@register("model_input", ORACLE_MODEL_INPUT)
def q_model_input(spark, sf):
    return job(spark, sf).model_input


@register("scan_only", """
SELECT thread_key, thread_name, email_count, participant_count,
       CASE WHEN len(fl) > 0 THEN array_to_string(fl, ', ') ELSE 'None' END AS flags
FROM (SELECT *, list_filter([CASE WHEN is_urgent THEN 'URGENT' END, CASE WHEN has_delay THEN 'DELAY' END,
                             CASE WHEN is_transport THEN 'TRANSPORT' END, CASE WHEN is_customs THEN 'CUSTOMS' END],
                            lambda x: x IS NOT NULL) AS fl FROM meta)""")
def q_scan_only(spark, sf):
    return T.scan_only(job(spark, sf).meta)


@register("scan_preview", "SELECT thread_key, email_count FROM meta ORDER BY thread_key LIMIT 5")
def q_scan_preview(spark, sf):
    return job(spark, sf).facts.select("thread_key", "email_count").orderBy("thread_key").limit(5)


# --------------------------------------------------------------------------- texts
@register("basic_reply", f"SELECT thread_key, {O.basic_reply_sql()} AS basic_reply FROM scored")
def q_basic_reply(spark, sf):
    return job(spark, sf).scored.select("thread_key", R.basic_reply().alias("basic_reply"))


@register("suggested_actions", f"""
SELECT thread_key, array_to_string({O.suggested_sql()}, ' | ') AS suggested_actions FROM scored""")
def q_suggested_actions(spark, sf):
    return job(spark, sf).scored.select("thread_key",
                                        F.array_join(S.suggested_actions(P), " | ").alias("suggested_actions"))


_SCORE_LINE_SQL = """list_filter(string_split(summary_markdown, chr(10)),
                                 lambda x: contains(x, 'Priority:') AND contains(x, '('))[1]"""
_SCORE_TEXT_SQL = O.strip(f"split_part(split_part({_SCORE_LINE_SQL}, '(', 2), '/', 1)")
PARSE_PRIORITY_SQL = f"coalesce(TRY_CAST({_SCORE_TEXT_SQL} AS BIGINT), 0)"
_REPLY_TEXT_SQL = O.strip(rf"""regexp_extract(summary_markdown, '(?s){C.REPLY_HEADING}\s*```\n(.*?)\n```', 1)""")
PARSE_REPLY_SQL = f"coalesce({_REPLY_TEXT_SQL}, '')"


@register("parse_priority", f"SELECT thread_key, priority_score, {PARSE_PRIORITY_SQL} AS parsed_score FROM md")
def q_parse_priority(spark, sf):
    return job(spark, sf).markdown.select("thread_key", "priority_score",
                                          R.parse_priority(F.col("summary_markdown")).alias("parsed_score"))


@register("parse_reply", f"SELECT thread_key, {PARSE_REPLY_SQL} AS parsed_reply FROM md")
def q_parse_reply(spark, sf):
    return job(spark, sf).markdown.select("thread_key", R.parse_reply(F.col("summary_markdown")).alias("parsed_reply"))


@register("executive_excerpt", f"""
SELECT thread_key, CASE WHEN length(ex) > 0 THEN left(ex, {C.EXCERPT_CHARS}) || '...' END AS excerpt
FROM (SELECT thread_key, {O.strip("CASE WHEN idx > 0 AND idx + 2 <= len(lines) THEN lines[idx + 2] END")} AS ex
      FROM (SELECT thread_key, lines,
                   coalesce(list_position(list_transform(lines, lambda x: contains(x, '## Executive Summary')), true), 0)
                   AS idx
            FROM (SELECT thread_key, string_split(summary_markdown, chr(10)) AS lines FROM md)))""")
def q_executive_excerpt(spark, sf):
    return job(spark, sf).markdown.select("thread_key", R.executive_excerpt(F.col("summary_markdown")).alias("excerpt"))


# --------------------------------------------------------------------------- dashboard / review / report
CARD_SQL = O._labels([("response_needed", C.RESPONSE_FLAG),
                      ("is_urgent", f"{C.FLAG_SYMBOLS[0]} {C.FLAG_NAMES[0]}"),
                      ("has_delay", f"{C.FLAG_SYMBOLS[1]} {C.FLAG_NAMES[1]}"),
                      ("is_transport", f"{C.FLAG_SYMBOLS[2]} {C.FLAG_NAMES[2]}"),
                      ("is_customs", f"{C.FLAG_SYMBOLS[3]} {C.FLAG_NAMES[3]}")])


@register("dashboard_cards", f"""
SELECT thread_key, thread_name AS name, priority_level, priority_score, email_count AS emails,
       participant_count AS participants, duration_days, start_date, end_date,
       array_to_string({CARD_SQL}, ' | ') AS flags, next_action, response_needed
FROM summary WHERE NOT is_archived ORDER BY priority_score DESC, thread_key""")
def q_dashboard_cards(spark, sf):
    return OUT.dashboard_cards(job(spark, sf).dashboard_rows)


@register("dashboard_kpis", """
SELECT count(*) AS total_threads, count_if(response_needed) AS response_needed,
       count_if(priority_level = 'Critical') AS critical, count_if(priority_level = 'High') AS high,
       count_if(is_urgent) AS urgent, count_if(has_delay) AS delay
FROM summary WHERE NOT is_archived HAVING count(*) > 0""")
def q_dashboard_kpis(spark, sf):
    return OUT.dashboard_kpis(job(spark, sf).dashboard_rows)


ATTN_SQL = f"""
SELECT thread_key, thread_name, priority_score, response_needed, is_urgent,
       array_to_string({O.suggested_sql()}, ' | ') AS suggested_actions
FROM attention ORDER BY priority_score DESC, thread_key"""


@register("attention_queue", ATTN_SQL)
def q_attention_queue(spark, sf):
    return job(spark, sf).attention


@register("attention_top5", ATTN_SQL + " LIMIT 5")
def q_attention_top5(spark, sf):
    return job(spark, sf).attention.limit(5)


@register("urgent_threads", f"SELECT {META_COLS_SQL} FROM scored WHERE NOT is_archived AND is_urgent")
def q_urgent_threads(spark, sf):
    j = job(spark, sf)
    return meta_cols(j.with_participants(j.report_set.filter("is_urgent")))


@register("delay_threads", f"SELECT {META_COLS_SQL} FROM scored WHERE NOT is_archived AND has_delay")
def q_delay_threads(spark, sf):
    j = job(spark, sf)
    return meta_cols(j.with_participants(j.report_set.filter("has_delay")))


@register("report_totals", """
SELECT count(*) AS total_threads, coalesce(count_if(is_urgent), 0) AS urgent_threads,
       coalesce(count_if(has_delay), 0) AS delay_threads
FROM scored WHERE NOT is_archived""")
def q_report_totals(spark, sf):
    return OUT.report_totals(job(spark, sf).report_set)


def _report_sql() -> str:
    rule, dash = "=" * C.RULE_WIDTH, "-" * C.RULE_WIDTH
    as_of = P.as_of.strftime("%Y-%m-%d %H:%M:%S")

    def part(section, item_no, item_key, texts, src):
        arr = "[" + ", ".join(texts) + "]"
        return (f"SELECT {section} AS section, {item_no} AS item_no, {item_key} AS item_key, "
                f"CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line "
                f"FROM (SELECT *, {arr} AS l FROM {src})")
    nn, nk = "NULL::BIGINT", "NULL::VARCHAR"
    parts = [
        part(0, nn, nk, [O.q(P.report_title), O.q(rule), "''", O.q(f"Generated: {as_of}"),
                         "'Total Threads: ' || total_threads::VARCHAR", "''"], "tot"),
        part(1, nn, nk, ["''", f"'{C.FLAG_SYMBOLS[0]} URGENT THREADS (' || urgent_threads::VARCHAR || '):'",
                         O.q(dash)], "tot WHERE urgent_threads > 0"),
        part(2, nn, "thread_key", ["'  - ' || thread_name",
                                   "'    Emails: ' || email_count::VARCHAR || ' | Participants: ' "
                                   "|| participant_count::VARCHAR", "'    Date: ' || start_date", "''"],
             "rs WHERE is_urgent"),
        part(3, nn, nk, ["''", f"'{C.FLAG_SYMBOLS[1]} THREADS WITH DELAYS (' || delay_threads::VARCHAR || '):'",
                         O.q(dash)], "tot WHERE delay_threads > 0"),
        part(4, nn, "thread_key", ["'  - ' || thread_name",
                                   "'    Emails: ' || email_count::VARCHAR || ' | Duration: ' "
                                   "|| duration_days::VARCHAR || ' days'", "''"], "rs WHERE has_delay"),
        part(5, nn, nk, ["''", "'ALL THREADS:'", O.q(dash)], "tot"),
        part(6, "item_no", "thread_key", [
            "item_no::VARCHAR || '. ' || thread_name",
            "'   Emails: ' || email_count::VARCHAR || ' | Participants: ' || participant_count::VARCHAR "
            "|| ' | Duration: ' || duration_days::VARCHAR || ' days'",
            "'   ' || start_date || ' to ' || end_date", "''"],
            "(SELECT *, row_number() OVER (ORDER BY start_time DESC, thread_key) AS item_no FROM rs)"),
    ]
    return (", rs AS (SELECT * FROM scored WHERE NOT is_archived), "
            "tot AS (SELECT count(*) AS total_threads, coalesce(count_if(is_urgent), 0) AS urgent_threads, "
            "coalesce(count_if(has_delay), 0) AS delay_threads FROM rs) " + " UNION ALL ".join(parts))


@register("report_lines", _report_sql())
def q_report_lines(spark, sf):
    return OUT.report_lines(job(spark, sf).report_set, P)


@register("export_sheet", f"""
SELECT thread_name AS "Thread Name", email_count AS "Emails", participant_count AS "Participants",
       start_date AS "Start Date", end_date AS "End Date", duration_days AS "Duration (days)",
       total_attachments AS "Attachments",
       CASE WHEN is_urgent THEN '{C.FLAG_SYMBOLS[0]}' ELSE '' END AS "Urgent",
       CASE WHEN has_delay THEN '{C.FLAG_SYMBOLS[1]}' ELSE '' END AS "Delay",
       CASE WHEN is_transport THEN '{C.FLAG_SYMBOLS[2]}' ELSE '' END AS "Transport",
       CASE WHEN is_customs THEN '{C.FLAG_SYMBOLS[3]}' ELSE '' END AS "Customs",
       conversation_id AS "Conversation ID"
FROM scored WHERE NOT is_archived ORDER BY start_date DESC, conversation_id""")
def q_export_sheet(spark, sf):
    return OUT.export_sheet(job(spark, sf).report_set)


# --------------------------------------------------------------------------- timelines
@register("timeline_text", f"""
SELECT thread_key, 1::BIGINT AS line_no, 'TIMELINE: ' || thread_name AS line FROM scored
UNION ALL SELECT thread_key, 2, '{'=' * C.RULE_WIDTH}' FROM scored
UNION ALL SELECT thread_key, 3, '' FROM scored
UNION ALL SELECT thread_key, 3 + (rn - 1) * 3 + 1, '[' || {O.minute('received_time')} || '] ' || sender FROM kf
UNION ALL SELECT k.thread_key, 3 + (k.rn - 1) * 3 + 2, left(cb.clean_body, {C.CLEAN_SNIPPET_CHARS})
          FROM kf k JOIN cb USING (message_id)
UNION ALL SELECT thread_key, 3 + (rn - 1) * 3 + 3, '' FROM kf
UNION ALL SELECT thread_key, 3 + email_count * 3 + 1, '{'=' * C.RULE_WIDTH}' FROM scored
UNION ALL SELECT thread_key, 3 + email_count * 3 + 2, 'Total Emails: ' || email_count::VARCHAR FROM scored
UNION ALL SELECT thread_key, 3 + email_count * 3 + 3, 'Participants: ' || participant_count::VARCHAR FROM scored
UNION ALL SELECT thread_key, 3 + email_count * 3 + 4, 'Duration: ' || duration_days::VARCHAR || ' days' FROM scored
UNION ALL SELECT thread_key, 3 + email_count * 3 + 5, 'Attachments: ' || total_attachments::VARCHAR FROM scored""")
def q_timeline_text(spark, sf):
    return job(spark, sf).timeline


PALETTE_SQL = """(SELECT thread_key, sender, row_number() OVER (PARTITION BY thread_key ORDER BY sender) - 1 AS color_slot
FROM (SELECT DISTINCT thread_key, sender FROM kf))"""


@register("sender_palette", f"SELECT * FROM {PALETTE_SQL}")
def q_sender_palette(spark, sf):
    return job(spark, sf).palette


def _cut_sql(c: str) -> str:
    return f"(CASE WHEN length({c}) > {C.POINT_SUBJECT_CUT} THEN left({c}, {C.POINT_SUBJECT_CUT}) || '...' ELSE {c} END)"


@register("timeline_points", f"""
SELECT k.thread_key, k.message_id, k.rn - 1 AS y, {O.minute('k.received_time')} AS time,
       left(k.sender, {C.POINT_SENDER_CHARS}) || chr(10) || left({_cut_sql('k.subject')}, {C.POINT_SUBJECT_CHARS}) AS label,
       'Email ' || k.rn::VARCHAR AS tick, left(k.sender, {C.LEGEND_CHARS}) AS legend, p.color_slot
FROM kf k JOIN {PALETTE_SQL} p ON p.thread_key = k.thread_key AND p.sender = k.sender""")
def q_timeline_points(spark, sf):
    j = job(spark, sf)
    return OUT.timeline_points(j.sequenced, j.palette)


@register("sender_series", f"""
SELECT thread_key, sender, left(sender, {C.LEGEND_CHARS}) AS series_name, rn - 1 AS y,
       {O.minute('received_time')} AS x, 'Email ' || rn::VARCHAR AS text, subject,
       '<b>' || sender || '</b><br>' || subject || '<br>' || {O.minute('received_time')} || '<br><i>'
       || left(body, {C.HOVER_CHARS}) || '...</i>' AS hover_text
FROM kf""")
def q_sender_series(spark, sf):
    return OUT.sender_series(job(spark, sf).sequenced)


@register("gantt", f"""
SELECT thread_key, message_id, left(sender, {C.GANTT_TASK_CHARS}) AS task, {O.iso('received_time')} AS start,
       {O.iso('coalesce(nt, received_time + INTERVAL 1 HOUR)')} AS finish,
       left(subject, {C.GANTT_RESOURCE_CHARS}) AS resource
FROM (SELECT *, lead(received_time) OVER (PARTITION BY thread_key ORDER BY rn) AS nt FROM kf)""")
def q_gantt(spark, sf):
    return OUT.gantt(job(spark, sf).sequenced)


# --------------------------------------------------------------------------- lifecycle
@register("message_routing", "SELECT message_id, thread_key, target_root, target_folder FROM routing")
def q_message_routing(spark, sf):
    return job(spark, sf).routes


@register("find_thread", f"""
SELECT s.thread_key, s.thread_name, r.target_root, r.target_folder,
       contains(r.target_folder, s.thread_name) AS name_in_folder,
       (SELECT min(a.target_folder) FROM routing a
        WHERE a.target_root = '{C.ACTIVE_ROOT}' AND contains(a.target_folder, s.thread_name)) AS found_folder
FROM scored s LEFT JOIN (SELECT DISTINCT thread_key, target_root, target_folder FROM routing) r USING (thread_key)""")
def q_find_thread(spark, sf):
    j = job(spark, sf)
    return LC.find_thread(j.facts)


def existing_job(spark, sf) -> ThreadJob:
    def make():
        j = job(spark, sf)
        stored = LC.stored_messages(j.features, j.facts)
        return ThreadJob.from_features(LC.existing_scan(stored), P.with_(excluded_folders=()), min_messages=1)
    return kept(spark, sf, "existing", make)


@register("existing_threads", """
SELECT thread_key, conversation_id, thread_name, email_count, participant_count, start_date, end_date,
       duration_days, total_attachments, is_urgent, has_delay, is_transport, is_customs FROM ex_meta""")
def q_existing_threads(spark, sf):
    return existing_job(spark, sf).scored.select(
        "thread_key", "conversation_id", "thread_name", "email_count", "participant_count", "start_date",
        "end_date", "duration_days", "total_attachments", "is_urgent", "has_delay", "is_transport", "is_customs")


def _tree(spark, sf, name: str, messages: Callable) -> str:
    """Messages written as folder directories, once per input."""
    return kept(spark, sf, name, lambda: MS.write_message_tree(messages(), scratch_path(spark, name)))


@register("folder_tree_scan", "SELECT message_id, folder, length(body) AS body_chars FROM kept")
def q_folder_tree_scan(spark, sf):
    """S1 + F1 over directories ``folder=<name>``: excluded folders are never opened."""
    path = _tree(spark, sf, "mailbox-tree", lambda: messages_from_conversations(spark, sf))
    return MS.read_message_tree(spark, path, P.excluded_folders).select(
        "message_id", "folder", F.length("body").cast("bigint").alias("body_chars"))


@register("existing_tree_threads", """
SELECT thread_key, conversation_id, thread_name, email_count, participant_count, start_date, end_date,
       duration_days, total_attachments, is_urgent, has_delay, is_transport, is_customs FROM ex_meta""")
def q_existing_tree_threads(spark, sf):
    """S2 + F2 + F3 over the folders as they lie: the routed messages of the active root as one directory per
    thread, scanned again with their bodies; each directory is a thread."""
    def routed():
        j = job(spark, sf)
        targets = j.routes.where(F.col("target_root") == C.ACTIVE_ROOT).select("message_id", "target_folder")
        return j.kept.join(targets, "message_id").withColumn("folder", F.col("target_folder"))
    found = FE.mail_only(MS.read_message_tree(spark, _tree(spark, sf, "threads-tree", routed))).withColumn(
        "conversation_id", F.coalesce("conversation_id", "folder"))
    ej = ThreadJob(found, P.with_(excluded_folders=()), key="folder", min_messages=1)
    return ej.scored.select("thread_key", "conversation_id", "thread_name", "email_count", "participant_count", "start_date",
                            "end_date", "duration_days", "total_attachments", "is_urgent", "has_delay", "is_transport", "is_customs")


@register("mode_both", """
SELECT conversation_id, thread_name, email_count, mode FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY run DESC, thread_name) AS r FROM (
    SELECT conversation_id, thread_name, email_count, 'new' AS mode, 1 AS run FROM meta
    UNION ALL SELECT conversation_id, thread_name, email_count, 'existing', 2 FROM ex_meta)) WHERE r = 1""")
def q_mode_both(spark, sf):
    return LC.mode_both(job(spark, sf).meta, existing_job(spark, sf).meta)


@register("reply_queue", f"""
SELECT thread_key, 'Re: ' || thread_name AS subject, last_sender_address AS "to",
       CASE WHEN length(coalesce(last_cc, '')) > 0 THEN last_cc END AS cc,
       CASE WHEN response_needed AND reply_template <> {O.q(C.NO_REPLY)} THEN reply_template
            ELSE {O.basic_reply_sql()} END AS body
FROM attention""")
def q_reply_queue(spark, sf):
    j = job(spark, sf)
    return LC.reply_queue(j.attention, j.summary)


@register("followup_marks", f"""
SELECT r.thread_key, r.message_id, '{C.FOLLOWUP_REQUEST}' AS flag_request, {C.FOLLOWUP_STATUS} AS flag_status
FROM routing r JOIN msgs m USING (message_id)
WHERE r.target_root = '{C.ACTIVE_ROOT}' AND m.item_class = {C.MAIL_ITEM_CLASS}
  AND r.thread_key IN (SELECT thread_key FROM attention)""")
def q_followup_marks(spark, sf):
    j = job(spark, sf)
    return LC.followup_marks(j.envelope, j.attention)


PREVIOUS_RUN_DAYS = 30


@register("archive_transition", f"""
SELECT folder, days_since_last,
       CASE WHEN email_count % 5 = 0 THEN 'no metadata' WHEN email_count % 7 = 3 THEN 'no end date'
            WHEN days_since_last > {P.archive_days} AND email_count % 2 = 0 THEN 'exists'
            WHEN days_since_last > {P.archive_days} THEN 'moved' ELSE 'kept' END AS outcome
FROM (SELECT {O.slug_sql('thread_name', 'conversation_id')} AS folder, email_count,
             CASE WHEN email_count % 5 <> 0 AND email_count % 7 <> 3 THEN {O.days(O.AS_OF, 'end_time')} END AS days_since_last,
             {O.days(f"({O.AS_OF} - INTERVAL {PREVIOUS_RUN_DAYS} DAY)", 'end_time')} > {P.archive_days} AS was_archived
      FROM meta) WHERE NOT was_archived""")
def q_archive_transition(spark, sf):
    """Threads stored in the active root by a run PREVIOUS_RUN_DAYS days earlier, re-checked now.  Some
    folders have lost their metadata or its end date, some lie in the archive already."""
    prev = P.as_of - timedelta(days=PREVIOUS_RUN_DAYS)
    s = job(spark, sf).facts.select(
        X.slug("thread_name", "conversation_id").alias("folder"), "end_date", "email_count",
        (X.whole_days(X.ntz_literal(prev), "end_time") > P.archive_days).alias("was_archived"))
    active = s.filter(~F.col("was_archived"))
    metadata = active.filter("email_count % 5 <> 0").select(
        "folder", F.when(F.col("email_count") % 7 != 3, F.col("end_date")).alias("end_date"))
    archive = s.filter("was_archived OR email_count % 2 = 0").select("folder")
    return LC.archive_transition(active.select("folder"), metadata, archive, P)


@register("archive_applied", f"""
, before AS (
  SELECT thread_key, {O.slug_sql('thread_name', 'conversation_id')} AS folder, email_count, end_date,
         {O.days(O.AS_OF, 'end_time')} AS days_now,
         {O.days(f"({O.AS_OF} - INTERVAL {PREVIOUS_RUN_DAYS} DAY)", 'end_time')} > {P.archive_days} AS was_archived
  FROM meta)
SELECT thread_key, folder, 'active' AS stored_as,
       CASE WHEN email_count % 5 <> 0 AND email_count % 7 <> 3 AND days_now > {P.archive_days} AND email_count % 2 = 1
            THEN '{C.ARCHIVE_ROOT}' ELSE '{C.ACTIVE_ROOT}' END AS root,
       email_count % 5 <> 0 AS has_metadata FROM before WHERE NOT was_archived
UNION ALL
SELECT thread_key, folder, 'archive', '{C.ARCHIVE_ROOT}', true FROM before WHERE was_archived OR email_count % 2 = 0""")
def q_archive_applied(spark, sf):
    """J8 applied to a store of a run PREVIOUS_RUN_DAYS earlier (some folders without metadata or end date,
    some in the archive already), twice; the store as it is read back."""
    path = scratch_path(spark, "archived-store")
    prev = P.as_of - timedelta(days=PREVIOUS_RUN_DAYS)
    j = job(spark, sf)
    s = j.with_participants(j.scored).withColumns({
        "folder": X.slug("thread_name", "conversation_id"),
        "was_archived": X.whole_days(X.ntz_literal(prev), "end_time") > P.archive_days,
        "end_date": F.when(F.col("email_count") % 7 != 3, F.col("end_date"))})
    record = ST.metadata_json()
    active = s.where("NOT was_archived").select(
        "folder", "thread_key", F.when(F.col("email_count") % 5 != 0, record).alias("metadata_json"),
        F.lit("active").alias("summary_markdown"), F.lit(C.ACTIVE_ROOT).alias("root"))
    archive = s.where("was_archived OR email_count % 2 = 0").select(
        "folder", "thread_key", record.alias("metadata_json"), F.lit("archive").alias("summary_markdown"),
        F.lit(C.ARCHIVE_ROOT).alias("root"))
    V.create_store(active.unionByName(archive), path)
    for _ in range(2):
        V.apply_archive(spark, path, P)
    return V.read_rows(spark, path).select("thread_key", "folder", F.col("summary_markdown").alias("stored_as"), "root",
                                           F.col("metadata_json").isNotNull().alias("has_metadata"))


REJECTED_THREADS_SQL = """SELECT coalesce(conversation_id, chr(0)) FROM msgs
                               WHERE received_time IS NULL OR message_id IS NULL"""


def rejected_threads(j: ThreadJob) -> DataFrame:
    return j.rejects.select(F.coalesce(F.col("conversation_id"), F.lit(FE.THREAD_KEY_NULL)).alias("thread_key")).distinct()


@register("fallback_summary", f"""
SELECT thread_key, '{C.METHOD_FALLBACK}' AS method, thread_name, 'Thread with ' || email_count::VARCHAR || ' emails'
       AS executive_summary, 'Thread started ' || start_date AS key_events,
       array_to_string(participants, ' | ') AS stakeholders, '{C.FALLBACK_STATUS}' AS current_status,
       next_action, priority_score::BIGINT AS priority_score, priority_level, reply_template
FROM summary WHERE thread_key IN ({REJECTED_THREADS_SQL})""", adapter=O.FAULTY_ADAPTER)
def q_fallback_summary(spark, sf):
    j = faulty_job(spark, sf)
    return LC.fallback_summary(j.with_participants(j.summary).join(rejected_threads(j), "thread_key", "left_semi"))


@register("faulty_thread_metadata", f"SELECT {META_COLS_SQL} FROM meta", adapter=O.FAULTY_ADAPTER)
def q_faulty_thread_metadata(spark, sf):
    """A2 where some messages lack a sender or a conversation id (one thread of its own)."""
    j = faulty_job(spark, sf)
    return meta_cols(j.with_participants(j.scored))


@register("run_stats", f"""
SELECT (SELECT count(*) FROM meta) AS threads_found, (SELECT count(*) FROM meta) AS threads_processed,
       (SELECT count(*) FROM routing) AS emails_moved, (SELECT count(*) FROM md) AS summaries_created,
       (SELECT count(DISTINCT thread_key) FROM kf) AS timelines_created,
       (SELECT count(*) FROM msgs WHERE received_time IS NULL OR message_id IS NULL) AS errors,
       (SELECT count(*) FROM attention) AS reviewed,
       (SELECT count(*) FROM attention) AS drafts,
       (SELECT count(*) FROM attention) - (SELECT count(*) FROM attention) AS skipped""")
def q_run_stats(spark, sf):
    """Every output written; the counts are those of the writing passes."""
    return RUN.stats_frame(spark, RUN.run(job(spark, sf), scratch_path(spark, "run")))


@register("faulty_run_stats", f"""
SELECT (SELECT count(*) FROM meta) AS threads_found, (SELECT count(*) FROM meta) AS threads_processed,
       (SELECT count(*) FROM routing) AS emails_moved, (SELECT count(*) FROM md) AS summaries_created,
       (SELECT count(DISTINCT thread_key) FROM kf) AS timelines_created,
       (SELECT count(*) FROM ({O.FAULTY_ADAPTER}) WHERE received_time IS NULL OR message_id IS NULL) AS errors,
       (SELECT count(*) FROM attention) AS reviewed, (SELECT count(*) FROM attention) AS drafts,
       0::BIGINT AS skipped""", adapter=O.FAULTY_ADAPTER)
def q_faulty_run_stats(spark, sf):
    """The same where messages lack a time or an id: errors are counted as they are set aside."""
    return RUN.stats_frame(spark, RUN.run(faulty_job(spark, sf), scratch_path(spark, "run")))


# --------------------------------------------------------------------------- store round trips
def _store(spark, sf) -> str:
    def make():
        j = job(spark, sf)
        md = j.with_participants(j.markdown).withColumn("folder", X.slug("thread_name", "conversation_id"))
        return ST.write_store(md, scratch_path(spark, "thread-store"))
    return kept(spark, sf, "store", make)


@register("metadata_json", """
SELECT thread_key, to_json({'conversation_id': conversation_id, 'thread_name': thread_name,
  'email_count': email_count, 'participants': participants, 'participant_count': participant_count,
  'start_date': start_date, 'end_date': end_date, 'duration_days': duration_days,
  'total_attachments': total_attachments, 'is_urgent': is_urgent, 'has_delay': has_delay,
  'is_transport': is_transport, 'is_customs': is_customs})::VARCHAR AS metadata_json FROM meta""")
def q_metadata_json(spark, sf):
    j = job(spark, sf)
    return j.with_participants(j.scored).select("thread_key", ST.metadata_json().alias("metadata_json"))


@register("metadata_roundtrip", f"SELECT {META_COLS_SQL} FROM meta")
def q_metadata_roundtrip(spark, sf):
    return meta_cols(ST.read_store(spark, _store(spark, sf), root=None))


@register("review_load", f"""
SELECT thread_key, thread_name, ps AS priority_score, rn AS response_needed, rt AS reply_template,
       (ps >= {P.attention_score} OR rn OR is_urgent) AS requires_attention
FROM (SELECT *, {PARSE_PRIORITY_SQL} AS ps, contains(summary_markdown, '{C.RESPONSE_MARKER}') AS rn,
             {PARSE_REPLY_SQL} AS rt FROM md WHERE NOT is_archived)""")
def q_review_load(spark, sf):
    st = ST.read_store(spark, _store(spark, sf), root=C.ACTIVE_ROOT)
    doc = F.col("summary_text")
    ps = R.parse_priority(doc)
    rn = R.response_marker(doc)
    return st.select("thread_key", "thread_name", ps.alias("priority_score"), rn.alias("response_needed"),
                     R.parse_reply(doc).alias("reply_template"),
                     ((ps >= P.attention_score) | rn | F.coalesce(F.col("is_urgent"), F.lit(False)))
                     .alias("requires_attention"))


# --------------------------------------------------------------------------- model hook
# the stand-in model cuts its single-spaced input at 150 characters, back to a space
_SPACED_SQL = O.strip("regexp_replace(model_input, '" + O.WS_RE + "', ' ', 'g')")
MODEL_TEXT_SQL = f"""
CASE WHEN length({_SPACED_SQL}) <= {M.MAX_SUMMARY_CHARS} THEN {_SPACED_SQL}
     WHEN contains(left({_SPACED_SQL}, {M.MAX_SUMMARY_CHARS}), ' ')
     THEN regexp_replace(left({_SPACED_SQL}, {M.MAX_SUMMARY_CHARS}), ' [^ ]*$', '')
     ELSE left({_SPACED_SQL}, {M.MAX_SUMMARY_CHARS}) END"""
MODEL_SQL = f"""
(SELECT thread_key, {MODEL_TEXT_SQL} AS model_summary FROM ({ORACLE_MODEL_INPUT}))"""


@register("model_summary", f"SELECT thread_key, model_summary FROM {MODEL_SQL}")
def q_model_summary(spark, sf):
    return job(spark, sf).model_summaries()


@register("summary_method", f"""
SELECT s.thread_key,
       CASE WHEN s.thread_key IN ({REJECTED_THREADS_SQL}) THEN '{C.METHOD_FALLBACK}'
            WHEN m.model_summary IS NOT NULL THEN '{P.model_label}' ELSE '{C.METHOD_RULES}' END AS method,
       CASE WHEN s.thread_key IN ({REJECTED_THREADS_SQL}) THEN 'Thread with ' || s.email_count::VARCHAR || ' emails'
            WHEN m.model_summary IS NOT NULL THEN m.model_summary ELSE s.executive_summary END AS executive_summary
FROM summary s LEFT JOIN {MODEL_SQL} m USING (thread_key)""", adapter=O.FAULTY_ADAPTER)
def q_summary_method(spark, sf):
    """M2 over messages with faults: fallback for threads with rejected messages, else the model's
    text, else the rules."""
    j = faulty_job(spark, sf)
    bad = rejected_threads(j)
    return M.summary_method(j.summary, j.model_summaries(), P.model_label, bad) \
        .select("thread_key", "method", "executive_summary")


# --------------------------------------------------------------------------- long multilingual texts
from ..sources.messages import messages_from_documents  # noqa: E402


def doc_job(spark, sf) -> ThreadJob:
    return kept(spark, sf, "documents", lambda: ThreadJob(messages_from_documents(spark, sf), P))


@register("document_summary", f"SELECT {SUMMARY_SQL} FROM summary", adapter=O.DOCUMENT_ADAPTER)
def q_document_summary(spark, sf):
    """X23 over the documents table: 20 threads of long multi-line texts in four languages."""
    return summary_cols(doc_job(spark, sf).summary)


@register("document_clean_body", "SELECT message_id, clean_body FROM cb", adapter=O.DOCUMENT_ADAPTER)
def q_document_clean_body(spark, sf):
    """X18 over whole documents (up to tens of thousands of characters)."""
    m = messages_from_documents(spark, sf)
    return m.select("message_id", X.clean_body(F.coalesce(F.col("body"), F.lit(""))).alias("clean_body"))


# --------------------------------------------------------------------------- keywords of several words
from ..sources.messages import messages_from_events  # noqa: E402

# within a body, across subject and body, from one message into the next, and over a whole short message
PHRASES = {"is_urgent": ("this is urgent", "j. re: plan"), "has_delay": ("week 3 dear all", "j. fwd: care: order"),
           "is_transport": ("loading dock", "j. re: load", "7 the truck"), "is_customs": ("for customs clearance", "j. a very long")}
EVENT_PHRASES = {"is_urgent": ('5} event click {"k": 7',), "has_delay": ('} event view {"k": 26} event',),
                 "is_transport": ('} event view {"k": 2} event view {"k": 2',), "is_customs": ("loading dock", "error {")}


def with_phrases(p, extra: dict):
    from ..operators.phrases import FLAGS
    return p.with_(**{name: getattr(p, name) + extra[flag] for flag, name in FLAGS.items()})


def _phrase_sql(extra: dict) -> str:
    """The flags of the words, or a keyword with spaces anywhere in the thread's whole text."""
    flags = ", ".join(f"m.{flag} OR {O.any_in('t.text', kws)} AS {flag}" for flag, kws in extra.items())
    return f"""SELECT m.thread_key, {flags} FROM meta m JOIN (
  SELECT thread_key, lower(string_agg(subject || ' ' || body, ' ' ORDER BY received_time, message_id)) AS text
  FROM kf GROUP BY thread_key) t USING (thread_key)"""


@register("phrase_flags", _phrase_sql(PHRASES))
def q_phrase_flags(spark, sf):
    """X3 with keywords that hold spaces, over the conversations."""
    j = ThreadJob(messages_from_conversations(spark, sf), with_phrases(P, PHRASES))
    return j.meta.select("thread_key", *PHRASES)


@register("event_phrase_flags", _phrase_sql(EVENT_PHRASES), adapter=O.EVENTS_ADAPTER)
def q_event_phrase_flags(spark, sf):
    """The same over the events: long threads of short messages, keywords that hold whole messages."""
    j = ThreadJob(messages_from_events(spark, sf), with_phrases(P, EVENT_PHRASES))
    return j.meta.select("thread_key", *EVENT_PHRASES)


# --------------------------------------------------------------------------- high-volume threads

def event_job(spark, sf) -> ThreadJob:
    return kept(spark, sf, "events", lambda: ThreadJob(messages_from_events(spark, sf), P))


@register("event_thread_scores", """
SELECT thread_key, email_count, participant_count, start_date, end_date, duration_days, days_since_last,
       priority_score, priority_level, array_to_string(priority_factors, ' | ') AS factors, current_status,
       next_action FROM scored""", adapter=O.EVENTS_ADAPTER)
def q_event_thread_scores(spark, sf):
    """X5-X9, X12 over the events table: ~65 messages per user thread, microsecond times,
    so the volume rule (more than 10 messages) and fractional ISO dates are exercised."""
    return event_job(spark, sf).scored.select(
        "thread_key", "email_count", "participant_count", "start_date", "end_date", "duration_days",
        "days_since_last", "priority_score", "priority_level", joined("priority_factors").alias("factors"),
        "current_status", "next_action")


SERIES_POINTS = 5


@register("event_sender_series", f"""
SELECT thread_key, sender, left(sender, {C.LEGEND_CHARS}) AS series_name, chunk, string_agg(y::VARCHAR, ' | ' ORDER BY y) AS y,
       string_agg(x, ' | ' ORDER BY y) AS x, string_agg('Email ' || (y + 1)::VARCHAR, ' | ' ORDER BY y) AS text,
       string_agg(subject, ' | ' ORDER BY y) AS subject, string_agg(hover, ' | ' ORDER BY y) AS hover_text
FROM (SELECT *, (row_number() OVER (PARTITION BY thread_key, sender ORDER BY y) - 1) // {SERIES_POINTS} AS chunk
      FROM (SELECT thread_key, sender, subject, rn - 1 AS y, {O.minute('received_time')} AS x,
                   '<b>' || sender || '</b><br>' || subject || '<br>' || {O.minute('received_time')} || '<br><i>'
                   || left(body, {C.HOVER_CHARS}) || '...</i>' AS hover FROM kf))
GROUP BY thread_key, sender, chunk""", adapter=O.EVENTS_ADAPTER)
def q_event_sender_series(spark, sf):
    """A9 over the events: senders write many messages in a thread; arrays of at most SERIES_POINTS points."""
    s = OUT.sender_series_chunks(event_job(spark, sf).sequenced, SERIES_POINTS)
    return s.select("thread_key", "sender", "series_name", "chunk", F.array_join(F.transform("y", lambda v: v.cast("string")), " | ").alias("y"),
                    *[joined(c).alias(c) for c in ("x", "text", "subject", "hover_text")])


def busy_job(spark, sf) -> ThreadJob:
    return kept(spark, sf, "busy-events", lambda: ThreadJob(MS.messages_from_busy_events(spark, sf), P))


def _busy(name: str, sql: str, fn) -> None:
    """The same output over the events as busy threads: senders repeat and every cap is passed."""
    register(f"busy_{name}", sql, adapter=O.BUSY_ADAPTER)(lambda spark, sf: fn(busy_job(spark, sf)))


_busy("thread_events", "SELECT thread_key, event_rank, event FROM events",
      lambda j: j.events.select("thread_key", F.col("event_rank").cast("bigint"), "event"))
_busy("stakeholders", "SELECT thread_key, stakeholder_rank, stakeholder FROM stakeholders",
      lambda j: j.stakeholders.select("thread_key", F.col("stakeholder_rank").cast("bigint"), "stakeholder"))
_busy("sender_counts", f"""
SELECT thread_key, sender, count(*) AS n_emails, {O.iso('min(received_time)')} AS first_seen FROM kf GROUP BY thread_key, sender""",
      lambda j: j.sender_counts.select("thread_key", "sender", "n_emails", X.iso_text(F.col("first_ord.received_time")).alias("first_seen")))
_busy("action_items", "SELECT thread_key, item_rank, action_item FROM action_items",
      lambda j: j.action_items.select("thread_key", F.col("item_rank").cast("bigint"), "action_item"))
_busy("key_points", "SELECT thread_key, point_rank, key_point FROM key_points",
      lambda j: j.key_points.select("thread_key", F.col("point_rank").cast("bigint"), "key_point"))
_busy("thread_issues", "SELECT thread_key, issue_rank, issue FROM issues",
      lambda j: j.issues.select("thread_key", F.col("issue_rank").cast("bigint"), "issue"))
_busy("sender_palette", f"SELECT * FROM {PALETTE_SQL}", lambda j: j.palette)
_busy("message_sequence", "SELECT thread_key, message_id, rn AS seq FROM kf",
      lambda j: j.sequenced.select("thread_key", "message_id", "seq"))
_busy("thread_summary", f"SELECT {SUMMARY_SQL} FROM summary", lambda j: summary_cols(j.summary))
