"""Text assembly and parse-back (X20-X22, X25, X27, X30, X32-X35): column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X

L = F.lit


@X.per_session
def reply_template() -> Column:
    """Suggested reply, or the no-response text."""
    body = F.concat(
        L(C.REPLY_SUBJECT), F.col("thread_name"), L("\n\n"), L(C.REPLY_GREETING),
        F.when(F.col("waiting_on").isNotNull(), L(C.REPLY_WAITING))
        .when(F.col("next_action").contains("?"), L(C.REPLY_QUESTION))
        .otherwise(L(C.REPLY_CONFIRM)),
        F.when(F.col("is_urgent"), L(C.REPLY_URGENT)).otherwise(L("")),
        F.when(F.col("has_delay"), L(C.REPLY_DELAY)).otherwise(L("")),
        L(C.REPLY_CLOSING), L(C.REPLY_SIGNOFF))
    return F.when(F.col("response_needed"), body).otherwise(L(C.NO_REPLY))


@X.per_session
def basic_reply() -> Column:
    """Reply used when no stored one exists."""
    return F.concat(L(C.BASIC_REPLY_OPENING),
                    F.when(F.col("is_urgent"), L(C.REPLY_URGENT)).otherwise(L("")),
                    F.when(F.col("has_delay"), L(C.BASIC_REPLY_DELAY)).otherwise(L("")),
                    L(C.REPLY_CLOSING), L(C.REPLY_SIGNOFF))


@X.per_session
def executive_summary() -> Column:
    """Overview sentence, urgency/delay sentences, issue count (after the cap)."""
    issues = F.col("issues")
    return F.concat_ws(
        " ",
        F.concat(L("Email thread '"), F.col("thread_name"), L("' with "), F.col("email_count").cast("string"),
                 L(" emails over "), F.col("duration_days").cast("string"), L(" days involving "),
                 F.col("participant_count").cast("string"), L(" participants.")),
        F.when(F.col("is_urgent"), L("Thread contains URGENT items.")),
        F.when(F.col("has_delay"), L("Thread discusses delays.")),
        F.when(F.size(issues) > 0, F.concat(L("Identified "), F.size(issues).cast("string"),
                                           L(" potential issues requiring attention."))))


def _section(cond: Column, text: Column) -> Column:
    return F.when(cond, text).otherwise(L(""))


def _bullets(arr: str, prefix: str = "- ") -> Column:
    return X.bullet_list(F.col(arr), prefix)


@X.per_session
def summary_markdown() -> Column:
    """The rendered summary document; empty sections omitted; model rows carry
    no priority, insights or reply section."""
    rules = F.col("method") != L(C.METHOD_MODEL)
    flags = X.labels([(F.col("is_urgent"), f"{C.FLAG_SYMBOLS[0]} {C.FLAG_NAMES[0]}"),
                      (F.col("has_delay"), f"{C.FLAG_SYMBOLS[1]} {C.FLAG_NAMES[1]}"),
                      (F.col("is_transport"), f"{C.FLAG_SYMBOLS[2]} {C.FLAG_NAMES[2]}"),
                      (F.col("is_customs"), f"{C.FLAG_SYMBOLS[3]} {C.FLAG_NAMES[3]}")])
    emoji = F.coalesce(F.element_at(F.create_map(*[x for k, v in C.LEVEL_EMOJI.items() for x in (L(k), L(v))]),
                                    F.col("priority_level")), L(C.LEVEL_EMOJI_OTHER))
    flow = F.array_join(F.transform(F.col("conversation_flow"), lambda m: F.concat(
        L("**"), m["date"], L("** - "), m["sender"], L("\n> "), m["preview"], L("\n\n"))), "")
    return F.concat(
        L("# "), F.col("thread_name"), L("\n\n"),
        L("## Thread Information\n\n"),
        L("- **Emails**: "), F.col("email_count").cast("string"), L("\n"),
        L("- **Participants**: "), F.col("participant_count").cast("string"), L("\n"),
        L("- **Date Range**: "), F.col("start_date"), L(" to "), F.col("end_date"), L("\n"),
        L("- **Duration**: "), F.col("duration_days").cast("string"), L(" days\n"),
        L("- **Attachments**: "), F.col("total_attachments").cast("string"), L("\n\n"),
        _section(F.size(flags) > 0, F.concat(L("**Flags**: "), F.array_join(flags, " | "), L("\n\n"))),
        _section(rules, F.concat(
            L("## "), emoji, L(" Priority: "), F.col("priority_level"), L(" ("),
            F.col("priority_score").cast("string"), L("/100)\n\n"),
            _section(F.size("priority_factors") > 0,
                     F.concat(L("**Priority Factors:**\n"), _bullets("priority_factors"), L("\n"))))),
        L("## Executive Summary\n\n"), F.col("executive_summary"), L("\n\n"),
        L("## Current Status\n\n"), F.col("current_status"), L("\n\n"),
        _section(rules, F.concat(
            L(C.INSIGHTS_HEADING + "\n\n"),
            _section(F.col("response_needed"), L(C.RESPONSE_HEADING + "\n")),
            L("**Next Action**: "), F.col("next_action"), L("\n\n"),
            _section(F.coalesce(F.length("last_responder") > 0, L(False)),
                     F.concat(L("**Last Response From**: "), F.col("last_responder"), L("\n\n"))),
            _section(F.coalesce(F.length("waiting_on") > 0, L(False)),
                     F.concat(L("**Waiting On**: "), F.col("waiting_on"), L("\n\n"))),
            _section(F.size("conversation_flow") > 0, F.concat(L("### Recent Conversation Flow\n\n"), flow)),
            _section(F.size("key_points") > 0,
                     F.concat(L("### Key Discussion Points\n\n"), _bullets("key_points"), L("\n"))))),
        _section(F.size("key_events") > 0, F.concat(L("## Key Events\n\n"), _bullets("key_events"), L("\n"))),
        _section(F.size("stakeholders") > 0, F.concat(L("## Stakeholders\n\n"), _bullets("stakeholders"), L("\n"))),
        _section(F.size("action_items") > 0,
                 F.concat(L("## Action Items\n\n"), _bullets("action_items", "- [ ] "), L("\n"))),
        _section(F.size("issues") > 0,
                 F.concat(L("## Issues & Risks\n\n"), _bullets("issues", f"- {C.ISSUE_MARK} "), L("\n"))),
        _section(rules & (F.col("reply_template") != L(C.NO_REPLY)),
                 F.concat(L(C.REPLY_HEADING + "\n\n```\n"), F.col("reply_template"), L("\n```\n\n"))),
        L("\n---\n*Summary generated using "), F.col("method"), L(" method*\n"),
    )


def parse_priority(doc: Column) -> Column:
    """Score from the first line holding 'Priority:' and '(' (text between '(' and '/'); else 0."""
    lines = F.split(doc, "\n", -1)
    line = F.try_element_at(F.filter(lines, lambda x: x.contains("Priority:") & x.contains("(")), L(1))
    part = F.split_part(F.split_part(line, L("("), L(2)), L("/"), L(1))
    return F.coalesce(X.strip(part).try_cast("bigint"), L(0).cast("bigint"))


def parse_reply(doc: Column) -> Column:
    """Reply text between the reply heading's opening and closing fence; '' if absent."""
    pat = "(?s)" + C.REPLY_HEADING + r"\s*```\n(.*?)\n```"
    return F.coalesce(X.strip(F.regexp_extract(doc, pat, 1)), L(""))


def executive_excerpt(doc: Column) -> Column:
    """Second line after '## Executive Summary', stripped, first 200 chars + '...'; NULL if empty."""
    lines = F.split(doc, "\n", -1)
    idx = F.array_position(F.transform(lines, lambda x: x.contains("## Executive Summary")), L(True))
    line = F.when((idx > 0) & (idx + 2 <= F.size(lines)), F.element_at(lines, (idx + 2).cast("int")))
    ex = X.strip(line)
    return F.when(F.length(ex) > 0, F.concat(F.left(ex, L(C.EXCERPT_CHARS)), L("...")))


def response_marker(doc: Column) -> Column:
    """X35: 'Response Needed' anywhere in the rendered text."""
    return doc.contains(C.RESPONSE_MARKER)


def stats_text() -> Column:
    """The four-line stats box."""
    return F.concat(L("Total Emails: "), F.col("email_count").cast("string"),
                    L("\nParticipants: "), F.col("participant_count").cast("string"),
                    L("\nDuration: "), F.col("duration_days").cast("string"),
                    L(" days\nAttachments: "), F.col("total_attachments").cast("string"))


def _line(no, text) -> Column:
    return F.struct(no.cast("bigint").alias("line_no"), text.alias("line"))


def timeline_lines(meta: DataFrame, seq_features: DataFrame) -> DataFrame:
    """X27/X30 as numbered lines (thread_key, line_no, line): header, three lines per
    message ('[date] sender', cleaned snippet, blank), footer.  A thread's text is its
    lines in ``line_no`` order joined by LF; no thread is concatenated in one task."""
    rule = "=" * C.RULE_WIDTH
    header = meta.select("thread_key", F.explode(F.array(
        _line(L(1), F.concat(L("TIMELINE: "), F.col("thread_name"))),
        _line(L(2), L(rule)),
        _line(L(3), L("")))).alias("x")).select("thread_key", "x.line_no", "x.line")
    base = F.lit(3) + (F.col("seq") - 1) * 3
    msgs = seq_features.select("thread_key", F.explode(F.array(
        _line(base + 1, F.concat(L("["), X.minute_text("received_time"), L("] "), F.col("sender"))),
        _line(base + 2, F.col("clean_snippet")),
        _line(base + 3, L("")))).alias("x")).select("thread_key", "x.line_no", "x.line")
    # footer: the rule, then the four-line stats box
    footer = meta.select("thread_key", "email_count",
                         F.posexplode(F.split(F.concat(L(rule + "\n"), stats_text()), "\n", -1)).alias("i", "line"))
    footer = footer.select("thread_key", (F.lit(4) + F.col("email_count") * 3 + F.col("i")).cast("bigint")
                           .alias("line_no"), "line")
    return header.unionByName(msgs).unionByName(footer)
