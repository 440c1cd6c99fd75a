"""Run parameters and the fixed values every operator reads.

The keyword lists, phrase lists and output texts below are FIXED VALUES:
they must stay exactly as written (order included) for results to match
the analysed mailbox tool.  Everything else is a tunable parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

# ---------------------------------------------------------------------------
# FIXED VALUES (keyword lists, phrases, thresholds, output texts).
# Matching is always a lower-cased substring test.
# ---------------------------------------------------------------------------
KEYWORDS_URGENT = ("urgent", "asap", "emergency", "critical", "immediate")
KEYWORDS_DELAY = ("delay", "delayed", "postponed", "late", "waiting")
KEYWORDS_TRANSPORT = ("truck", "driver", "transport", "delivery", "shipment", "pickup", "arrival")
KEYWORDS_CUSTOMS = ("customs", "carinska", "border", "clearance")
# issue keywords: delay list, then urgent list, then these six (order matters)
ISSUE_EXTRA_WORDS = ("problem", "issue", "error", "mistake", "wrong", "missing")
ACTION_WORDS = ("please", "need", "required", "must", "should", "confirm", "send", "provide")
SCORE_RESPONSE_PHRASES = ("?", "please confirm", "can you", "need your")
INSIGHT_RESPONSE_PHRASES = (
    "?", "please confirm", "can you", "could you", "would you",
    "need your", "waiting for", "please provide", "please send",
)
WAITING_PHRASES = ("waiting for", "waiting on", "pending", "awaiting")
IMPORTANT_WORDS = (
    "decision", "agreed", "confirmed", "approved", "rejected",
    "issue", "problem", "solution", "action", "deadline",
)
GREETINGS = (
    "dear all", "dear team", "hi all", "hello all", "hi team", "hello team",
    "dear", "hi", "hello", "good morning", "good afternoon", "good evening",
    "greetings", "hey",
)
SIGNATURES = (
    "best regards", "kind regards", "regards", "thank you", "thanks",
    "sincerely", "cheers", "best", "br", "rgds", "thx",
    "os melhores cumprimento", "srdačan pozdrav", "mit freundlichen grüßen",
    "cordialement", "saludos", "atentamente",
)
SUBJECT_PREFIXES = ("RE:", "FW:", "FWD:", "Re:", "Fw:", "Fwd:")
FOLDER_INVALID_CHARS = "/\\:*?\"<>|"
RULE_LINE_CHARS = "_ -=*#"
MAIL_ITEM_CLASS = 43
FOLLOWUP_REQUEST = "Follow up"
FOLLOWUP_STATUS = 2
ACTIVE_ROOT = "threads"
ARCHIVE_ROOT = "archive"

# priority score weights and level bands
SCORE_URGENT = 30
SCORE_RESPONSE = 25
SCORE_RECENT = 20
SCORE_STALE = -10
SCORE_PARTICIPANTS = 10
SCORE_DELAY = 15
SCORE_VOLUME = 10
SCORE_CUSTOMS = 5
SCORE_TRANSPORT = 5
RECENT_DAYS_BELOW = 2
STALE_DAYS_ABOVE = 7
PARTICIPANTS_ABOVE = 3
VOLUME_ABOVE = 10
LEVEL_BANDS = ((70, "Critical"), (50, "High"), (30, "Medium"))
LEVEL_DEFAULT = "Low"
LEVEL_EMOJI = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢"}
LEVEL_EMOJI_OTHER = "⚪"

# priority factor texts, in rule order
FACTOR_URGENT = "Contains urgent keywords"
FACTOR_RESPONSE = "Response/action required"
FACTOR_RECENT = "Recent activity (< 2 days)"
FACTOR_STALE = "No recent activity (> 7 days)"
FACTOR_PARTICIPANTS = "Multiple stakeholders involved"
FACTOR_DELAY = "Contains delay indicators"
FACTOR_VOLUME = "High email volume (active discussion)"
FACTOR_CUSTOMS = "Customs-related"
FACTOR_TRANSPORT = "Transport-related"

# next-action texts
NEXT_WAITING = "Waiting on external party"
NEXT_RESPONSE = "Response required - question or request in last email"
NEXT_FOLLOW_UP = "Follow up - no activity for {days} days"
NEXT_MONITOR = "Monitor - no immediate action required"
NEXT_UNKNOWN = "Unknown"
WAITING_PREFIX = "Check email: "
WAITING_SUFFIX = "..."

# reply texts
NO_REPLY = "No response required at this time."
REPLY_SUBJECT = "Subject: Re: "
REPLY_GREETING = "Hi team,\n\n"
REPLY_WAITING = ("Thank you for your patience. "
                 "I'm following up on the pending items mentioned in the thread.\n\n")
REPLY_QUESTION = ("Thank you for your email. "
                  "I'd like to address your questions:\n\n"
                  "[Answer the specific questions from the last email]\n\n")
REPLY_CONFIRM = ("Thank you for the update. "
                 "I wanted to confirm the following:\n\n"
                 "[Provide your confirmation or update]\n\n")
REPLY_URGENT = "I understand this is urgent and will prioritize accordingly.\n\n"
REPLY_DELAY = "Regarding the delay mentioned, [provide status update or resolution].\n\n"
REPLY_CLOSING = "Please let me know if you need any additional information.\n\n"
REPLY_SIGNOFF = "Best regards,\n[Your name]"
BASIC_REPLY_OPENING = "Hi team,\n\nThank you for the update on this thread.\n\n"
BASIC_REPLY_DELAY = "Regarding the delay mentioned, I will look into this and provide an update.\n\n"

# suggested actions
ACTION_REPLY = "Reply to last email (template available)"
ACTION_URGENT = "Urgent: Prioritize immediate response"
ACTION_DELAY = "Address delay concerns mentioned in thread"
ACTION_HIGH = "High priority: Schedule time to handle today"
ACTION_LONG = "Long-running thread: Consider escalation or closure"
ACTION_MONITOR = "Monitor for updates"

# flag labels
FLAG_NAMES = ("URGENT", "DELAY", "TRANSPORT", "CUSTOMS")
FLAG_SYMBOLS = ("🔴", "⏰", "🚚", "📋")
RESPONSE_FLAG = "⚠️ RESPONSE NEEDED"
ISSUE_MARK = "⚠️"
RESPONSE_HEADING = "### ⚠️ Response Needed"
INSIGHTS_HEADING = "## 💡 Conversation Insights"
REPLY_HEADING = "## 📧 Suggested Reply Template"
RESPONSE_MARKER = "Response Needed"

# other texts
UNKNOWN_SENDER = "Unknown"
FALLBACK_STATUS = "Unable to analyze"
FALLBACK_NEXT_ACTION = "Review thread manually"
METHOD_RULES = "rule_based"
METHOD_MODEL = "model"
METHOD_FALLBACK = "fallback"
REPORT_TITLE = "THREAD SUMMARY REPORT"
RULE_WIDTH = 80

# list caps
CAP_EVENTS = 10
CAP_STAKEHOLDERS = 10
CAP_ACTIONS = 5
CAP_KEY_POINTS = 5
CAP_ISSUES = 5
ACTION_MESSAGES = 3
FLOW_MESSAGES = 5
KEY_POINT_MAX_LEN = 150
ISSUE_MAX_LEN = 200
ACTION_LINE_MAX_LEN = 200
PREVIEW_CHARS = 150
HOVER_CHARS = 200
SNIPPET_CHARS = 300
CLEAN_SNIPPET_CHARS = 200
MODEL_INPUT_CHARS = 1000
WAITING_CHARS = 80
GREETING_MAX_LEN = 50
SIGNATURE_MAX_LEN = 50
SLUG_NAME_CHARS = 50
SLUG_ID_CHARS = 8
GANTT_TASK_CHARS = 30
GANTT_RESOURCE_CHARS = 50
POINT_SENDER_CHARS = 20
POINT_SUBJECT_CUT = 50
POINT_SUBJECT_CHARS = 40
LEGEND_CHARS = 30
EXCERPT_CHARS = 200


# Python's str.strip()/str.split() whitespace: every character with isspace() true (rule-built).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def issue_keywords() -> tuple[str, ...]:
    """Issue keywords in search order: delay list, urgent list, extra words."""
    return KEYWORDS_DELAY + KEYWORDS_URGENT + ISSUE_EXTRA_WORDS


def parse_folder_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated folder names -> trimmed tuple; empty input -> ()."""
    if not text or not text.strip():
        return ()
    return tuple(part.strip() for part in text.split(","))


@dataclass(frozen=True)
class Params:
    """Tunable run parameters.  ``as_of`` replaces the wall clock."""

    as_of: datetime = datetime(2024, 4, 10, 9, 0, 0)
    excluded_folders: tuple[str, ...] = ()
    min_messages: int = 2
    archive_days: int = 60
    attention_score: int = 40
    handle_today_score: int = 60
    long_running_days: int = 7
    report_title: str = REPORT_TITLE
    # label of summaries written by a caller's model
    model_label: str = METHOD_MODEL
    # the report and sheet list threads of the active root only
    report_active_only: bool = True
    keywords_urgent: tuple[str, ...] = KEYWORDS_URGENT
    keywords_delay: tuple[str, ...] = KEYWORDS_DELAY
    keywords_transport: tuple[str, ...] = KEYWORDS_TRANSPORT
    keywords_customs: tuple[str, ...] = KEYWORDS_CUSTOMS
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# Parameters used by the fixtures, tests and the registered queries.
TEST_PARAMS = Params(excluded_folders=parse_folder_list("Customs"))
