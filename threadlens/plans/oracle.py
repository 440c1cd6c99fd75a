"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each rule directly over the generated tables with plain
window functions and list lambdas; it shares only the fixed values with the
Spark code.  ``base_ctes()`` is one CTE chain; each query selects from it
(DuckDB ignores unused CTEs).
"""

from __future__ import annotations

from .. import config as C
from ..config import Params

P = C.TEST_PARAMS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nl(s: str) -> str:
    """SQL string literal that may contain LF."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(x) for x in parts) if len(parts) > 1 else q(s)


WS_CHARS = "".join(f"chr({ord(c)})" if i == 0 else f" || chr({ord(c)})" for i, c in enumerate(C.PY_WHITESPACE))
WS_CLASS = "'[' || " + WS_CHARS + " || ']+'"


# the same characters as a pattern
WS_RE = f"[{C.PY_WHITESPACE}]+"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def any_in(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def first_in(x: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def minute(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M')"


def day(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d')"


def iso(t: str) -> str:
    return (f"(CASE WHEN strftime({t}, '%f') = '000000' THEN strftime({t}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S') || '.' || strftime({t}, '%f') END)")


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def joined(lst: str) -> str:
    return f"array_to_string({lst}, ' | ')"


AS_OF = f"TIMESTAMP '{P.as_of.strftime('%Y-%m-%d %H:%M:%S')}'"

ADAPTER = """
SELECT conv_id * 100 + turn AS message_id,
       lpad(cast(conv_id AS varchar), 8, '0') || '-conv' AS conversation_id,
       CASE WHEN (conv_id * 3 + turn) % 11 = 3 THEN 'Customs'
            WHEN (conv_id * 3 + turn) % 11 = 7 THEN NULL ELSE 'Inbox' END AS folder,
       CASE WHEN role = 'system' THEN 53 ELSE 43 END AS item_class,
       role || '-' || cast((turn * 3 + conv_id) % 5 AS varchar) AS sender,
       role || '-' || cast((turn * 3 + conv_id) % 5 AS varchar) || '@example.com' AS sender_address,
       CASE WHEN turn % 3 = 0 THEN 'ops@example.com' END AS cc,
       CASE (turn + conv_id) % 5 WHEN 0 THEN '' WHEN 1 THEN 'RE: ' WHEN 2 THEN 'Fwd: '
            WHEN 3 THEN 'Re: FW: ' ELSE 'FWD:RE: ' END
         || CASE conv_id % 4 WHEN 0 THEN 'Load/Unload: week ' WHEN 1 THEN 'CARE: order "A" <'
            WHEN 2 THEN 'A very long subject line that keeps going past fifty characters ' ELSE 'Plan ' END
         || cast(conv_id % 17 AS varchar) AS subject,
       TIMESTAMP '2024-01-01 08:00:00'
         + INTERVAL '1' MINUTE * cast((conv_id % 100) * 1440
           + (CASE WHEN conv_id % 6 = 0 THEN turn - turn % 2 ELSE turn END)
             * (1 + conv_id % 9) * 295 AS int) AS received_time,
       CASE (conv_id + turn) % 6 WHEN 0 THEN 'Dear all,' || chr(10)
            WHEN 1 THEN 'Hi team,' || chr(10) || chr(10) ELSE '' END
         || CASE (conv_id * 7 + turn * 3) % 13
              WHEN 0 THEN 'This is URGENT. Please confirm the pickup?' || chr(10)
              WHEN 1 THEN 'The truck is delayed at the border.' || chr(10)
              WHEN 2 THEN 'Documents are missing. We are waiting for customs clearance.' || chr(10)
              WHEN 3 THEN 'Agreed. The decision is approved.' || chr(10)
              WHEN 4 THEN 'Could you send the template' || chr(10)
              WHEN 5 THEN 'There is a problem with the deadline. Pending your reply' || chr(10)
              WHEN 6 THEN 'Issue confirmed.No solution yet.' || chr(10)
              ELSE '' END
         || text
         || CASE (conv_id + turn) % 3 WHEN 0 THEN chr(10) || '-----' || chr(10)
              || 'Best regards,' || chr(10) || 'J.' ELSE '' END AS body,
       CASE WHEN (conv_id + turn) % 4 = 0 THEN 2 ELSE 0 END AS attachment_count
FROM conversations
"""


DOCUMENT_ADAPTER = """
SELECT doc_id AS message_id, source AS conversation_id, 'Inbox' AS folder, 43 AS item_class, lang AS sender,
       lang || '@example.com' AS sender_address, NULL::VARCHAR AS cc,
       'Document ' || cast(doc_id AS varchar) AS subject,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * cast(doc_id AS int) AS received_time,
       text AS body, 0 AS attachment_count
FROM documents
"""


EVENTS_ADAPTER = """
SELECT event_id AS message_id, 'user-' || cast(user_id AS varchar) AS conversation_id, 'Inbox' AS folder,
       43 AS item_class, event_type AS sender, event_type || '@example.com' AS sender_address,
       NULL::VARCHAR AS cc, 'Event ' || event_type AS subject, props AS body,
       CAST(ts AS TIMESTAMP) AS received_time, 0 AS attachment_count
FROM events
"""


# the events as busy threads: senders repeat, every capped list has more items than its cap
BUSY_ADAPTER = f"""
SELECT * REPLACE (sender || '-' || cast(message_id % 4 AS varchar) AS sender,
  'Could you check order ' || cast(message_id AS varchar) || '?' || chr(10)
  || CASE sender WHEN 'error' THEN 'This is urgent. ' WHEN 'purchase' THEN 'There is a delay. ' ELSE '' END
  || 'The decision on ' || sender || ' is approved. We have an issue with the ' || sender || ' deadline.' || chr(10)
  || 'Please confirm ' || cast(message_id AS varchar) || chr(10) || body AS body)
FROM ({EVENTS_ADAPTER})
"""


# the conversations with faults: messages without time, id, sender or conversation
FAULTY_ADAPTER = f"""
SELECT * REPLACE (CASE WHEN message_id % 29 <> 7 THEN message_id END AS message_id,
                  CASE WHEN message_id % 23 <> 5 THEN received_time END AS received_time,
                  CASE WHEN message_id % 31 <> 9 THEN sender END AS sender,
                  CASE WHEN message_id % 37 <> 11 THEN conversation_id END AS conversation_id)
FROM ({ADAPTER})
"""


def base_ctes(p: Params = P, adapter: str = ADAPTER) -> str:
    ex = ", ".join(q(x) for x in p.excluded_folders)
    where = "WHERE received_time IS NOT NULL AND message_id IS NOT NULL"
    if ex:
        where += f" AND (folder IS NULL OR folder NOT IN ({ex}))"
    lb, ls = "lb", "ls"

    def flag(words):
        return f"({any_in(lb, words)} OR {any_in(ls, words)})"

    waiting = "CASE " + " ".join(
        f"WHEN contains(lb, {q(ph)}) THEN {q(C.WAITING_PREFIX)} || substring(lb, strpos(lb, {q(ph)}), "
        f"{C.WAITING_CHARS}) || {q(C.WAITING_SUFFIX)}" for ph in C.WAITING_PHRASES) + " END"
    action_words = any_in("lower(l)", C.ACTION_WORDS)
    actions = (f"list_transform(list_filter(string_split(body, chr(10)), lambda l: (contains(l, '?') OR {action_words}) "
               f"AND length(l) < {C.ACTION_LINE_MAX_LEN}), lambda l: {strip('l')})[1:{C.CAP_ACTIONS}]")
    preview = (f"{strip(f"replace(left(body, {C.PREVIEW_CHARS}), chr(10), ' ')")} || "
               f"CASE WHEN length(body) > {C.PREVIEW_CHARS} THEN '...' ELSE '' END")
    snippet = strip(f"replace(left(body, {C.SNIPPET_CHARS}), chr(10), ' ')")
    issue_kw = first_in("lb", C.issue_keywords())
    kp_selects = " UNION ALL ".join(
        f"SELECT thread_key, rn, {i} AS word_pos, sender, "
        f"list_filter(string_split(body, '.'), lambda s: contains(lower(s), {q(w)}) "
        f"AND length({strip('s')}) < {C.KEY_POINT_MAX_LEN})[1] AS s FROM f"
        for i, w in enumerate(C.IMPORTANT_WORDS))
    name = "subject"
    for pre in C.SUBJECT_PREFIXES:
        name = strip(f"replace({name}, {q(pre)}, '')")
    return f"""
msgs AS ({adapter}),
kept AS (SELECT *, coalesce(conversation_id, chr(0)) AS thread_key FROM msgs {where}),
f0 AS (SELECT thread_key, conversation_id, message_id, received_time, folder, item_class,
              coalesce(sender, 'Unknown') AS sender, sender_address, cc, coalesce(subject, '') AS subject,
              coalesce(attachment_count, 0) AS attachment_count, coalesce(body, '') AS body,
              lower(coalesce(body, '')) AS lb, lower(coalesce(subject, '')) AS ls
       FROM kept),
f AS (SELECT *,
        {flag(p.keywords_urgent)} AS is_urgent, {flag(p.keywords_delay)} AS has_delay,
        {flag(p.keywords_transport)} AS is_transport, {flag(p.keywords_customs)} AS is_customs,
        {any_in('lb', C.SCORE_RESPONSE_PHRASES)} AS asks_score,
        {any_in('lb', C.INSIGHT_RESPONSE_PHRASES)} AS asks_insight,
        {waiting} AS waiting_on,
        {actions} AS action_lines,
        {preview} AS preview,
        {snippet} AS snippet,
        {issue_kw} AS issue_kw,
        row_number() OVER (PARTITION BY thread_key ORDER BY received_time, message_id) AS rn,
        row_number() OVER (PARTITION BY thread_key ORDER BY received_time DESC, message_id DESC) AS rn_desc,
        count(*) OVER (PARTITION BY thread_key) AS n
      FROM f0),
agg AS (SELECT thread_key, count(*) AS email_count,
               list_sort(list_distinct(list(sender))) AS participants,
               count(DISTINCT sender) AS participant_count,
               CAST(sum(attachment_count) AS BIGINT) AS total_attachments,
               bool_or(is_urgent) AS is_urgent, bool_or(has_delay) AS has_delay,
               bool_or(is_transport) AS is_transport, bool_or(is_customs) AS is_customs
        FROM f GROUP BY thread_key HAVING count(*) >= {p.min_messages}),
meta AS (SELECT a.*, fi.conversation_id,
                {day('fi.received_time')} || ' - ' || {name.replace('subject', 'fi.subject')} AS thread_name,
                fi.received_time AS start_time, la.received_time AS end_time,
                {iso('fi.received_time')} AS start_date, {iso('la.received_time')} AS end_date,
                {days('la.received_time', 'fi.received_time')} AS duration_days,
                fi.message_id AS first_message_id, fi.sender AS first_sender, fi.subject AS first_subject,
                la.message_id AS last_message_id, la.sender AS last_sender,
                la.sender_address AS last_sender_address, la.cc AS last_cc,
                la.asks_score AS last_asks_score, la.asks_insight AS last_asks_insight,
                la.waiting_on AS last_waiting_on,
                {days(AS_OF, 'la.received_time')} AS days_since_last
         FROM agg a JOIN f fi ON fi.thread_key = a.thread_key AND fi.rn = 1
                    JOIN f la ON la.thread_key = a.thread_key AND la.rn_desc = 1),
kf AS (SELECT f.* FROM f WHERE thread_key IN (SELECT thread_key FROM meta)),
kp_raw AS ({kp_selects}),
kp_items AS (SELECT thread_key, '[' || sender || '] ' || {strip('s')} AS text, rn, word_pos
             FROM kp_raw WHERE s IS NOT NULL),
kp_dedup AS (SELECT thread_key, text, min(rn * 100 + word_pos) AS first_pos FROM kp_items GROUP BY thread_key, text),
key_points AS (SELECT thread_key, row_number() OVER (PARTITION BY thread_key ORDER BY first_pos) AS point_rank,
                      text AS key_point FROM kp_dedup WHERE thread_key IN (SELECT thread_key FROM meta)
               QUALIFY point_rank <= {C.CAP_KEY_POINTS}),
iss_raw AS (SELECT thread_key, rn, received_time,
                   list_filter(string_split(body, '.'), lambda s: contains(lower(s), issue_kw)
                               AND length({strip('s')}) < {C.ISSUE_MAX_LEN})[1] AS s
            FROM f WHERE issue_kw IS NOT NULL),
iss_dedup AS (SELECT thread_key, '[' || {day('received_time')} || '] ' || {strip('s')} AS text, min(rn) AS first_pos
              FROM iss_raw WHERE s IS NOT NULL GROUP BY 1, 2),
issues AS (SELECT thread_key, row_number() OVER (PARTITION BY thread_key ORDER BY first_pos) AS issue_rank,
                  text AS issue FROM iss_dedup WHERE thread_key IN (SELECT thread_key FROM meta)
           QUALIFY issue_rank <= {C.CAP_ISSUES}),
ev_all AS (SELECT thread_key, 0 AS pos, '[' || {minute('start_time')} || '] Thread started by ' || first_sender
                  || ': ' || first_subject AS event FROM meta
           UNION ALL
           SELECT thread_key, 1, '[' || {minute('end_time')} || '] Latest update from ' || last_sender
           FROM meta WHERE email_count > 1
           UNION ALL
           SELECT thread_key, 1 + row_number() OVER (PARTITION BY thread_key ORDER BY rn),
                  '[' || {minute('received_time')} || '] ' ||
                  CASE WHEN is_urgent THEN 'URGENT: Update from ' ELSE 'Delay reported by ' END || sender
           FROM kf WHERE rn > 1 AND rn < n AND (is_urgent OR has_delay)),
events AS (SELECT thread_key, row_number() OVER (PARTITION BY thread_key ORDER BY pos) AS event_rank, event
           FROM ev_all QUALIFY event_rank <= {C.CAP_EVENTS}),
sc AS (SELECT thread_key, sender, count(*) AS n_emails, min(rn) AS first_rn FROM kf GROUP BY 1, 2),
stakeholders AS (SELECT thread_key,
                        row_number() OVER (PARTITION BY thread_key ORDER BY n_emails DESC, first_rn) AS stakeholder_rank,
                        sender || ' (' || cast(n_emails AS varchar) || ' emails)' AS stakeholder
                 FROM sc QUALIFY stakeholder_rank <= {C.CAP_STAKEHOLDERS}),
act_raw AS (SELECT thread_key, rn, unnest(action_lines) AS action_item,
                   generate_subscripts(action_lines, 1) AS line_pos
            FROM kf WHERE rn_desc <= {C.ACTION_MESSAGES}),
action_items AS (SELECT thread_key, row_number() OVER (PARTITION BY thread_key ORDER BY rn, line_pos) AS item_rank,
                        action_item FROM act_raw QUALIFY item_rank <= {C.CAP_ACTIONS}),
flow AS (SELECT thread_key, row_number() OVER (PARTITION BY thread_key ORDER BY rn) AS flow_pos,
                {minute('received_time')} AS date, sender, subject, preview
         FROM kf WHERE rn_desc <= {C.FLOW_MESSAGES})
"""


def _labels(pairs) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for c, t in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _bullets(lst: str, prefix: str = "- ") -> str:
    return f"array_to_string(list_transform({lst}, lambda x: {q(prefix)} || x || chr(10)), '')"


def _sec(cond: str, text: str) -> str:
    return f"(CASE WHEN {cond} THEN {text} ELSE '' END)"


def markdown_sql() -> str:
    flags = _labels([("is_urgent", f"{C.FLAG_SYMBOLS[0]} {C.FLAG_NAMES[0]}"),
                     ("has_delay", f"{C.FLAG_SYMBOLS[1]} {C.FLAG_NAMES[1]}"),
                     ("is_transport", f"{C.FLAG_SYMBOLS[2]} {C.FLAG_NAMES[2]}"),
                     ("is_customs", f"{C.FLAG_SYMBOLS[3]} {C.FLAG_NAMES[3]}")])
    emoji = "CASE priority_level " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.LEVEL_EMOJI.items()) + \
        f" ELSE {q(C.LEVEL_EMOJI_OTHER)} END"
    flow = ("array_to_string(list_transform(conversation_flow, lambda m: '**' || m.date || '** - ' || m.sender "
            "|| chr(10) || '> ' || m.preview || chr(10) || chr(10)), '')")
    rules = f"method <> {q(C.METHOD_MODEL)}"
    N = "chr(10)"
    parts = [
        f"'# ' || thread_name || {N} || {N}",
        f"'## Thread Information' || {N} || {N}",
        f"'- **Emails**: ' || email_count::VARCHAR || {N}",
        f"'- **Participants**: ' || participant_count::VARCHAR || {N}",
        f"'- **Date Range**: ' || start_date || ' to ' || end_date || {N}",
        f"'- **Duration**: ' || duration_days::VARCHAR || ' days' || {N}",
        f"'- **Attachments**: ' || total_attachments::VARCHAR || {N} || {N}",
        _sec(f"len({flags}) > 0", f"'**Flags**: ' || array_to_string({flags}, ' | ') || {N} || {N}"),
        _sec(rules, f"'## ' || ({emoji}) || ' Priority: ' || priority_level || ' (' || priority_score::VARCHAR "
                    f"|| '/100)' || {N} || {N} || "
                    + _sec("len(priority_factors) > 0",
                           f"'**Priority Factors:**' || {N} || {_bullets('priority_factors')} || {N}")),
        f"'## Executive Summary' || {N} || {N} || executive_summary || {N} || {N}",
        f"'## Current Status' || {N} || {N} || current_status || {N} || {N}",
        _sec(rules, f"{q(C.INSIGHTS_HEADING)} || {N} || {N} || "
                    + _sec("response_needed", f"{q(C.RESPONSE_HEADING)} || {N}")
                    + f" || '**Next Action**: ' || next_action || {N} || {N} || "
                    + _sec("coalesce(length(last_responder) > 0, false)",
                           f"'**Last Response From**: ' || last_responder || {N} || {N}") + " || "
                    + _sec("coalesce(length(waiting_on) > 0, false)",
                           f"'**Waiting On**: ' || waiting_on || {N} || {N}") + " || "
                    + _sec("len(conversation_flow) > 0", f"'### Recent Conversation Flow' || {N} || {N} || {flow}")
                    + " || "
                    + _sec("len(key_points) > 0",
                           f"'### Key Discussion Points' || {N} || {N} || {_bullets('key_points')} || {N}")),
        _sec("len(key_events) > 0", f"'## Key Events' || {N} || {N} || {_bullets('key_events')} || {N}"),
        _sec("len(stakeholders) > 0", f"'## Stakeholders' || {N} || {N} || {_bullets('stakeholders')} || {N}"),
        _sec("len(action_items) > 0",
             f"'## Action Items' || {N} || {N} || {_bullets('action_items', '- [ ] ')} || {N}"),
        _sec("len(issues) > 0",
             f"'## Issues & Risks' || {N} || {N} || {_bullets('issues', '- ' + C.ISSUE_MARK + ' ')} || {N}"),
        _sec(f"{rules} AND reply_template <> {q(C.NO_REPLY)}",
             f"{q(C.REPLY_HEADING)} || {N} || {N} || '```' || {N} || reply_template || {N} || '```' || {N} || {N}"),
        f"{N} || '---' || {N} || '*Summary generated using ' || method || ' method*' || {N}",
    ]
    return " || ".join(f"({x})" for x in parts)


def summary_ctes(p: Params = P) -> str:
    d = "days_since_last"
    score = (f"LEAST(100, GREATEST(0, (CASE WHEN is_urgent THEN {C.SCORE_URGENT} ELSE 0 END)"
             f" + (CASE WHEN last_asks_score THEN {C.SCORE_RESPONSE} ELSE 0 END)"
             f" + (CASE WHEN {d} < {C.RECENT_DAYS_BELOW} THEN {C.SCORE_RECENT} "
             f"WHEN {d} > {C.STALE_DAYS_ABOVE} THEN {C.SCORE_STALE} ELSE 0 END)"
             f" + (CASE WHEN participant_count > {C.PARTICIPANTS_ABOVE} THEN {C.SCORE_PARTICIPANTS} ELSE 0 END)"
             f" + (CASE WHEN has_delay THEN {C.SCORE_DELAY} ELSE 0 END)"
             f" + (CASE WHEN email_count > {C.VOLUME_ABOVE} THEN {C.SCORE_VOLUME} ELSE 0 END)"
             f" + (CASE WHEN is_customs THEN {C.SCORE_CUSTOMS} ELSE 0 END)"
             f" + (CASE WHEN is_transport THEN {C.SCORE_TRANSPORT} ELSE 0 END)))::BIGINT")
    factors = _labels([
        ("is_urgent", C.FACTOR_URGENT), ("last_asks_score", C.FACTOR_RESPONSE),
        (f"{d} < {C.RECENT_DAYS_BELOW}", C.FACTOR_RECENT),
        (f"{d} >= {C.RECENT_DAYS_BELOW} AND {d} > {C.STALE_DAYS_ABOVE}", C.FACTOR_STALE),
        (f"participant_count > {C.PARTICIPANTS_ABOVE}", C.FACTOR_PARTICIPANTS),
        ("has_delay", C.FACTOR_DELAY), (f"email_count > {C.VOLUME_ABOVE}", C.FACTOR_VOLUME),
        ("is_customs", C.FACTOR_CUSTOMS), ("is_transport", C.FACTOR_TRANSPORT)])
    level = "CASE " + " ".join(f"WHEN priority_score >= {b} THEN {q(n)}" for b, n in C.LEVEL_BANDS) + \
        f" ELSE {q(C.LEVEL_DEFAULT)} END"
    status = (f"(CASE WHEN {d} = 0 THEN 'Active today' WHEN {d} = 1 THEN 'Active yesterday' "
              f"WHEN {d} < 7 THEN 'Active ' || {d}::VARCHAR || ' days ago' "
              f"ELSE 'Last activity ' || {d}::VARCHAR || ' days ago' END)"
              f" || (CASE WHEN is_urgent THEN ' - URGENT' ELSE '' END)")
    follow = C.NEXT_FOLLOW_UP.split("{days}")
    nxt = (f"CASE WHEN last_waiting_on IS NOT NULL THEN {q(C.NEXT_WAITING)} "
           f"WHEN last_asks_insight THEN {q(C.NEXT_RESPONSE)} "
           f"WHEN {d} > {C.STALE_DAYS_ABOVE} THEN {q(follow[0])} || {d}::VARCHAR || {q(follow[1])} "
           f"ELSE {q(C.NEXT_MONITOR)} END")
    N = "chr(10)"
    reply = (f"CASE WHEN response_needed THEN {nl(C.REPLY_SUBJECT)} || thread_name || {N} || {N} || "
             f"{nl(C.REPLY_GREETING)}"
             f" || (CASE WHEN waiting_on IS NOT NULL THEN {nl(C.REPLY_WAITING)} "
             f"WHEN contains(next_action, '?') THEN {nl(C.REPLY_QUESTION)} ELSE {nl(C.REPLY_CONFIRM)} END)"
             f" || (CASE WHEN is_urgent THEN {nl(C.REPLY_URGENT)} ELSE '' END)"
             f" || (CASE WHEN has_delay THEN {nl(C.REPLY_DELAY)} ELSE '' END)"
             f" || {nl(C.REPLY_CLOSING)} || {nl(C.REPLY_SIGNOFF)} ELSE {q(C.NO_REPLY)} END")
    execs = ("concat_ws(' ', 'Email thread ' || chr(39) || thread_name || chr(39) || ' with ' "
             "|| email_count::VARCHAR || ' emails over '"
             " || duration_days::VARCHAR || ' days involving ' || participant_count::VARCHAR || ' participants.',"
             " CASE WHEN is_urgent THEN 'Thread contains URGENT items.' END,"
             " CASE WHEN has_delay THEN 'Thread discusses delays.' END,"
             " CASE WHEN len(issues) > 0 THEN 'Identified ' || len(issues)::VARCHAR"
             " || ' potential issues requiring attention.' END)")
    empty = "[]::VARCHAR[]"
    return f""",
scored0 AS (SELECT *, {score} AS priority_score, {factors} AS priority_factors, {status} AS current_status,
                   last_asks_insight AS response_needed, last_waiting_on AS waiting_on, last_sender AS last_responder,
                   {nxt} AS next_action, {d} > {p.archive_days} AS is_archived
            FROM meta),
scored AS (SELECT *, {level} AS priority_level FROM scored0),
ev_l AS (SELECT thread_key, list(event ORDER BY event_rank) AS key_events FROM events GROUP BY 1),
st_l AS (SELECT thread_key, list(stakeholder ORDER BY stakeholder_rank) AS stakeholders FROM stakeholders GROUP BY 1),
ac_l AS (SELECT thread_key, list(action_item ORDER BY item_rank) AS action_items FROM action_items GROUP BY 1),
kp_l AS (SELECT thread_key, list(key_point ORDER BY point_rank) AS key_points FROM key_points GROUP BY 1),
is_l AS (SELECT thread_key, list(issue ORDER BY issue_rank) AS issues FROM issues GROUP BY 1),
fl_l AS (SELECT thread_key, list({{'date': date, 'sender': sender, 'subject': subject, 'preview': preview}}
                                 ORDER BY flow_pos) AS conversation_flow FROM flow GROUP BY 1),
summary0 AS (SELECT s.*, coalesce(ev_l.key_events, {empty}) AS key_events,
                    coalesce(st_l.stakeholders, {empty}) AS stakeholders,
                    coalesce(ac_l.action_items, {empty}) AS action_items,
                    coalesce(kp_l.key_points, {empty}) AS key_points,
                    coalesce(is_l.issues, {empty}) AS issues,
                    fl_l.conversation_flow, {q(C.METHOD_RULES)} AS method
             FROM scored s LEFT JOIN ev_l USING (thread_key) LEFT JOIN st_l USING (thread_key)
                  LEFT JOIN ac_l USING (thread_key) LEFT JOIN kp_l USING (thread_key)
                  LEFT JOIN is_l USING (thread_key) LEFT JOIN fl_l USING (thread_key)),
summary AS (SELECT *, {execs} AS executive_summary, {reply} AS reply_template FROM summary0),
md AS (SELECT *, {markdown_sql()} AS summary_markdown FROM summary)
"""


def slug_sql(name: str, ident: str) -> str:
    bad = C.FOLDER_INVALID_CHARS
    return (f"left({strip(f'translate({name}, {q(bad)}, {q("_" * len(bad))})')}, {C.SLUG_NAME_CHARS}) || '_' || "
            f"left(coalesce({ident}, ''), {C.SLUG_ID_CHARS})")


def attention_sql(p: Params = P) -> str:
    return f"(priority_score >= {p.attention_score} OR response_needed OR is_urgent)"


def suggested_sql(p: Params = P) -> str:
    acts = _labels([("response_needed", C.ACTION_REPLY), ("is_urgent", C.ACTION_URGENT),
                    ("has_delay", C.ACTION_DELAY), (f"priority_score >= {p.handle_today_score}", C.ACTION_HIGH),
                    (f"duration_days > {p.long_running_days}", C.ACTION_LONG)])
    return f"(CASE WHEN len({acts}) > 0 THEN {acts} ELSE [{q(C.ACTION_MONITOR)}] END)"


def basic_reply_sql() -> str:
    return (f"{nl(C.BASIC_REPLY_OPENING)} || (CASE WHEN is_urgent THEN {nl(C.REPLY_URGENT)} ELSE '' END) || "
            f"(CASE WHEN has_delay THEN {nl(C.BASIC_REPLY_DELAY)} ELSE '' END) || {nl(C.REPLY_CLOSING)} || "
            f"{nl(C.REPLY_SIGNOFF)}")


def extra_ctes(p: Params = P) -> str:
    t = f"lower({strip('l')})"
    ok = (f"(length({t}) > 0 AND NOT ({any_in(t, C.SIGNATURES)} AND length({t}) < {C.SIGNATURE_MAX_LEN}) "
          f"AND NOT regexp_full_match({t}, '[-_=*# ]+'))")
    greet = f"({any_in(t, C.GREETINGS)} AND length({t}) < {C.GREETING_MAX_LEN})"
    lines = (f"list_transform(string_split(coalesce(body, ''), chr(10)), "
             f"lambda l: {{'text': {strip('l')}, 'ok': {ok}, 'greet': {greet}}})")
    joined_kept = ("array_to_string(list_transform(list_filter(list_transform(ls, lambda x, i: "
                   "{'text': x.text, 'keep': x.ok AND (NOT x.greet OR i > coalesce(second, 1073741824))}), "
                   "lambda y: y.keep), lambda y: y.text), ' ')")
    clean = strip(f"regexp_replace({joined_kept}, {WS_CLASS}, ' ', 'g')")
    ex_name = "subject"
    for pre in C.SUBJECT_PREFIXES:
        ex_name = strip(f"replace({ex_name}, {q(pre)}, '')")

    def flag(words):
        return f"bool_or({any_in('lower(body)', words)} OR {any_in('lower(subject)', words)})"

    return f""",
cb1 AS (SELECT message_id, {lines} AS ls FROM msgs),
cb2 AS (SELECT message_id, ls, list_filter(list_transform(ls, lambda x, i: CASE WHEN x.ok AND NOT x.greet THEN i
        ELSE -1 END), lambda i: i >= 0)[2] AS second FROM cb1),
cb AS (SELECT message_id, {clean} AS clean_body FROM cb2),
routing AS (SELECT k.message_id, k.thread_key,
                   CASE WHEN s.is_archived THEN '{C.ARCHIVE_ROOT}' ELSE '{C.ACTIVE_ROOT}' END AS target_root,
                   {slug_sql('s.thread_name', 's.conversation_id')} AS target_folder
            FROM kf k JOIN scored s USING (thread_key)),
ex0 AS (SELECT m.*, r.target_folder AS xfolder FROM msgs m JOIN routing r USING (message_id)
        WHERE r.target_root = '{C.ACTIVE_ROOT}' AND m.item_class = {C.MAIL_ITEM_CLASS}),
exf AS (SELECT xfolder AS thread_key, coalesce(conversation_id, xfolder) AS conversation_id,
               coalesce(sender, 'Unknown') AS sender, coalesce(subject, '') AS subject, coalesce(body, '') AS body,
               received_time, message_id, coalesce(attachment_count, 0) AS attachment_count,
               row_number() OVER (PARTITION BY xfolder ORDER BY received_time, message_id) AS rn,
               row_number() OVER (PARTITION BY xfolder ORDER BY received_time DESC, message_id DESC) AS rn_desc
        FROM ex0),
ex_agg AS (SELECT thread_key, count(*) AS email_count, count(DISTINCT sender) AS participant_count,
                  CAST(sum(attachment_count) AS BIGINT) AS total_attachments,
                  {flag(p.keywords_urgent)} AS is_urgent, {flag(p.keywords_delay)} AS has_delay,
                  {flag(p.keywords_transport)} AS is_transport, {flag(p.keywords_customs)} AS is_customs
           FROM exf GROUP BY thread_key),
ex_meta AS (SELECT a.*, fi.conversation_id,
                   {day('fi.received_time')} || ' - ' || {ex_name.replace('subject', 'fi.subject')} AS thread_name,
                   {iso('fi.received_time')} AS start_date, {iso('la.received_time')} AS end_date,
                   {days('la.received_time', 'fi.received_time')} AS duration_days
            FROM ex_agg a JOIN exf fi ON fi.thread_key = a.thread_key AND fi.rn = 1
                          JOIN exf la ON la.thread_key = a.thread_key AND la.rn_desc = 1),
attention AS (SELECT * FROM summary WHERE NOT is_archived AND {attention_sql(p)})
"""


def with_base(select: str, p: Params = P, adapter: str = ADAPTER) -> str:
    return "WITH " + base_ctes(p, adapter) + summary_ctes(p) + extra_ctes(p) + select
