"""Boundary cases from the survey's test strategy, on small hand-made threads."""

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, ago, frame, msg
from threadlens import config as C
from threadlens.config import Params
from threadlens.plans.job import ThreadJob

P = Params(as_of=AS_OF, excluded_folders=("Customs",))


def rows_by_key(df, key="thread_key"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def days_job(spark):
    rows = []
    for i, d in enumerate([0, 1, 2, 7, 8, 60, 61]):
        rows += [msg(10 * i + 1, f"d{d}", ago(days=d + 3)), msg(10 * i + 2, f"d{d}", ago(days=d))]
    rows += [msg(901, "future", ago(days=2)), msg(902, "future", ago(hours=-1))]
    return ThreadJob(frame(spark, rows), P)


def test_days_status_next_action_archive(days_job):
    s = rows_by_key(days_job.scored)
    assert {k: s[k].days_since_last for k in s} == {
        "d0": 0, "d1": 1, "d2": 2, "d7": 7, "d8": 8, "d60": 60, "d61": 61, "future": -1}
    assert s["d0"].current_status == "Active today"
    assert s["d1"].current_status == "Active yesterday"
    assert s["d2"].current_status == "Active 2 days ago"
    assert s["future"].current_status == "Active -1 days ago"
    assert s["d7"].current_status == "Last activity 7 days ago"
    assert s["d7"].next_action == C.NEXT_MONITOR
    assert s["d8"].next_action == "Follow up - no activity for 8 days"
    assert not s["d60"].is_archived and s["d61"].is_archived
    assert C.FACTOR_RECENT in s["d1"].priority_factors and C.FACTOR_RECENT not in s["d2"].priority_factors
    assert C.FACTOR_STALE in s["d8"].priority_factors and C.FACTOR_STALE not in s["d7"].priority_factors


def test_score_bands(spark):
    from threadlens.operators import scoring as S
    df = spark.createDataFrame([(v,) for v in (29, 30, 49, 50, 69, 70, 0, 100)], "priority_score bigint")
    got = [r[0] for r in df.select(S.priority_level(F.col("priority_score"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "Critical", "Low", "Critical"]


@pytest.fixture(scope="module")
def rich_job(spark):
    long_line = "please " + "x" * 192           # 199 chars -> kept
    too_long = "please " + "x" * 193            # 200 chars -> dropped
    s149 = "decision " + "y" * 140              # 149 chars stripped -> key point
    s150 = "approved " + "z" * 141              # 150 chars -> not a key point
    rows = [
        # 12-message thread, every middle message urgent: events cap at 10
        *[msg(100 + i, "big", ago(days=3, minutes=-i), sender=f"s{i % 11}",
              body="urgent matter" if 0 < i < 11 else "hello") for i in range(12)],
        # 11 distinct senders -> stakeholder cap 10
        *[msg(200 + i, "many", ago(days=2, minutes=-i), sender=f"p{i:02d}") for i in range(11)],
        # ties in time: order by message id
        msg(302, "tie", ago(days=1), sender="second", body="b"),
        msg(301, "tie", ago(days=1), sender="first", body="a"),
        # folders: NULL kept, excluded dropped; NULL subject/body/sender survive
        msg(401, "fold", ago(days=1), folder=None, subject=None, body=None, sender=None),
        msg(402, "fold", ago(days=1, minutes=-1), folder="Customs"),
        msg(403, "fold", ago(days=1, minutes=-2), folder="Inbox", body=f"{long_line}\n{too_long}\r\nCan we?\r"),
        # sentences and waiting phrases
        msg(501, "sent", ago(days=5), body=f"{s149}. {s150}. There is a problem. The truck is late today."),
        msg(502, "sent", ago(days=4), body="pending approval, then waiting for docs"),
    ]
    return ThreadJob(frame(spark, rows), P)


def test_events_cap_and_order(rich_job):
    ev = [r.event for r in rich_job.events.filter("thread_key = 'big'").orderBy("event_rank").collect()]
    assert len(ev) == C.CAP_EVENTS
    assert "Thread started by s0" in ev[0] and "Latest update from s0" in ev[1]
    assert all("URGENT: Update from" in e for e in ev[2:])
    assert ev[2].endswith("s1") and ev[-1].endswith("s8")


def test_stakeholder_cap_and_ties(rich_job):
    st = [r.stakeholder for r in rich_job.stakeholders.filter("thread_key = 'many'")
          .orderBy("stakeholder_rank").collect()]
    assert st == [f"p{i:02d} (1 emails)" for i in range(10)]
    big = [r.stakeholder for r in rich_job.stakeholders.filter("thread_key = 'big'")
           .orderBy("stakeholder_rank").collect()]
    assert big[0] == "s0 (2 emails)" and big[1] == "s1 (1 emails)"


def test_time_ties_ordered_by_id(rich_job):
    m = rows_by_key(rich_job.scored)["tie"]
    assert m.first_message_id == 301 and m.last_message_id == 302
    seq = {r.message_id: r.seq for r in rich_job.sequenced.filter("thread_key = 'tie'").collect()}
    assert seq == {301: 1, 302: 2}


def test_folders_and_nulls(rich_job):
    ids = {r.message_id for r in rich_job.kept.filter("thread_key = 'fold'").collect()}
    assert ids == {401, 403}
    m = rows_by_key(rich_job.scored)["fold"]
    assert m.participant_count == 2 and m.email_count == 2


def test_action_lines_length_and_crlf(rich_job):
    items = [r.action_item for r in rich_job.action_items.filter("thread_key = 'fold'").orderBy("item_rank").collect()]
    assert items == ["please " + "x" * 192, "Can we?"]


def test_key_point_length_bound(rich_job):
    kp = [r.key_point for r in rich_job.key_points.filter("thread_key = 'sent'").collect()]
    assert any(k.startswith("[alice] decision ") for k in kp)
    assert not any("approved" in k for k in kp)


def test_issue_uses_first_listed_keyword(rich_job):
    iss = [r.issue for r in rich_job.issues.filter("thread_key = 'sent'").orderBy("issue_rank").collect()]
    # 'late' (delay list) is searched before 'problem', and only the first found keyword counts
    assert iss[0].endswith("] The truck is late today")


def test_waiting_phrase_list_order(rich_job):
    m = rows_by_key(rich_job.scored)["sent"]
    assert m.waiting_on == "Check email: waiting for docs..."
    assert m.next_action == C.NEXT_WAITING and m.response_needed


def test_single_message_thread_dropped_and_kept(spark):
    rows = [msg(1, "one", ago(days=1)), msg(2, "two", ago(days=1)), msg(3, "two", ago(hours=1))]
    assert {r.thread_key for r in ThreadJob(frame(spark, rows), P).meta.collect()} == {"two"}
    j1 = ThreadJob(frame(spark, rows), P, min_messages=1)
    ev = {r.thread_key: r.n for r in j1.events.groupBy("thread_key").agg(F.count("*").alias("n")).collect()}
    assert ev == {"one": 1, "two": 2}


def test_find_folder_by_name_substring_semantics(spark):
    from threadlens.operators import lifecycle as LC
    names = spark.createDataFrame([
        ("a", "2024-01-01 - Plan 1"),        # also inside '... Plan 13_...' -> first by name
        ("b", "2024-01-01 - Plan 13"),
        ("c", 'CA order "A" <1'),             # cleaned by the slug -> never found
        ("d", "2024-01-02 - " + "x" * 60),    # cut at 50 chars -> never found
    ], "thread_key string, thread_name string")
    folders = spark.createDataFrame([("2024-01-01 - Plan 13_0000000b",), ("2024-01-01 - Plan 1_0000000a",),
                                     ('CA order _A_ _1_0000000c',), ("2024-01-02 - " + "x" * 37 + "_0000000d",),
                                     ("copy of 2024-01-01 - Plan 1_00000009",)], "folder string")
    got = {r.thread_key: r.found_folder for r in LC.find_folder_by_name(names, folders).collect()}
    assert got == {"a": "2024-01-01 - Plan 13_0000000b", "b": "2024-01-01 - Plan 13_0000000b"}


def test_clean_body_is_linear_in_the_lines(spark):
    import time

    from threadlens.functions import text as X

    def seconds(n):
        df = spark.createDataFrame([("\n".join(f"line {i} of it" for i in range(n)),)], "b string")
        best = 1e9
        for _ in range(2):
            t = time.perf_counter()
            got = df.select(X.clean_body(F.col("b")).alias("c")).first().c
            best = min(best, time.perf_counter() - t)
        assert got.count("line") == n
        return best
    seconds(1000)
    assert seconds(32000) < 2.5 * seconds(16000) + 1.0


def test_common_name_meets_one_folder(spark):
    from threadlens.operators import lifecycle as LC
    names = spark.createDataFrame([(f"k{i}", "2024-01-01 - Invoice") for i in range(300)], "thread_key string, thread_name string")
    folders = spark.createDataFrame([(f"2024-01-01 - Invoice_{i:04d}",) for i in range(300)], "folder string")
    got = LC.find_folder_by_name(names, folders)
    assert got.count() == 300 and {r.found_folder for r in got.collect()} == {"2024-01-01 - Invoice_0000"}
