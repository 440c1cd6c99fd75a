"""Golden cases worked out by hand from the original tool's rules (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from conftest import AS_OF, ago, frame, msg
from threadlens import config as C
from threadlens.config import Params
from threadlens.functions import text as X
from threadlens.operators import outputs as OUT
from threadlens.operators import render as R
from threadlens.operators import scoring as S
from threadlens.plans.job import ThreadJob

P = Params(as_of=AS_OF)


def _meta_row(spark, **kw):
    base = dict(thread_name="Test Thread", is_urgent=False, has_delay=False, is_transport=False, is_customs=False,
                last_asks_score=False, last_asks_insight=False, last_waiting_on=None, days_since_last=1,
                participant_count=1, email_count=1, duration_days=0, last_sender="x")
    base.update(kw)
    schema = ("thread_name string, is_urgent boolean, has_delay boolean, is_transport boolean, is_customs boolean, "
              "last_asks_score boolean, last_asks_insight boolean, last_waiting_on string, days_since_last bigint, "
              "participant_count bigint, email_count bigint, duration_days bigint, last_sender string")
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(base[n] for n in names)], schema)


def test_g1_clean_body(spark):
    body = ("Dear all,\n    \n    Yes, the material is ready for collection.\n    \n"
            "    Best regards,\n    John")
    out = spark.createDataFrame([(body,)], "b string").select(X.clean_body("b")).first()[0]
    assert out == "Yes, the material is ready for collection. John"


def test_g2_score_critical_100(spark):
    # one message a day old asking a question; urgent, delay, 4 participants, 8 emails
    job = ThreadJob(frame(spark, [msg(1, "c", ago(days=1), body="This is urgent! Can you please confirm?")]),
                    P, min_messages=1)
    feats = job.meta.select("last_asks_score", "days_since_last").first()
    assert feats.last_asks_score and feats.days_since_last == 1
    row = S.with_scores(_meta_row(spark, is_urgent=True, has_delay=True, participant_count=4, email_count=8,
                                  last_asks_score=True, days_since_last=1), P).first()
    assert row.priority_score == 100 and row.priority_level == "Critical"
    assert row.priority_factors == [C.FACTOR_URGENT, C.FACTOR_RESPONSE, C.FACTOR_RECENT,
                                    C.FACTOR_PARTICIPANTS, C.FACTOR_DELAY]


def test_g3_reply_template(spark):
    df = _meta_row(spark, is_urgent=True, last_asks_insight=True)
    df = S.with_scores(df, P).withColumn("reply", R.reply_template())
    reply = df.first().reply
    assert reply.startswith("Subject: Re: Test Thread")
    assert C.REPLY_CONFIRM in reply and C.REPLY_URGENT in reply and C.REPLY_DELAY not in reply
    assert len(reply) > 50


def test_g4_kpis(spark):
    rows = spark.createDataFrame(
        [("t", "Test Thread", 5, 3, 2, "2025-10-19", "2025-10-21", 75, "Critical", True, "Respond", True, False,
          True, False, False)],
        "thread_key string, thread_name string, email_count bigint, participant_count bigint, duration_days bigint, "
        "start_date string, end_date string, priority_score bigint, priority_level string, response_needed boolean, "
        "next_action string, is_urgent boolean, has_delay boolean, is_transport boolean, is_customs boolean, "
        "is_archived boolean")
    k = OUT.dashboard_kpis(OUT.dashboard_rows(rows)).first().asDict()
    assert k == {"total_threads": 1, "critical": 1, "high": 0, "response_needed": 1, "urgent": 1, "delay": 0}


def test_g5_g6_score_60_high_and_reply(spark):
    df = _meta_row(spark, is_urgent=True, last_asks_score=True, last_asks_insight=True, has_delay=True,
                   days_since_last=10)
    row = S.with_scores(df, P).withColumn("reply", R.reply_template()).first()
    assert row.priority_score == 60 and row.priority_level == "High"
    assert C.REPLY_CONFIRM in row.reply and C.REPLY_URGENT in row.reply


def test_kpis_none_when_no_active(spark):
    rows = OUT.dashboard_rows(spark.createDataFrame([("t", True)], "thread_key string, is_archived boolean"))
    assert OUT.dashboard_kpis(rows).count() == 0


def test_thread_name_prefix_removal_anywhere(spark):
    df = spark.createDataFrame([("CARE: x",), ("RE: FW: Plan",), ("FWD:RE: Load",)], "s string")
    out = [r[0] for r in df.select(X.thread_name("s", X.ntz_literal(AS_OF))).collect()]
    assert out == ["2024-04-10 - CA x", "2024-04-10 - Plan", "2024-04-10 - Load"]


def test_slug(spark):
    df = spark.createDataFrame([('a/b:c*d?"e<f>g|h\\i', "12345678901")], "n string, i string")
    assert df.select(X.slug("n", "i")).first()[0] == "a_b_c_d__e_f_g_h_i_12345678"


def test_folder_list_parameter():
    assert C.parse_folder_list(" Sent Items, Deleted Items ,Archive") == ("Sent Items", "Deleted Items", "Archive")
    assert C.parse_folder_list("") == () and C.parse_folder_list(None) == ()
