"""Invariants: flags are ORs of message flags, scores stay in range, render/parse round-trips,
routing covers every message once, and input partitioning never changes results."""

import pytest
from pyspark.sql import functions as F

from threadlens import config as C
from threadlens.config import TEST_PARAMS as P
from threadlens.operators import render as R
from threadlens.plans.job import ThreadJob
from threadlens.sources.messages import messages_from_conversations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def job(spark):
    return ThreadJob(messages_from_conversations(spark, SF), P)


def test_flags_are_or_of_message_flags(job):
    per_msg = job.kept_features.groupBy("thread_key").agg(
        *[F.max(F.col(c).cast("int")).alias(c) for c in ("is_urgent", "has_delay", "is_transport", "is_customs")])
    meta = job.meta.select("thread_key", *[F.col(c).cast("int").alias(c) for c in
                                           ("is_urgent", "has_delay", "is_transport", "is_customs")])
    assert per_msg.exceptAll(meta).count() == 0 and meta.exceptAll(per_msg).count() == 0


def test_score_range_and_level(job):
    bad = job.scored.filter((F.col("priority_score") < 0) | (F.col("priority_score") > 100)).count()
    assert bad == 0


def test_render_parse_round_trip(job):
    md = job.markdown.select(
        "priority_score", "reply_template", "response_needed",
        R.parse_priority(F.col("summary_markdown")).alias("ps"),
        R.parse_reply(F.col("summary_markdown")).alias("pr"),
        R.response_marker(F.col("summary_markdown")).alias("rm")).collect()
    assert md and all(r.ps == r.priority_score for r in md)
    for r in md:
        assert r.pr == (r.reply_template if r.reply_template != C.NO_REPLY else "")
        assert r.rm == r.response_needed


def test_routing_covers_each_kept_message_once(job):
    routes = job.routes
    assert routes.count() == routes.select("message_id").distinct().count() == job.kept_features.count()


def test_partitioning_does_not_change_results(spark):
    base = messages_from_conversations(spark, SF)
    a = ThreadJob(base.repartition(1), P, materialize="none").markdown.select("thread_key", "summary_markdown")
    b = ThreadJob(base.repartition(7, "sender"), P, materialize="none").markdown.select("thread_key", "summary_markdown")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_list_alone_writes_no_features(spark, job):
    """Key points and issues of a new job come from the messages; with the feature table they are the same."""
    alone = ThreadJob(messages_from_conversations(spark, SF), P)
    job.features
    for name in ("key_points", "issues"):
        a, b = getattr(alone, name), getattr(job, name)
        got = sorted(map(tuple, a.collect()))
        assert got == sorted(map(tuple, b.collect())) and got
        made = a._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in x and "split(" in x for x in made.splitlines()), "sentences are split once"
    assert "features" not in alone.__dict__ and "meta" not in alone.__dict__
