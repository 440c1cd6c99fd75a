"""A hot thread holding most messages: bucketed numbering and capped lists must equal the
plain (single-task) window results, and the numbering must not run as one window per thread."""

from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import AS_OF, frame, msg
from threadlens.config import Params
from threadlens.plans.job import ThreadJob

P = Params(as_of=AS_OF)


@pytest.fixture(scope="module")
def hot(spark):
    start = AS_OF - timedelta(days=3)
    rows = [msg(i, "hot", start + timedelta(minutes=(i * 7) % 4000 + (i % 3)), sender=f"s{i % 13}",
                body=("urgent: please confirm?" if i % 97 == 0 else "update")) for i in range(3000)]
    # equal timestamps inside the hot thread
    rows += [msg(5000 + i, "hot", start, sender="tie") for i in range(5)]
    rows += [msg(9000 + i, f"cold{i % 20}", start + timedelta(hours=i), sender="c") for i in range(60)]
    return ThreadJob(frame(spark, rows).repartition(6), P)


def test_sequence_equals_plain_window(hot):
    seq = hot.sequenced.select("thread_key", "message_id", "seq", "next_time")
    w = Window.partitionBy("thread_key").orderBy("received_time", "message_id")
    plain = hot.kept_features.select("thread_key", "message_id", F.row_number().over(w).cast("bigint").alias("seq"),
                                     F.lead("received_time").over(w).alias("next_time"))
    assert seq.count() == 3065
    assert seq.exceptAll(plain).count() == 0 and plain.exceptAll(seq).count() == 0


def test_sequence_of_a_split_thread_equals_plain_window(hot, monkeypatch):
    from threadlens.operators import sequence as Q
    monkeypatch.setattr(Q, "SMALL", 100)
    job = ThreadJob(hot.raw, P)
    assert Q.split_points(job.kept, ["thread_key"], [F.col("received_time"), F.col("message_id")], 4).count() == 1
    test_sequence_equals_plain_window(job)


def test_hot_thread_is_spread_over_tasks(spark, monkeypatch):
    """3,000 messages of one thread, 1,500 of them at one time: no range holds more than a few
    times its share, the window sits on an exchange by (key, range), and nothing is written."""
    from threadlens.operators import sequence as Q
    monkeypatch.setattr(Q, "SMALL", 100)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                           "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = [(None if i % 2 else "hot", AS_OF if i < 3000 else AS_OF + timedelta(hours=i), i) for i in range(6000)]
        df = spark.createDataFrame(rows, "thread_key string, received_time timestamp_ntz, message_id long").repartition(20)
        df = df.withColumn("thread_key", F.coalesce("thread_key", F.lit("\0")))
        before = _tables(spark)
        seq = Q.message_sequence(df, with_next_time=True)
        assert _tables(spark) == before
        plan = seq._jdf.queryExecution().executedPlan().initialPlan().toString()
        assert "_bkt" in plan.split("Window [row_number", 1)[1].split("Exchange hashpartitioning(thread_key", 1)[1].split(")")[0]
        asc = [F.col("received_time"), F.col("message_id")]
        hot = Q.split_points(df, ["thread_key"], asc, 16)
        ranged = df.withColumn("_key", F.xxhash64("thread_key")).join(hot, "_key").withColumn(
            "_bkt", Q._range_of(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(asc)]), F.col("_splits"), 16))
        sizes = [r["count"] for r in ranged.groupBy("thread_key", "_bkt").count().collect()]
        assert sum(sizes) == 6000 and max(sizes) <= 3 * 6000 / 16
        got = seq.groupBy("thread_key").agg(F.min("seq"), F.max("seq"), F.count_distinct("seq"), F.count("next_time")).collect()
        assert [tuple(r)[1:] for r in got] == [(1, 3000, 3000, 2999)] * 2
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def _tables(spark):
    import glob

    from threadlens.session import shared_dir
    return sorted(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/*"))


def test_capped_lists_bounded(hot):
    ev = hot.events.filter("thread_key = 'hot'").count()
    st = hot.stakeholders.filter("thread_key = 'hot'").count()
    ki = hot.action_items.filter("thread_key = 'hot'").count()
    assert ev == 10 and st == 10 and ki <= 5
    top = hot.stakeholders.filter("thread_key = 'hot'").orderBy("stakeholder_rank").first()
    assert top.stakeholder.endswith("(231 emails)")  # s0 .. s11 send 231 each, s12 230; s0 appears first


@pytest.mark.parametrize("small", [10, 10_000])
def test_report_numbering_global(hot, monkeypatch, small):
    from threadlens.operators import outputs as OUT
    from threadlens.operators import sequence as Q
    monkeypatch.setattr(Q, "SMALL", small)
    num = OUT.number_by_start(hot.scored, P).select("thread_key", "item_no")
    w = Window.orderBy(F.col("start_time").desc(), F.col("thread_key"))
    plain = hot.scored.select("thread_key", F.row_number().over(w).cast("bigint").alias("item_no"))
    assert num.exceptAll(plain).count() == 0 and plain.exceptAll(num).count() == 0
