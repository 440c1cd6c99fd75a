"""Property: the range-split row number / next value equals the plain window for any data and
tie pattern, however many ranges there are."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.operators import sequence
from threadlens.operators.sequence import bucketed_row_number

BASE = datetime(2024, 1, 1)

rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 5000), st.integers(0, 10**6)),
                min_size=1, max_size=60, unique_by=lambda r: r[2])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, ranges=st.sampled_from([1, 3, 16]), desc=st.booleans())
def test_bucketed_equals_plain(spark, monkeypatch, data, ranges, desc):
    monkeypatch.setattr(sequence, "SMALL", 0)
    monkeypatch.setattr(sequence, "SAMPLED", 1)
    df = spark.createDataFrame([(k, BASE + timedelta(minutes=m), i) for k, m, i in data],
                               "k string, t timestamp_ntz, i bigint")
    names = ["-t", "i"] if desc else ["t", "i"]
    order = [F.col("t").desc(), F.col("i")] if desc else [F.col("t"), F.col("i")]
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = bucketed_row_number(df, ["k"], names, out="n", lead_col="t", lead_out="nxt")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("k", "t", "i", F.row_number().over(w).cast("bigint").alias("n"),
                     F.lead("t").over(w).alias("nxt"))
    got = got.select("k", "t", "i", "n", "nxt")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
