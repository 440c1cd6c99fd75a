"""Skew-safe ordered numbering.

``row_number() OVER (PARTITION BY thread ORDER BY time)`` sends a whole thread
to one task; a thread holding a third of all messages would make that task the
job.  So a sample of the order columns alone (nothing else is read for it) finds the
hot keys and the points at which to cut them: each sampled value stands for an equal
share of the rows, so ranges are of like size however the keys or times are spread,
equal times and a thread of NULL ids included.  A row's range is an expression over its
key's few split points; rows are numbered inside each (keys, range), on the one exchange,
and a table of one row per range of a hot key supplies the offsets.  Where no key is hot
that is the plain window.  The result equals the plain window either way: split points
only decide which task numbers a row.
Next-row values (``lead``) use the same split: inside the range, else the first
row of the key's following range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SMALL = 10_000  # rows that one task may number whatever their keys
SAMPLED = 20  # sampled rows per range
SPLIT_CHARS = 1000  # longer text is no split point, so the table of them stays small in bytes too


def _ascending(df: DataFrame, name: str) -> Column:
    """The order column; '-name' is turned round (numbers and times) so that smaller still means earlier."""
    if not name.startswith("-"):
        return F.col(name)
    kind = df.schema[name[1:]].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.bitwise_not(X.ntz_micros(name[1:]))
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(F.col(name[1:]))
    raise ValueError(f"a descending order needs a number or a time: {name[1:]}")


def split_points(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int) -> DataFrame | None:
    """(_key, _splits): the cut points of each key that holds more than about 2/``ranges`` of the rows, ``_key``
    being a hash of the keys; None if no key does.  Two passes over the keys and order columns: a count and
    a sample chosen by their hash, of some 20 to 40 values per range, equal values counted, never listed."""
    rows = df.select(F.xxhash64(*keys).alias("_key") if keys else F.lit(0).cast("long").alias("_key"),
                     F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_ord"))
    n = rows.count()
    if n <= SMALL:
        return None
    every = max(1, n // (SAMPLED * ranges))
    sample = (rows.where(F.pmod(F.xxhash64("_key", "_ord"), F.lit(every)) == 0).groupBy("_key", "_ord").agg(F.count(F.lit(1)).alias("_n"))
              .collect())
    by_key: dict[int, list] = {}
    for r in sample:
        by_key.setdefault(r["_key"], []).append((tuple(r["_ord"]), r["_n"]))
    share = max(1.0, n / every / ranges)
    hot = []
    for key, some in by_key.items():
        if sum(w for _, w in some) < 2 * share:
            continue
        splits, held = [], 0.0
        for value, w in sorted(some):
            if held >= share and all(len(str(x)) <= SPLIT_CHARS for x in value):
                splits.append(value)
                held = 0.0
            held += w
        if splits:
            hot.append((key, splits))
    if not hot:
        return None
    schema = T.StructType([T.StructField("_key", T.LongType()),
                           T.StructField("_splits", T.ArrayType(rows.schema["_ord"].dataType))])
    return df.sparkSession.createDataFrame(hot, schema)


def _range_of(value: Column, splits: Column, ranges: int) -> Column:
    """How many of the sorted split points are at or before the value, by halving steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, ranges).bit_length() + 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(splits)) & (F.get(splits, at + step - 1) <= value), at + step).otherwise(at))


def bucketed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq",
                        lead_col: str | None = None, lead_out: str = "next_value") -> DataFrame:
    """Add ``out`` = row_number over (keys, order) and optionally ``lead_out`` = next row's
    ``lead_col``.  ``order`` names columns without nulls, '-name' for descending.  Building the plan runs the
    sampling passes; the rows themselves are written nowhere and cross one exchange."""
    keys = list(keys)
    asc = [_ascending(df, c) for c in order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = split_points(df, keys, asc, ranges)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*asc)
        found = {out: F.row_number().over(w).cast("bigint")}
        if lead_col is not None:
            found[lead_out] = F.lead(lead_col).over(w)
        return df.withColumns(found)
    ord_ = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(asc)])
    # at most one split per range, a key's hash and bounded values each: small whatever the input
    d = df.withColumn("_key", F.xxhash64(*keys) if keys else F.lit(0).cast("long")).join(F.broadcast(hot), "_key", "left")
    d = d.withColumn("_bkt", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
        _range_of(ord_, F.col("_splits"), ranges)))
    # one row per range of a hot key: how many rows come before it, and the first row of the next one
    first = F.min_by(lead_col, ord_) if lead_col is not None else F.lit(None)
    counts = d.where(F.col("_splits").isNotNull()).groupBy(*keys, "_bkt").agg(
        F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    ow = Window.partitionBy(*keys).orderBy("_bkt")
    offsets = counts.select(
        *keys, "_bkt", F.lead("_first").over(ow).alias("_next_first"),
        F.coalesce(F.sum("_n").over(ow.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_bkt").orderBy(*asc)
    d = d.drop("_key", "_splits").withColumn("_r", F.row_number().over(inner))
    if lead_col is not None:
        d = d.withColumns({"_lead_in": F.lead(lead_col).over(inner), "_last": F.lead(F.lit(1)).over(inner).isNull()})
    d = d.join(offsets, [*keys, "_bkt"], "left")
    found = {out: (F.col("_r") + F.coalesce("_off", F.lit(0))).cast("bigint")}
    if lead_col is not None:
        found[lead_out] = F.when(F.col("_last"), F.col("_next_first")).otherwise(F.col("_lead_in"))
    return d.withColumns(found).drop("_bkt", "_r", "_off", "_next_first", "_lead_in", "_last")


def message_sequence(messages: DataFrame, with_next_time: bool = False) -> DataFrame:
    """W1 (+W4 input): 1-based position of each message in its thread by (time, id);
    ``next_time`` is the next message's time or NULL for the last one."""
    return bucketed_row_number(
        messages, ["thread_key"], ["received_time", "message_id"], out="seq",
        lead_col="received_time" if with_next_time else None, lead_out="next_time")
