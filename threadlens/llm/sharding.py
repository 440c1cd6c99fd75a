"""Sharding by a minimax contiguous partition.

Atomic groups (rows with equal text) are put in one total order, that of a 64-bit hash of the
text.  The smallest capacity for which a greedy left-to-right cut needs at most ``n_shards``
shards is found by binary search, and the order is cut there.  As the order is that of a hash, a
shard is a range of hash values: rows find their shard by comparing with ``n_shards - 1`` numbers,
with no join, and equal texts meet in one shard whatever their number.

The running sums behind the greedy cut are a written table.  The search sees a bounded number of
them: first evenly spread ones, then, in the stretches where the best cuts can still lie, finer ones,
until the capacity is settled exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

POINTS = 20_000
"""Running sums that the driver sees in a round of the search, whatever the input."""
BLOCK_BITS = 12
"""Running sums are computed inside 2**12 ranges of the hash and shifted by the ranges' sums."""


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1 (null: 1)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def group_key(text: Column) -> Column:
    """The hash that orders the groups; null and empty texts are one group.  Texts that share a
    hash by chance stay together, which changes no promise."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def running_sums(groups: DataFrame) -> DataFrame:
    """(key, size) -> (key, size, upto): size of all groups up to and with this one, by key."""
    blocks = groups.withColumn("block", F.shiftright("key", 64 - BLOCK_BITS))
    sums = blocks.groupBy("block").agg(F.sum("size").alias("s"))
    # at most 2**BLOCK_BITS rows
    offsets = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    w = Window.partitionBy("block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return (blocks.withColumn("inside", F.sum("size").over(w)).join(offsets, "block")
            .select("key", "size", (F.col("before") + F.col("inside")).alias("upto")))


def known_ends(sums: DataFrame, ranges: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums inside the position ranges [a, b], thinned: the last in each stretch of ``width``
    positions, with the number of groups that end in the stretch."""
    near = " OR ".join(f"upto BETWEEN {a} AND {b}" for a, b in ranges)
    which = " ".join(f"WHEN upto BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(ranges))
    begin = " ".join(f"WHEN upto BETWEEN {a} AND {b} THEN {a}" for a, b in ranges)
    rows = (sums.where(near).groupBy(F.expr(f"CASE {which} END").alias("r"),
                                     F.expr(f"(upto - CASE {begin} END) DIV {width}").alias("stretch"))
            .agg(F.max("upto").alias("end"), F.count("*").alias("n")).select("end", "n").toPandas())
    rows = rows.sort_values("end")
    return rows["end"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def greedy_ends(ends: np.ndarray, whole: np.ndarray, read: list[tuple[int, int]], capacity: int, n_shards: int,
                hopeful: bool) -> list[int]:
    """Where a greedy cut ends the shards, as far as the known ends tell: at the last known end that
    fits, or (``hopeful``) as far as a group not yet known could reach."""
    out, at = [], 0
    for _ in range(n_shards - 1):
        i = int(np.searchsorted(ends, at + capacity, "right"))
        reached = int(ends[i - 1]) if i else 0
        if hopeful and i < len(ends) and not whole[i] and not any(
                a <= reached and at + capacity <= b for a, b in read):
            reached = max(reached, min(at + capacity, int(ends[i]) - 1))
        at = max(at, reached)
        out.append(at)
    return out


def minimax_cuts(sums: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running sums at which its greedy cut ends a shard.

    The binary search runs over known ends; where they leave the capacity open, the stretches in
    which the cuts can lie are read again, finer, until it is settled."""
    total, largest = sums.agg(F.max("upto"), F.max("size")).first()
    if not total:
        return 0, [0] * (n_shards - 1)
    ends, whole, ranges = np.zeros(0, np.int64), np.zeros(0, bool), [(0, total)]
    read: list[tuple[int, int]] = []  # ranges of which every end is known

    def smallest(low: int, high: int, hopeful: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if total - greedy_ends(ends, whole, read, middle, n_shards, hopeful)[-1] <= middle:
                high = middle
            else:
                low = middle + 1
        return low

    width = total
    while True:
        width = max(1, min(sum(b - a + 1 for a, b in ranges) // POINTS, width // 8))
        got, n = known_ends(sums, ranges, width)
        # an end is whole if no unknown group ends between it and the known end before it
        known = np.union1d(ends[whole], got[n == 1])
        ends = np.union1d(ends, got)
        whole = np.isin(ends, known)
        if (n == 1).all():
            read += ranges
        low = smallest(max(largest, -(-total // n_shards)), total, True)
        high = smallest(low, total, False)
        if low == high:
            return high, greedy_ends(ends, whole, read, high, n_shards, False)
        ranges = merged(list(zip(greedy_ends(ends, whole, read, low, n_shards, False),
                                 greedy_ends(ends, whole, read, high, n_shards, True))))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_map(docs: DataFrame, n_shards: int = 8, text_col: str = "text") -> tuple[int, list[int | None]]:
    """The minimax capacity and, for each shard but the last, the last group key in it (None: the
    shard is empty)."""
    groups = docs.select(group_key(F.col(text_col)).alias("key"), text_size(F.col(text_col)).alias("size")) \
        .groupBy("key").agg(F.sum("size").alias("size"))
    sums = stored(running_sums(groups), "running-sums")
    capacity, ends = minimax_cuts(sums, n_shards)
    wanted = sorted(set(ends) - {0})
    keys = {r.upto: r.key for r in sums.where(F.col("upto").isin(wanted)).collect()} if wanted else {}
    return capacity, [keys.get(e) for e in ends]


def shard_of(key: Column, cuts: list[int | None]) -> Column:
    """Shard of a group key: the first shard whose last key is not below it."""
    out = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        if cuts[i] is not None:
            out = F.when(key <= F.lit(cuts[i]), F.lit(i)).otherwise(out)
    return out.cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                  slot_blocks: int = 512) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Slots are gapless from 0 in each shard.  They are numbered inside ``slot_blocks`` parts of a
    shard (by a hash of id and size, so neither a shard nor a large group of copies is one task)
    and shifted by the parts' counts, a table of at most n_shards * slot_blocks rows.
    Null text: size 1, crc32 of nothing, grouped with empty texts.  Repeated rows take slots of
    their own.  An empty table gives an empty result."""
    _, cuts = shard_map(docs, n_shards, text_col)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(group_key(text), cuts).alias("shard"),
    ).withColumn("part", F.pmod(F.xxhash64("id", "size"), F.lit(slot_blocks)))
    rows = stored(rows, "shard-rows")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part"))
                                             - F.col("n")).alias("before"))
    w = Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32")
    return (rows.withColumn("rn", F.row_number().over(w).cast("long") - 1).join(before, ["shard", "part"])
            .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("rn")).alias("slot")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, text_col: str = "text") -> None:
    """Write the rows themselves, with all their columns, one folder per shard (``shard=0`` ...).  Null texts are
    of the group of the empty text; an empty table writes no folder.  A column named shard is an error."""
    if "shard" in docs.columns:
        raise ValueError("the table has a column named shard")
    _, cuts = shard_map(docs, n_shards, text_col)
    docs.withColumn("shard", shard_of(group_key(F.col(text_col)), cuts)).write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents into shards 0 to 7 under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, 8).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
