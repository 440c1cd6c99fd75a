"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send a module's functions with the task, so Python workers need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays.  For texts of ASCII alone that is ``lower``, which is
    faster than a character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared folder and read it back.

    Cuts lineage and fixes the rows: what is computed from the table is the same however often
    an executor is lost and a task runs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as edges (a, b): one row (node, root)
    for each node that has an edge to another, root being the smallest node of its component.

    Alternating large-star and small-star rounds: each round points neighbours at the smallest
    node seen, so a chain of n nodes needs about log n rounds.  Every round is written to the
    shared folder, and only two numbers per round reach the driver."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "edges")
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
            .select("s.a", "s.b").where("a <> b").distinct())
        e = stored(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
