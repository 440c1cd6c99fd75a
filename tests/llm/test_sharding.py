"""Minimax sharding against a brute-force binary search over the same ordered groups."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import sharding as S


def brute(sizes, k):
    def need(cap):
        shards, room = 1, cap
        for s in sizes:
            if s > room:
                shards, room = shards + 1, cap
            room -= s
        return shards
    low, high = max(max(sizes), -(-sum(sizes) // k)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if need(mid) <= k:
            high = mid
        else:
            low = mid + 1
    return low


@pytest.mark.parametrize("n,k,points", [(1, 8, 20000), (400, 8, 20000), (900, 4, 400)])
def test_capacity_is_minimal_and_the_plan_keeps_it(spark, monkeypatch, n, k, points):
    monkeypatch.setattr(S, "POINTS", points)  # few points: several rounds
    rng = random.Random(n * k + points)
    rows = []
    for i in range(n):
        copies = 1 if rng.random() < 0.8 else rng.randint(2, 30)
        rows += [(len(rows) + j, f"t{i}" + "x" * (i * 37 % 900))
                 for j in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    capacity, cuts = S.shard_map(docs, k)
    groups = docs.select(S.group_key(F.col("text")).alias("k"), S.text_size(F.col("text")).alias("s")) \
        .groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    assert capacity == brute([g.s for g in groups], k)
    out = S.assign_shards(docs, k).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert max(load.values()) == capacity and set(load) <= set(range(k))
    assert sorted(r.id for r in out) == list(range(len(rows)))
    text = dict(rows)
    homes = {}
    for r in out:
        assert homes.setdefault(text[r.id], r.shard) == r.shard
    for s in load:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_edges(spark):
    schema = "doc_id long, text string, shard string, key int, size int"
    assert S.assign_shards(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "a", 1, 1), (1, None, "a", 1, 1), (1, "", None, None, None), (1, "", None, None, None),
            (2, "é" * 50_000, "b", 2, 2)]
    out = S.assign_shards(spark.createDataFrame(rows, schema), 8).collect()
    assert len(out) == 5
    assert {r["size"] for r in out} == {1, 100_001}
    assert len({r.shard for r in out if r["size"] == 1}) == 1 and {r.text_crc32 for r in out if r["size"] == 1} == {0}


def test_registered_query(spark):
    import binascii

    from threadlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op1_sharding"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert len(out) == len(docs) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    for r in out.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == binascii.crc32(raw)
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() <= load.sum() / 8 + out["size"].max()
    for _, part in out.groupby("shard"):
        assert np.array_equal(np.sort(part.slot.to_numpy()), np.arange(len(part)))


def test_write_shards_writes_every_row_where_it_is_assigned(spark, tmp_path):
    import pytest
    rows = [(i, t, "x") for i, t in enumerate([None, "", "a", "a", "long " * 5000, "é", None] + [f"text {i}" for i in range(60)])]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, size string")
    S.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "size").collect())) == sorted(map(str, docs.collect()))
    want = {(r.id, r.size): r.shard for r in S.assign_shards(docs, 4).collect()}
    assert all(want[(r.doc_id, len((r.text or "").encode()) + 1)] == r.shard for r in back.collect())
    with pytest.raises(ValueError):
        S.write_shards(docs.withColumnRenamed("size", "shard"), f"{tmp_path}/no", 4)
