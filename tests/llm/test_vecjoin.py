"""Embedding links against brute force in double precision."""

import numpy as np
import pytest

from threadlens.llm import vecjoin as V


def brute(rows, cosine):
    good = {i: np.array(v, float) / np.abs(np.array(v, float)).max() for i, (_, v) in enumerate(rows)
            if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)}
    near = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    near[i].append(j)
    comp = {}
    for i in near:
        if i in comp:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        for j in seen:
            comp[j] = min(ids) if ids else None
    return sorted((r[0] if r[0] is not None else -1, len(near[i]), comp[i] if comp[i] is not None else -1,
                   r[0] is not None and r[0] == comp[i]) for i, r in enumerate(rows))


def got(df):
    return sorted((r.id if r.id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1,
                   r.kept) for r in df.collect())


@pytest.mark.parametrize("dims,tile", [(16, None), (6, 40)])
def test_equals_brute_force(spark, dims, tile):
    rng = np.random.default_rng(dims)
    rows = []
    for c in range(30):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows) * 7 % 1009, (centre + rng.normal(size=dims) * 0.25 * rng.random()).tolist()))
    rows += [(2000 + i, rows[3][1]) for i in range(20)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(V.near_duplicates(df, cosine=0.9, tile_rows=tile)) == brute(rows, 0.9)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, row int, id string"
    assert V.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = [1.0, 2.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, one), (7, one), (None, one), (8, [2.0, 4.0, 0.0]), (9, [1.0, 2.0]),
            (10, [-1.0, -2.0, -0.0]), (None, [0.0, 0.0, 5.0]), (11, [1.0, 2.0, -0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    assert got(V.near_duplicates(df)) == brute(rows, 0.9)


def test_registered_query(spark):
    from threadlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op8_embedding_dedup"](spark, sf).withColumnRenamed("vec_id", "id")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(out) == brute(rows, 0.9)


def test_very_small_and_very_large_components(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        v = rng.normal(size=6)
        rows += [(3 * i, (v * scale).tolist()) for scale in (1.0, 1e200, 1e-200)][: 1 + i % 3]
    rows += [(900, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0]), (901, [1.0, 1e-200, 0.0, 0.0, 0.0, 0.0]), (902, [1e308] * 6), (903, [1e-308] * 6)]
    out = got(V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert out == brute(rows, 0.9) and next(r for r in out if r[0] == 902)[1] == 1


def test_a_full_tile_of_near_copies_is_quick():
    """16,384 near-copies: every pair linked; both ways of working out links agree on a part of them."""
    import time
    rng = np.random.default_rng(1)
    x = V.unit(np.ones((16_384, 64)) + rng.normal(size=(16_384, 64)) * 0.05)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    plan = V.block_plan(np.linspace(2, 1, 64), 4, 0.2)
    ids, copies = np.arange(len(x)), np.ones(len(x), np.int64)
    began = time.time()
    out = V.join_tiles((ids, copies, x), (ids, copies, x), True, axes, plan, 0, 0.9)
    took = time.time() - began
    assert took < 20 * 8, took  # 20 s on a free core
    assert sum(n for _, b, n in out if b is None) == 16_384 * 16_383
    assert sum(b is not None for _, b, _ in out) == 16_383
    few, some = x[:700], V.unit(x[:700] + rng.normal(size=(700, 64)) * 0.3)
    y, z = some, some @ axes
    for block, (a, b, share) in enumerate(plan):
        near = V.squared(z[:, a:b], z[:, a:b]) <= share + 2 * V.SLACK
        dense = {p for i, j in V.linked_dense(near, y, y, z, z, plan, block, 0.9) for p in zip(i.tolist(), j.tolist())}
        sparse = {p for i, j in V.linked_sparse(near, y, y, z, z, plan, block, 0.9) for p in zip(i.tolist(), j.tolist())}
        assert dense == sparse


def test_forest_spans_what_it_is_given():
    rng = np.random.default_rng(2)
    f, parent = V.Forest(300), list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for _ in range(20):
        i, j = rng.integers(0, 300, 15), rng.integers(0, 300, 15)
        u, v = f.add(i, j)
        joined = 0
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[ra] = rb
                joined += 1
        assert len(u) == joined
        same = {}
        assert all(same.setdefault(find(k), f.root[k]) == f.root[k] for k in range(300)) and len(same) == len(set(f.root.tolist()))
