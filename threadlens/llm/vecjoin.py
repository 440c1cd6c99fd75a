"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less.  Vectors are rotated (principal
axes of all vectors) and split into a few low-dimensional blocks; each block gets a share of the squared
distance in proportion to its variance.  A close pair keeps within the share in at least one block, so
the union of the blocks' range joins holds every pair, and each candidate is verified exactly.

Range join of a block: its leading coordinate differs by at most the block's radius, so rows are cut
into strips that wide and a row meets its own strip and the next.  A strip of many rows is split into
tiles; a task joins two tiles.  A pair counts in the first block whose share it keeps, so link counts add
up.  Tasks return a count per row and a spanning forest of what they linked, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ship, stored

ship(__name__)

TILE_VALUES = 1 << 20
"""Components in a tile: 8 MB of doubles, so 16,384 rows of 64 dimensions.  Each row travels to as many
tiles as its strip and the next have, so small tiles would cost shuffle."""
CHUNK = 512
SLACK = 1e-9
ROUNDING = 1e-11  # more than a matrix product of unit rows errs by, less than the slack


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1, initial=0.0)[:, None]
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


class Forest:
    """Spanning forest of the pairs seen so far, over the numbered rows of two tiles."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of (i, j) that join two trees; each round hooks every higher root to a lower one."""
        out = []
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, at = np.unique(np.maximum(a, b), return_index=True)
            if not len(high):
                break
            out.append((i[at], j[at]))
            self.root[high] = np.minimum(a, b)[at]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        if not out:
            return i[:0], j[:0]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def rotation(classes: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes (columns, leading first) and their variances, from the second moments of all
    unit vectors.  Only dims * dims sums reach the driver."""
    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            for x in padded(batch.column(0), dims):
                x = unit(x)
                total += x.T @ x
        i, j = np.meshgrid(np.arange(dims), np.arange(dims), indexing="ij")
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32),
                                          "s": total.ravel()})

    rows = classes.select("vector").mapInArrow(moments, "i int, j int, s double") \
        .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    second = np.zeros((dims, dims))
    for r in rows:
        second[r.i, r.j] = r.s
    values, axes = np.linalg.eigh((second + second.T) / 2)
    return axes[:, ::-1].copy(), np.maximum(values[::-1], 0)


def padded(column, dims: int):
    """The arrays of a column as float64 rows, filled with zeros to ``dims``, some thousand at a time."""
    for at in range(0, len(column), 4096):
        part = column.slice(at, 4096)
        lengths = np.asarray(part.value_lengths())
        flat = np.asarray(part.flatten(), np.float64)
        if (lengths == dims).all():
            yield flat.reshape(-1, dims)
        else:
            x = np.zeros((len(part), dims))
            x[np.arange(dims)[None, :] < lengths[:, None]] = flat
            yield x


def block_plan(variances: np.ndarray, blocks: int, budget: float) -> list[tuple[int, int, float]]:
    """(first axis, end axis, share of the squared distance) of each block."""
    edges = np.linspace(0, len(variances), blocks + 1).round().astype(int)
    weights = np.array([max(variances[a:b].sum(), 1e-12) for a, b in zip(edges, edges[1:])])
    return [(int(a), int(b), float(budget * w)) for a, b, w in zip(edges, edges[1:], weights / weights.sum()) if b > a]


def strips(classes: DataFrame, axes: np.ndarray, plan, dims: int) -> DataFrame:
    """(id, dim, copies, vector, block, strip): the strip of each vector's leading coordinate in each block."""
    def run(batches):
        for batch in batches:
            parts = list(padded(batch.column(3), dims))
            if not parts:
                continue
            z = unit(np.concatenate(parts)) @ axes
            for k, (a, _, share) in enumerate(plan):
                wide = np.sqrt(share) * (1 + 1e-6) + 1e-9
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(z), k, np.int32)),
                     pa.array(np.floor(z[:, a] / wide).astype(np.int64))], ["id", "dim", "copies", "vector", "block", "strip"])

    return classes.select("id", "dim", "copies", "vector").mapInArrow(
        run, "id long, dim int, copies long, vector array<double>, block int, strip long")


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances between two sets of rows, up to rounding."""
    return np.einsum("ij,ij->i", left, left)[:, None] + np.einsum("ij,ij->i", right, right)[None, :] - 2 * (left @ right.T)


def linked_sparse(near, x, y, zx, zy, plan, block: int, least: float):
    """Of the cells marked ``near``: linked pairs whose first block is this one, each worked out by itself."""
    i_all, j_all = np.nonzero(near)
    for part in range(0, len(i_all), 65536):
        i, j = i_all[part:part + 65536], j_all[part:part + 65536]
        linked = np.einsum("ij,ij->i", x[i], y[j]) >= least
        i, j = i[linked], j[linked]
        first = np.ones(len(i), bool)
        for c, (lo, hi, s) in enumerate(plan[:block + 1]):
            d = np.square(zx[i, lo:hi] - zy[j, lo:hi]).sum(1) <= s + SLACK
            first &= d if c == block else ~d
        yield i[first], j[first]


def linked_dense(near, x, y, zx, zy, plan, block: int, least: float):
    """The same where many cells are near (copies of a few vectors): matrix products decide, and only cells
    within rounding of a limit are worked out by themselves, so both ways agree."""
    margin = x @ y.T - least
    close = np.abs(margin) < ROUNDING
    sure = near & (margin >= ROUNDING)
    for c, (lo, hi, s) in enumerate(plan[:block + 1]):
        d = squared(zx[:, lo:hi], zy[:, lo:hi]) - (s + SLACK)
        close |= np.abs(d) < ROUNDING
        sure &= d <= 0 if c == block else d > 0
    yield np.nonzero(sure & ~close)
    yield from linked_sparse(near & close, x, y, zx, zy, plan, block, least)


def join_tiles(own, other, same: bool, axes, plan, block: int, least: float):
    """Links of two tiles (ids, copies, unit vectors) counted in this block: rows (id, null, number of
    linked rows) and edges (id, id, 0) of a spanning forest."""
    (ids_a, copies_a, x), (ids_b, copies_b, y) = own, other
    sums_a, sums_b = np.zeros(len(x)), np.zeros(len(y))
    # rows of one tile have one number on either side
    shift = 0 if same else len(x)
    forest, edges = Forest(len(x) + (0 if same else len(y))), []
    zx, zy = x @ axes, y @ axes
    a, b, share = plan[block]
    for at in range(0, len(x), CHUNK):
        some, z = x[at:at + CHUNK], zx[at:at + CHUNK]
        near = squared(z[:, a:b], zy[:, a:b]) <= share + 2 * SLACK
        if same:
            near &= np.arange(len(y))[None, :] > np.arange(at, at + len(some))[:, None]
        way = linked_dense if np.count_nonzero(near) > near.size // 16 else linked_sparse
        for i, j in way(near, some, y, z, zy, plan, block, least):
            i = i + at
            sums_a += np.bincount(i, copies_b[j], len(x))
            sums_b += np.bincount(j, copies_a[i], len(y))
            u, v = forest.add(i, j + shift)
            edges += zip(ids_a[u].tolist(), ids_b[v - shift].tolist(), [0] * len(u))
    counts = [(int(i), None, int(n)) for ids, sums in ((ids_a, sums_a), (ids_b, sums_b))
              for i, n in zip(ids, sums) if n]
    return counts + edges


def links(classes: DataFrame, cosine: float, blocks: int, tile_rows: int | None) -> DataFrame:
    """(id, dim, copies, vector) -> (a, b, n): with b null, n rows linked with a row of class a, counted
    in one task; else a linked pair of classes of a spanning forest."""
    dims = classes.agg(F.max("dim")).first()[0] or 1
    tile_rows = tile_rows or max(256, TILE_VALUES // dims)
    axes, variances = rotation(classes, dims)
    plan = block_plan(variances, blocks, 2 - 2 * cosine)
    placed = stored(strips(classes, axes, plan, dims), "strips")
    # unit vectors: a block has at most 2 / radius + 2 strips, so these tables are small at any size
    per = stored(placed.groupBy("dim", "block", "strip").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")),
                 "strip-tiles")

    def tiles_at(step: int, name: str) -> DataFrame:
        return F.broadcast(per.select("dim", "block", (F.col("strip") - step).alias("strip"), F.col("tiles").alias(name)))

    s, t = F.col("strip"), F.col("tile")

    def meets(n, make):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())

    def pair(s1, t1, s2, t2, role):
        return F.struct(s1.alias("s1"), t1.alias("t1"), s2.alias("s2"), t2.alias("t2"), role.alias("role"))

    on = ["dim", "block", "strip"]
    tiled = (placed.join(tiles_at(0, "n0"), on).join(tiles_at(1, "n1"), on, "left").join(tiles_at(-1, "n2"), on, "left")
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("n0")).cast("int")))
    # a tile joins itself (role 0), the other tiles of its strip, and those of the next strip;
    # the first of a pair has role 1, the second role 2
    joins = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda j: pair(
            s, F.least(t, j), s, F.greatest(t, j), F.when(j == t, 0).when(t < j, 1).otherwise(2))),
        meets(F.coalesce("n1", F.lit(0)), lambda j: pair(s, t, s + 1, j, F.lit(1))),
        meets(F.coalesce("n2", F.lit(0)), lambda j: pair(s - 1, j, s, t, F.lit(2))))
    dealt = tiled.select("dim", "block", "id", "copies", "vector", F.explode(joins).alias("j")) \
        .select("dim", "block", "j.*", "id", "copies", "vector")

    def run(key, group):
        block = key[1].as_py()
        sides = []
        for role in (0, 1, 2):
            part = group.filter(pc.equal(group.column("role"), role)).sort_by("id")
            rows = [x for chunk in part.column("vector").chunks for x in padded(chunk, dims)]
            sides.append((part.column("id").to_numpy(), part.column("copies").to_numpy(),
                          unit(np.concatenate(rows)) if rows else np.zeros((0, dims))))
        alone, left, right = sides
        if len(alone[0]):
            out = join_tiles(alone, alone, True, axes, plan, block, cosine)
        else:
            out = join_tiles(left, right, False, axes, plan, block, cosine)
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("a", "b", "n"))})

    return stored(dealt.groupBy("dim", "block", "s1", "t1", "s2", "t2").applyInArrow(run, "a long, b long, n long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
                    blocks: int = 4, tile_rows: int | None = None) -> DataFrame:
    """One row per input row: id, n_links (other rows with that cosine or more), component_id
    (smallest id reachable over links, its own included), kept (id = component_id).

    Null and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different lengths.  Rows are numbered, so repeated rows are linked copies, each counted.
    A null id counts for no component; a component of null ids alone has a null id and keeps none."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = stored(vectors.select(F.col(id_col).alias("id"), F.when(good, F.transform(
        v, lambda x: x + F.lit(0.0))).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    linkable = rows.where("vector IS NOT NULL")
    # equal vectors are one class (96 bits of hash), named after its first row
    keyed = linkable.select("row", "id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    classes = stored(keyed.groupBy("h1", "h2").agg(F.min("row").alias("class"), F.count("*").alias("copies"),
                                                   F.min("id").alias("least")), "vector-classes")
    named = rows.select(F.col("row").alias("id"), "vector").join(
        classes.select(F.col("class").alias("id"), "copies"), "id").withColumn("dim", F.size("vector"))
    found = links(named, cosine, blocks, tile_rows)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("class"), "root")
    known = stored(classes.join(counts, "class", "left").join(roots, "class", "left").select(
        "h1", "h2", "least", F.coalesce("root", "class").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-links")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = known.join(least, "root").select("h1", "h2", "n_links", "component_id")
    linked = keyed.select("id", "h1", "h2").join(per_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: links at cosine 0.9 or more among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9) \
        .withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sized AS (
  SELECT r, vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS most FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
good AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: x / most) AS e FROM sized),
normed AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM good),
pairs AS MATERIALIZED (
  SELECT a.r, b.r AS other FROM normed a JOIN normed b ON len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, pairs.other FROM reach JOIN pairs ON pairs.r = reach.other),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r),
counts AS (SELECT r, count(*) AS n FROM pairs GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v LEFT JOIN counts USING (r) LEFT JOIN least USING (r)
"""
