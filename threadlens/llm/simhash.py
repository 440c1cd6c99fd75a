"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint sums the bits of the XXH64 of its word shingles.  Fingerprints at most
``max_bits`` apart are linked: cut into ``blocks`` parts, such a pair agrees in at least
``blocks - max_bits`` of them, so it shares one of the keys made of that many parts.  Distinct
fingerprints meet on those keys, and the Hamming distance decides.  Copies of a text, however many,
are one fingerprint before the join, and a pair that meets on several keys counts on the first.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import components, ship, stored

ship(__name__)

SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint (unsigned) of one text; null and wordless texts have 0.
    Words are runs of non-white-space bytes, A-Z lower-cased; a text of fewer than ``width`` words is
    one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - width + 1].tolist(),
                                                            ends[width - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at:at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def add_fingerprints(docs: DataFrame, text_col: str, name: str, width: int = 3) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a (signed) long named ``name``."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def masks(blocks: int, shared: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``shared`` out of ``blocks`` nearly equal parts."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(c) for c in combinations(parts, shared)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def linked_pairs(prints: DataFrame, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """(fp) distinct -> (a, b), a < b, every pair at most ``max_bits`` apart, each once."""
    ms = masks(blocks, blocks - max_bits)
    keys = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(ms)])).alias("s")) \
        .select("fp", "s.k", "s.v")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first: Column = reduce(lambda rest, im: F.when(x.bitwiseAND(F.lit(im[1])) == 0, F.lit(im[0])).otherwise(rest),
                           reversed(list(enumerate(ms))), F.lit(-1))
    return (keys.alias("a").join(keys.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v"))
                                 & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= max_bits)
                                 & (first == F.col("a.k")))
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def fingerprint_components(prints: DataFrame, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """(id, fp) -> (fp, component_id): the smallest id over all fingerprints reachable by links.
    Null ids count for nothing; a component of null ids alone has a null id."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = components(linked_pairs(classes.select("fp"), max_bits, blocks))
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    changed = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    alone = classes.join(roots, classes.fp == roots.node, "left_anti") \
        .select("fp", F.col("least").alias("component_id"))
    return changed.unionByName(alone)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                       max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """One row per input row: id, fp (long), component_id.  Repeated rows and ids each keep a row;
    null and empty texts have fingerprint 0 and link like any other; an empty table gives none."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stored(add_fingerprints(narrow, "text", "fp", width).select("id", "fp"), "prints")
    return prints.join(fingerprint_components(prints, max_bits, blocks), "fp").select("id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                           max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest id (of
    equal ids, the row read first).  Every column stays as it is."""
    taken = set(docs.columns)
    row, fp = next(f"_row{i}" for i in range(99) if f"_row{i}" not in taken), \
        next(f"_fp{i}" for i in range(99) if f"_fp{i}" not in taken)
    rows = stored(add_fingerprints(docs, text_col, fp, width).withColumn(row, F.monotonically_increasing_id()), "printed")
    narrow = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    # the best row of each fingerprint, then of each component; ids order first, nulls last
    best = F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))
    per_print = stored(narrow.groupBy("fp").agg(F.min("id").alias("id"), best.alias("row")), "best-of-print")
    roots = components(linked_pairs(per_print.select("fp"), max_bits, blocks))
    per_component = (per_print.join(roots, per_print.fp == roots.node, "left")
                     .groupBy(F.coalesce("root", "fp").alias("c")).agg(best.alias("keep")))
    keep = per_component.select(F.col("keep").alias(row)).hint("shuffle_hash")  # ids alone: no sort of the texts
    return rows.join(keep, row, "left_semi").select(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Registered query: SimHash components of all documents (3-word shingles, 2 bits)."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")
