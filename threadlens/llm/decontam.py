"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item gives windows of ``window`` consecutive words (a shorter item one window).  The
shingles (word pairs) of a window are ordered by how rare they are in the whole corpus.  A place in a
document that holds the window holds every shingle of it, so the rarest alone is the necessary prefix:
documents meet windows on that shingle only.  The shingle's place in the window fixes where the window
would begin; the bounds of the document are checked (length, position), and the words of that
stretch are compared one by one.

The windows alone (each distinct one once, whatever items share it) are broadcast, so no document text crosses
a shuffle: the join sits on the scan.  Where there are more of them than ``BROADCAST_ROWS`` the places of
all shingles are dealt by their hash instead, in one pass, and the few texts with a candidate meet those by
their key.  Items join the windows found at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored
from .licenses import NON_WORD, spaced_words, words_of

BROADCAST_ROWS = 200_000
"""Windows that may be broadcast ..."""
BROADCAST_CHARS = 40_000_000
"""... and the characters that they may have in all."""
SECTION = 4096  # words of a text that one group of its stretches covers


def text_key(text: Column) -> Column:
    """Identity of a text: copies share it, and so their result."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def split_text(text: Column) -> Column:
    """The words of a document in one pass over it; an empty string may stand before the first word and
    behind the last one (it equals no item's word)."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, -1)


def empty_before(parts: Column) -> Column:
    return F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)


def n_words(parts: Column) -> Column:
    behind = F.when((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == ""), 1).otherwise(0)
    return (F.size(parts) - empty_before(parts) - behind).cast("long")


def shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of the ``width`` words from position ``at`` (from 0)."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win, n): every window of every item, each distinct one once per item.  Items without
    words have none."""
    w = items.select(F.col(id_col).alias("item"), words_of(spaced_words(F.col(text_col))).alias("words"))
    w = w.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    return w.select("item", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))).alias("win")).distinct()


WINDOW_KEY = ["w1", "w2"]


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "item_id", doc_text: str = "text",
                item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """((key, start, n, w1, w2), (w1, w2, item)): every place of a document text (by its key) that holds a
    window (by its key), and the items of each window."""
    windows = stored(item_windows(items, id_col, item_text, window).withColumns(
        {"w1": F.xxhash64("win"), "w2": F.xxhash64(F.lit(1), F.col("win"))}), "windows")
    once = windows.select("w1", "w2", "n", "win").distinct()
    texts = docs.select(F.col(doc_text).alias("text"))
    words = texts.select(text_key(F.col("text")).alias("key"), split_text(F.col("text")).alias("words"))
    found = None
    for width, some in ((1, once.where("n = 1")), (2, once.where("n > 1"))):
        part = _occurrences(words, some, width)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = once.limit(0).select(F.lit("").alias("key"), F.lit(0).alias("start"), "n", *WINDOW_KEY)
    return stored(found.distinct(), "occurrences"), windows.select(*WINDOW_KEY, "item")


def _occurrences(words: DataFrame, windows: DataFrame, width: int) -> DataFrame | None:
    shingles = windows.select("w1", "w2", "n", "win", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("n") - width), lambda i: shingle(F.col("win"), i, width))).alias("off", "h"))
    vocabulary = stored(shingles.select("h").distinct(), "item-shingles")
    size = vocabulary.count()
    if not size:
        return None
    placed = words.select("key", "words", F.posexplode("words").alias("at", "word"))
    hashed = placed.withColumn("h", shingle(F.col("words"), F.col("at"), width))
    # rarity over the whole corpus
    known = F.broadcast(vocabulary) if size <= BROADCAST_ROWS * 10 else vocabulary
    seen = hashed.select("h").join(known, "h").groupBy("h").agg(F.count("*").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off"))
    prefix = (shingles.join(seen, "h", "left").groupBy("w1", "w2", "n", "win").agg(rarest.alias("r"))
              .where("r.df > 0")  # a shingle that no document has: nor has any the window
              .select("w1", "w2", "n", "win", "r.h", "r.off"))
    prefix = stored(prefix, "prefixes")
    total, chars = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "win"))), F.lit(0))).first()
    start = F.col("at") - F.col("off")
    place = ["key", (start - empty_before(F.col("words"))).alias("start"), "n", *WINDOW_KEY]
    same = F.slice("words", start + 1, F.col("n")) == F.col("win")
    bounds = (start >= 0) & (start + F.col("n") <= F.size("words"))
    if total <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        return hashed.join(F.broadcast(prefix), "h").where(bounds).where(same).select(*place)
    candidates = hashed.withColumn("size", F.size("words")).select("key", "at", "h", "size").join(prefix, "h") \
        .where((start >= 0) & (start + F.col("n") <= F.col("size"))).select("key", "at", "off", "n", "win", *WINDOW_KEY).distinct()
    candidates = stored(candidates, "window-candidates")
    texts = words.join(candidates.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"])
    return candidates.join(texts, "key").where(same).select(*place)


def text_hits(found: DataFrame, window_items: DataFrame) -> DataFrame:
    """(key, n_hit, items): words inside any occurrence, and the items with one (sorted texts).

    A text is counted in sections of ``SECTION`` words, each by itself, so one long text full of windows
    is as many groups as it has sections; a stretch that reaches over an edge is cut there."""
    end = F.col("start") + F.col("n")
    sections = F.sequence(F.floor(F.col("start") / SECTION), F.floor((end - 1) / SECTION))
    pieces = (found.select("key", "start", "n").distinct()
              .select("key", F.col("start").alias("a"), end.alias("b"), F.explode(sections).alias("section"))
              .select("key", "section", F.greatest("a", F.col("section") * SECTION).alias("start"),
                      F.least("b", (F.col("section") + 1) * SECTION).alias("end")))
    # where the pieces up to here end decides how many words of the next are new
    w = Window.partitionBy("key", "section").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = pieces.select("key", F.greatest(F.lit(0), F.col("end") - F.greatest(
        "start", F.coalesce(F.max("end").over(w), F.lit(0)))).alias("new"))
    hits = new.groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    items = (found.select("key", *WINDOW_KEY).distinct().join(window_items, WINDOW_KEY)
             .select("key", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return hits.join(items, "key")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                  doc_text: str = "text", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (array of item ids as sorted text).

    Null and empty texts have no words; items without words match nothing; an item without an id
    marks words but is no entry of ``items``.  Repeated rows keep a row each; empty tables give no
    rows, or no hits."""
    # a table of its own: the rows of a text with many copies meet it in a join that Spark can split
    hits = stored(text_hits(*occurrences(docs, items, item_id, doc_text, item_text, window)), "text-hits")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).select(
        "id", text_key(F.col("text")).alias("key"), split_text(F.col("text")).alias("parts")) \
        .select("id", "key", n_words(F.col("parts")).alias("n_words"))
    return rows.join(hits, "key", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", doc_text: str = "text",
                      item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns.  Null and empty texts
    hold none and stay, as do all rows where there are no items."""
    name = next(f"_key{i}" for i in range(99) if f"_key{i}" not in set(docs.columns))
    bad = occurrences(docs, items, item_id, doc_text, item_text, window)[0].select(F.col("key").alias(name)).distinct()
    # the keys are the small side at any size: hashed in each partition, the texts need no sort
    return docs.withColumn(name, text_key(F.col(doc_text))).join(bad.hint("shuffle_hash"), name, "left_anti") \
        .select(*docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Registered query: benchmark windows in all documents."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _oracle(window: int = 10) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                      regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}') AS ws FROM benchmark),
    win AS (SELECT DISTINCT item_id, n, ws[i : i + n - 1] AS win FROM (
              SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
              FROM (SELECT item_id, ws, least(len(ws), {window}) AS n FROM b) WHERE n > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    place AS (SELECT r, n, i, ws[i : i + n - 1] AS win FROM (
                SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
    met AS (SELECT place.r, place.i, place.n, win.item_id FROM place JOIN win USING (n, win)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
    item AS (SELECT r, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
             FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)"""


ORACLE = _oracle()
