"""Repeated lines across documents: lines found in many documents stay in one of them.

Lines are exploded with their position, normalised and hashed; documents are counted per hash; lines
whose hash reaches the threshold are dropped by position, and the rest of the text is put together again.

A line's key is 128 bits of hash, so no line's text crosses an exchange.  Counting shuffles by (key,
document) first and then sums partial counts per key; the lines meet the verdicts of frequent keys in a
join whose hot keys Spark splits (skew join); a document receives at most its own positions.  Texts cross
one exchange, to meet the positions to drop.

Null and empty texts are one empty line.  Documents are told apart by their id: rows of equal id count as
one document, rows without an id as one more, which is the smallest.  Rows of equal id and text get equal
results, each a row of its own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

WHITE = " \t\n\x0b\f\r"  # stripped at a line's ends
LINE_KEY = ["line1", "line2"]
ROW_KEY = ["id", "text_hash", "text_bytes"]


def row_key(text: Column) -> list[Column]:
    """With the id, these tell the rows of a table apart (equal rows need not be told apart)."""
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_bytes")]


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, text) -> one row per line of at least ``min_chars`` code points once normalised: the row's
    key, the line's position and its key."""
    hashed = rows.select("id", "text", *row_key(F.col("text")))  # below the explode: once per text
    lines = hashed.select(*ROW_KEY, F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(WHITE)))
    return stripped.where(F.length("line") >= min_chars).select(
        *ROW_KEY, "pos", F.xxhash64("line").alias("line1"), F.xxhash64(F.lit(1), "line").alias("line2"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, and the largest id that holds each."""
    held = lines.groupBy(*LINE_KEY, "id").agg(F.lit(1).alias("one"))
    return (held.groupBy(*LINE_KEY).agg(F.count("one").alias("docs"), F.max("id").alias("last"))
            .where(F.col("docs") >= min_docs).select(*LINE_KEY, "last"))


def without_positions(text: Column, dropped: Column) -> Column:
    """The text without the lines at these positions, in time linear in its lines.  The lines are bound
    once as a lambda's variable, as an expression inside a lambda would be split again for each line."""
    bound = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.get(lines, i)), "\n"))
    return F.get(bound, F.lit(0))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                        min_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns, as they are), ``kept`` (the text without the
    dropped lines), ``n_lines`` (before dropping) and ``n_dropped``.

    Lines of at least ``min_chars`` code points (stripped of white space, A-Z lower-cased) that are found in
    at least ``min_docs`` documents stay only in the document with the largest id, there as often as they
    occur."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = line_keys(rows, min_chars)
    # a table of its own: both sides of the join are plain exchanges then, whose hot keys Spark can split
    frequent = stored(frequent_lines(lines, min_docs), "frequent-lines")
    dropped = (lines.join(frequent, LINE_KEY).where(~F.col("id").eqNullSafe(F.col("last")))
               .groupBy(*ROW_KEY).agg(F.collect_set("pos").alias("dropped"))
               .select(*[F.col(c).alias(f"d_{c}") for c in ROW_KEY], "dropped"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = whole.select("row", "id", "text", *row_key(F.col("text"))).join(
        dropped.hint("shuffle_hash"),  # ids and positions alone: no sort of the texts
        (F.col("text_hash") == F.col("d_text_hash")) & (F.col("text_bytes") == F.col("d_text_bytes"))
        & F.col("id").eqNullSafe(F.col("d_id")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(without_positions(F.col("text"), F.col("dropped")))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return met.select("row", kept.alias("kept"), n_lines.cast("long").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: lines of at least 40 characters in at least 5 documents stay in the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs, min_chars=40, min_docs=5).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS MATERIALIZED (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
frequent AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k
  HAVING count(DISTINCT coalesce(cast(doc_id AS VARCHAR), 'none')) >= 5),
judged AS (
  SELECT a.*, f.k IS NOT NULL AND a.doc_id IS DISTINCT FROM f.last AS gone FROM keyed a LEFT JOIN frequent f USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
