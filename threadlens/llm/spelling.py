"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Words one edit apart differ little in their letter counts: one letter more or less is a squared distance of
1, one letter replaced is 2.  Words are filed in blocks by how many letters they have of each of a few
groups of letters (which gives the length too).  One edit leads to the same block, to one with one letter
more, or to one with a letter moved from one group to another; a word is sent to those neighbours, one way
of each pair, so every two words meet once.  In a block, NumPy products of letter counts give all squared
distances at once; pairs of 1 or 2 are compared letter by letter.

The groups balance the letters' variances, and their number follows from the count of words, as the one of
least expected work; any number finds the same pairs.  A block of more than ``BLOCK_WORDS`` words is cut into
parts, each of which meets the rest; a task holds one part and reads the words sent to it as a stream.

Counting words is a map over texts with partial counts, then one sum per word.  Null texts have no words; a
null id is written as nothing where the id counts.  Repeated rows count again.  Words hold letters up to
U+00FF only, so a byte (ISO 8859-1) is a code point.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

BLOCK_WORDS = 4096  # of one part of a block
BLOCK_BYTES = 32 << 20
FLUSH = 400_000  # distinct words that a task counts before it hands on partial counts
CELLS = 1 << 22  # of one product, and of letters compared at once
LETTERS = np.array([c for c in range(256) if 97 <= c <= 122 or c >= 0xC0], np.uint8)
SLOT = np.zeros(256, np.int64)
SLOT[LETTERS] = np.arange(len(LETTERS))
# bytes of ISO 8859-1 text: letters stay, A-Z become a-z, all else (and what has no such byte) a space
RUNS = bytes(c if c in set(LETTERS.tolist()) else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

Damage = Callable[[object, bytes], bytes]


def drop_a_letter(doc_id, run: bytes) -> bytes:
    """The run, one letter less if 97 divides the crc32 of ``<doc_id>:<run>`` (UTF-8)."""
    prefix = b"" if doc_id is None else str(doc_id).encode()
    h = zlib.crc32(prefix + b":" + (run if run.isascii() else run.decode("latin-1").encode()))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_letters: int = 5, min_count: int = 3, id_col: str = "doc_id",
                text_col: str = "text", damage: Damage | None = None) -> DataFrame:
    """(word, n): maximal runs of letters (A-Z and a-z, U+00C0 to U+00FF), A-Z lower-cased, each changed by
    ``damage`` if given, of at least ``min_letters`` letters and ``min_count`` occurrences overall."""
    def run(batches):
        total: Counter = Counter()

        def batch_of():
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in total], pa.string()),
                                              "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                if not text:
                    continue
                plain = text if text.isascii() else text.decode("utf-8", "replace").encode("latin-1", "replace")
                for word, n in Counter(plain.translate(RUNS).split()).items():
                    if damage is not None:
                        word = damage(doc_id, word)
                    if len(word) >= min_letters:
                        total[word] += n
                if len(total) > FLUSH:
                    yield batch_of()
        if total:
            yield batch_of()

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Words:
    """Some words of an Arrow batch: their letters, letter counts and frequencies."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.words, self.n = words, n
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = words.buffers()[2]
        self.letters = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.start, self.length = at[:-1] - at[0], np.diff(at)
        rows = np.repeat(np.arange(len(words)), self.length)
        flat = np.bincount(rows * len(LETTERS) + SLOT[self.letters], minlength=len(words) * len(LETTERS))
        exact = np.float32 if not len(words) or self.length.max() < 2000 else np.float64
        self.counts = flat.reshape(len(words), len(LETTERS)).astype(exact)
        self.norms = np.einsum("ij,ij->i", self.counts, self.counts)

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The letters of these rows side by side, zeros behind."""
        cols = np.arange(width)
        inside = cols < self.length[rows][:, None]
        out = np.zeros((len(rows), width), np.uint8)
        out[inside] = self.letters[(self.start[rows][:, None] + cols)[inside]]
        return out


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """For pairs (a[i], b[j]): do they differ by exactly one replaced, inserted or deleted letter?"""
    la, lb = a.length[i], b.length[j]
    width = int(max(la.max(), lb.max())) + 1
    x, y = a.padded(i, width), b.padded(j, width)
    swap = la > lb
    x[swap], y[swap] = y[swap], x[swap]
    short, longer = np.minimum(la, lb), np.maximum(la, lb)
    at = np.arange(width)
    inside = at < short[:, None]
    differ = (x != y) & inside
    replaced = (short == longer) & (differ.sum(1) == 1)
    first = np.where(differ.any(1), differ.argmax(1), short)
    shifted = (x[:, :-1] != y[:, 1:]) & inside[:, :-1]
    last = np.where(shifted.any(1), width - 2 - shifted[:, ::-1].argmax(1), -1)
    return replaced | ((longer == short + 1) & (last < first))


def near_pairs(a: Words, b: Words, same: bool = False):
    """Index arrays (i, j) of the words one edit apart; ``same``: b is a, each pair once."""
    step = max(1, CELLS // max(1, len(a.n)))
    for lo in range(0, len(b.n), step):
        part = slice(lo, lo + step)
        distance = a.norms[:, None] + b.norms[part][None, :] - 2 * (a.counts @ b.counts[part].T)
        near = (distance <= 2) & (distance > 0)
        if same:
            near &= np.arange(len(a.n))[:, None] < np.arange(lo, min(lo + step, len(b.n)))[None, :]
        i, j = np.nonzero(near)
        j += lo
        if len(i):
            width = int(max(a.length[i].max(), b.length[j].max())) + 1
            for at in range(0, len(i), max(1, CELLS // width)):
                ii, jj = i[at:at + max(1, CELLS // width)], j[at:at + max(1, CELLS // width)]
                good = one_edit(a, ii, b, jj)
                if good.any():
                    yield ii[good], jj[good]


def meet(batches):
    """Sorted (key, part, visits, word, n): of each part first its own words, then those sent to it ->
    (word, near, near_n), both ways of each pair."""
    schema = pa.schema([("word", pa.binary()), ("near", pa.binary()), ("near_n", pa.int64())])
    block, homes = None, []

    def rows(a, b, pairs):
        for i, j in pairs:
            wa, wb = a.words.take(pa.array(i)), b.words.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([wa, wb]), pa.concat_arrays([wb, wa]),
                                              pa.array(np.concatenate([b.n[j], a.n[i]]))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, visits = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        n = batch.column(4).to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (visits[1:] != visits[:-1])) + 1
        for lo, hi in zip(np.concatenate(([0], edge)).tolist(), np.concatenate((edge, [len(key)])).tolist()):
            this = (key[lo], part[lo])
            if block != this:
                block, homes = this, []
            if visits[lo]:
                if homes:
                    some = Words(batch.column(3).slice(lo, hi - lo), n[lo:hi])
                    for home in homes:
                        yield from rows(home, some, near_pairs(home, some))
                continue
            some = Words(batch.column(3).slice(lo, hi - lo), n[lo:hi])
            yield from rows(some, some, near_pairs(some, some, same=True))
            for home in homes:
                yield from rows(home, some, near_pairs(home, some))
            homes.append(some)


def moves(groups: int) -> tuple[np.ndarray, list, list]:
    """A 64-bit weight per group; a block's key is the sum of its letters' weights, so one edit adds a fixed
    number to it.  The numbers of all edits differ, also from each other's negatives, which makes any two
    words meet once at most."""
    weights = np.random.default_rng(12).integers(1, 1 << 63, groups, dtype=np.uint64)
    added = [(g, int(weights[g])) for g in range(groups)]
    moved = [(g, (int(weights[h]) - int(weights[g])) % (1 << 64)) for g in range(groups) for h in range(g + 1, groups)]
    steps = [s for _, s in added + moved]
    assert len({x % (1 << 64) for s in steps for x in (s, -s)}) == 2 * len(steps)
    return weights, added, moved


def letter_groups(sums: dict[int, tuple[float, float]], n_words: int) -> list[list[int]]:
    """Letters in groups of like variance, as many as make the expected work least: rows sent to neighbour
    blocks against distances computed in a block."""
    variance = {c: s2 / n_words - (s / n_words) ** 2 for c, (s, s2) in sums.items()}
    best = None
    for count in range(1, 13):
        groups, spread = [[] for _ in range(count)], [0.0] * count
        for c in sorted(variance, key=lambda c: (-variance[c], c)):
            g = spread.index(min(spread))
            groups[g].append(c)
            spread[g] += variance[c]
        blocks = np.prod([max(1.0, (4 * np.pi * v) ** 0.5) for v in spread])  # the chance of a shared block, inverted
        copies = 1 + count + count * (count - 1) / 2
        work = copies * (200 + n_words / blocks)
        if best is None or work < best[0]:
            best = (work, groups)
    return best[1]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) distinct words -> (word, near, near_n): all pairs one edit apart, both ways."""
    def sums(batches):
        for batch in batches:
            counts = Words(batch.column(0), np.zeros(batch.num_rows)).counts.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(LETTERS.astype(np.int32)), pa.array(counts.sum(0)), pa.array((counts ** 2).sum(0)),
                                              pa.array(np.full(len(LETTERS), batch.num_rows, np.int64))], ["c", "s", "s2", "n"])

    base = words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")
    stats = base.select("word").mapInArrow(sums, "c int, s double, s2 double, n long").groupBy("c").agg(
        F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n")).collect()  # one row per letter
    groups = letter_groups({r.c: (r.s, r.s2) for r in stats if r.s}, stats[0].n) if stats else [[]]
    weights, added, moved = moves(len(groups))
    of_letter = np.zeros(256, np.int64)
    for g, letters in enumerate(groups):
        of_letter[letters] = g

    def send(batches):
        for batch in batches:
            w = Words(batch.column(0), batch.column(1).to_numpy())
            rows = np.repeat(np.arange(len(w.n)), w.length)
            held = np.bincount(rows * len(weights) + of_letter[w.letters], minlength=len(w.n) * len(weights)) \
                .reshape(len(w.n), len(weights))
            key = (held.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
            every = np.arange(len(w.n))
            out = [(key, every, False)] + [(key + np.uint64(s), every, True) for _, s in added]
            for g, s in moved:
                some = np.flatnonzero(held[:, g])
                out.append((key[some] + np.uint64(s), some, True))
            for keys, some, visits in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.full(len(some), visits)),
                     batch.column(0).take(pa.array(some)), pa.array(w.n[some])], ["key", "visits", "word", "n"])

    sent = base.mapInArrow(send, "key long, visits boolean, word binary, n long")
    sizes = sent.where("not visits").groupBy("key").agg(F.count("*").alias("size"), F.sum(F.octet_length("word")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK_WORDS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = stored(sizes.withColumn("parts", parts).where("parts > 1").select("key", "parts"), "large-blocks")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    last = F.when(F.col("visits"), F.col("parts") - 1).otherwise(F.col("own"))
    dealt = (sent.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
             .select("key", F.explode(F.sequence(F.lit(0), last)).alias("part"), "visits", "own", "word", "n")
             .select("key", "part", (F.col("visits") | (F.col("part") < F.col("own"))).alias("visits"), "word", "n"))
    return (dealt.repartition("key", "part").sortWithinPartitions("key", "part", "visits")
            .mapInArrow(meet, "word binary, near binary, near_n long")
            .select(F.decode("word", "ISO-8859-1").alias("word"), F.decode("near", "ISO-8859-1").alias("near"), "near_n"))


def roots_of(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, form) without cycles -> (word, root): the end of each chain, by doubling steps."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")), "roots")
        moved = step.agg(F.max("moved")).first()[0]
        now = step.select("word", "root")
        if not moved:
            return now
    raise RuntimeError(f"chains did not end in {max_rounds} rounds")


def spelling_variants(docs: DataFrame, min_letters: int = 5, min_count: int = 3, ratio: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", damage: Damage | None = None) -> DataFrame:
    """One row per word: word, form (the most frequent word one edit away, ties the smallest, if it is at least
    ``ratio`` times as frequent), root (the last form on the way), n, n_near and form_n."""
    words = stored(count_words(docs, min_letters, min_count, id_col, text_col, damage), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", "n_near", F.col("best.near").alias("near"),
                                                    (-F.col("best.col1")).alias("near_n"))
    good = F.col("near_n") >= F.col("n") * ratio
    formed = stored(found.select("word", F.when(good, F.col("near")).alias("form"), "n",
                                 F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(good, F.col("near_n")).alias("form_n")), "formed")
    roots = roots_of(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Registered query: variants among the words (5 letters, 3 occurrences) of all documents, some damaged."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_letters=5, min_count=3, ratio=2,
                             damage=drop_a_letter)


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS token FROM documents),
runs AS MATERIALIZED (
  SELECT doc_id, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM tokens GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                   ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS bytes
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])),
                     4294967295) AS h
  FROM bytes, crc_table),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS MATERIALIZED (
  SELECT word, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS rank
  FROM pairs p JOIN words w ON w.word = p.near),
formed AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND rank = 1),
chains AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends ON ends.word = formed.word
"""
