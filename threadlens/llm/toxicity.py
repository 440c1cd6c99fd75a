"""Toxicity by non-negative positive-unlabelled learning.

A sparse linear model over hashed word features learns from documents confirmed as toxic and from
unlabelled text.  With the share p of toxic documents known, the risk of calling the rest clean is
E_unlabelled[loss(-)] - p E_toxic[loss(-)]; its estimate must not fall below 0 (Kiryo et al., 2017), else
the step climbs back.  A word's score does not depend on its document, so documents are scored by
summing the scores of their distinct words.

The model is fitted in one task on a bounded sample (``max_positive`` and ``max_unlabelled`` documents,
drawn by a hash of the id; of rows that share an id one, by a hash of its features).  The class prior is counted
over all labels, as (toxic + 1/2) / (labels + 1), which is never 0 or 1; every whole text is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_of_id, ship, stored

ship(__name__)

FEATURE_BITS = 20
CACHE_WORDS = 1_000_000
# A-Z lower-cased; every other ASCII character but a-z and 0-9 parts words
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32
                   for c in range(256))


def distinct_words(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(WORD_BYTES).split())


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 4 and 6 bytes."""
    mask = (1 << FEATURE_BITS) - 1
    out = [zlib.crc32(word) & mask]
    if len(word) > 4:
        out.append(zlib.crc32(word[:4], 1) & mask)
    if len(word) > 6:
        out.append(zlib.crc32(word[:6], 2) & mask)
    return out


def featured(rows: DataFrame) -> DataFrame:
    """(id, text, toxic) -> (id, toxic, features): the features of all distinct words, sorted."""
    def run(batches):
        for batch in batches:
            found = [sorted(f for w in distinct_words(t) for f in word_features(w))
                     for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                                             ["id", "toxic", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "toxic").mapInArrow(run, f"id {kind}, toxic boolean, features array<int>")


def risk_and_step(scores: np.ndarray, weight_pos: np.ndarray, weight_unl: np.ndarray) -> tuple[float, np.ndarray]:
    """The estimated risk of calling clean documents toxic (its negative part), and the gradient of the non-negative
    risk with respect to the documents' scores: of prior * E_toxic[loss(+)] + negative part, or, where the
    negative part fell below 0, of minus that part alone, to climb back."""
    p = 1 / (1 + np.exp(-scores))
    clean_loss = np.logaddexp(0, scores)  # loss of calling it clean
    negative = weight_unl @ clean_loss - weight_pos @ clean_loss
    d_negative = (weight_unl - weight_pos) * p
    return float(negative), weight_pos * (p - 1) + d_negative if negative >= 0 else -d_negative


def fit(features: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, prior: float, steps: int = 150,
        rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-negative PU fit by proximal AdaGrad (L1) on the whole sample: (feature ids, weights, bias).
    ``features``: all documents' feature ids one after the other, ``lengths`` per document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # features in too few toxic documents can't be told from chance
    n_pos, n_unl = int(toxic.sum()), int((~toxic).sum())
    in_toxic = toxic[doc]
    pairs = np.unique(features[in_toxic].astype(np.int64) * len(lengths) + doc[in_toxic])
    ids, df = np.unique(pairs // len(lengths), return_counts=True)
    ids = ids[df >= max(3, n_pos // 500)]
    at = np.searchsorted(ids, features)
    known = (at < len(ids)) & (ids[np.minimum(at, max(len(ids) - 1, 0))] == features) if len(ids) else np.zeros(len(features), bool)
    col, doc = at[known], doc[known]
    w, bias = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    grad_sum, bias_sum = np.full(len(ids), 1e-8), 1e-8
    penalty = 0.3 * prior / np.sqrt(n_pos)  # a share of the noise in the mean of a feature over n_pos documents
    weight_pos = np.where(toxic, prior / n_pos, 0.0)
    weight_unl = np.where(toxic, 0.0, 1.0 / n_unl)
    for _ in range(steps):
        g = np.clip(bias + np.bincount(doc, w[col], len(lengths)), -30, 30)
        _, step = risk_and_step(g, weight_pos, weight_unl)
        gw = np.bincount(col, step[doc], len(ids))
        gb = step.sum()
        grad_sum += gw * gw
        bias_sum += gb * gb
        scale = rate / np.sqrt(grad_sum)
        w -= scale * gw
        w = np.sign(w) * np.maximum(np.abs(w) - scale * penalty, 0)
        bias -= rate / np.sqrt(bias_sum) * gb
    kept = w != 0
    return ids[kept], w[kept], float(bias)


def sample_ids(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct ids with the smallest hashes."""
    return rows.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
          max_positive: int = 4000, max_unlabelled: int = 12000) -> dict:
    """The model: {"prior", "bias", "ids", "weights"}.  Only rows whose crc32(id) mod 3 is not 1 are
    learnt from.  A document is toxic if any of its labels says so.  Without toxic documents the
    model is the prior alone."""
    known = (labels.select(F.col(id_col).alias("id"), (F.col(toxic_col) == 1).alias("toxic"))
             .where(F.col("toxic").isNotNull() & F.col("id").isNotNull()).where(crc_of_id("id") % 3 != 1)
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    known = stored(known, "toxic-labels")
    n, n_toxic = known.agg(F.count("*"), F.count_if("toxic")).first()
    prior = (n_toxic + 0.5) / (n + 1) if n_toxic else 0.0
    empty = {"prior": prior, "bias": 0.0, "ids": np.zeros(0, np.int64), "weights": np.zeros(0)}
    if not n_toxic:
        return empty
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    learn = texts.where(F.col("id").isNotNull() & (crc_of_id("id") % 3 != 1))
    chosen = sample_ids(known.where("toxic"), max_positive, 1).withColumn("toxic", F.lit(True)).unionByName(
        sample_ids(learn, max_unlabelled, 2).withColumn("toxic", F.lit(False)))
    # at most max_positive + max_unlabelled ids, and one row of each
    some = learn.join(F.broadcast(stored(chosen, "toxic-sample")), "id")
    rows = stored(featured(some).groupBy("id", "toxic").agg(F.min_by("features", F.xxhash64("features")).alias("features")),
                  "toxic-features")

    def run(table):
        toxic = np.asarray(table.column("toxic"))
        if not toxic.any() or toxic.all():
            return pa.table({"f": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        column = table.column("features").combine_chunks()
        ids, w, bias = fit(np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths(), np.int64), toxic, prior)
        return pa.table({"f": np.append(ids, -1), "w": np.append(w, bias)})

    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "f long, w double").toPandas().sort_values("f")
    if not len(found):
        return empty
    return {"prior": prior, "bias": float(found.w.iloc[0]), "ids": found.f.to_numpy()[1:], "weights": found.w.to_numpy()[1:]}


class WordScores(dict):
    """Score of a word: the sum of its features' weights, kept once found."""

    def __init__(self, model: dict):
        self.weights = dict(zip(model["ids"].tolist(), model["weights"].tolist()))

    def __missing__(self, word: bytes) -> float:
        score = sum(self.weights.get(f, 0.0) for f in word_features(word))
        if len(self) < CACHE_WORDS:
            self[word] = score
        return score


def text_scores(texts: list[bytes | None], model: dict, scores: WordScores) -> np.ndarray:
    if not len(model["ids"]):
        return np.full(len(texts), model["prior"])
    g = np.array([model["bias"] + sum(map(scores.__getitem__, distinct_words(t))) for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def with_scores(docs: DataFrame, model: dict, text_col: str, name: str) -> DataFrame:
    """All rows and columns, and the score as a double named ``name``."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        scores = WordScores(model)
        for batch in batches:
            found = text_scores(batch.column(text_col).cast(pa.binary()).to_pylist(), model, scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.7, **bounds) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts have no words and get the model's bias.  Repeated rows keep a row each; an
    empty table gives none; without labels of toxic documents every score is 0."""
    model = train(docs, labels, id_col, text_col, **bounds)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_scores(rows, model, "text", "score").select(
        "id", (crc_of_id("id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.7, **bounds) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns.  Null and empty texts have
    the model's bias for a score."""
    name = next(f"_score{i}" for i in range(99) if f"_score{i}" not in set(docs.columns))
    scored = with_scores(docs, train(docs, labels, id_col, text_col, **bounds), text_col, name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Registered query: a toxicity score for every document."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
