"""Toxicity: held-out accuracy, what is learnt from, edges."""

import math
import os
import zlib

import numpy as np
import pytest

from threadlens.llm import toxicity as T


@pytest.mark.parametrize("sf,recall", [("sf0.1", 0.85), ("check_s", 0.9)])  # some 300 and 1,400 positives to learn from
def test_held_out_accuracy(spark, sf, recall):
    sf = f"/root/testdata/{sf}"
    if not os.path.isdir(sf):
        pytest.skip("no such tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.id: r for r in T.score_toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [(r.toxic, out[r.doc_id].predicted) for r in labels.collect() if out[r.doc_id].held_out]
    caught = [p for t, p in held if t]
    assert np.mean([t for t, p in held if p]) > 0.95 and np.mean(caught) > recall
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in out.items())


def plain_risk(g, toxic, prior):
    """The non-negative risk, term by term, and its negative part."""
    pos, unl = [x for x, t in zip(g, toxic) if t], [x for x, t in zip(g, toxic) if not t]
    mean = lambda xs: math.fsum(xs) / len(xs)
    positive = prior * mean([math.log1p(math.exp(-x)) for x in pos])
    negative = mean([math.log1p(math.exp(x)) for x in unl]) - prior * mean([math.log1p(math.exp(x)) for x in pos])
    return positive, negative


@pytest.mark.parametrize("shift", [-3.0, 0.0, 4.0])
def test_risk_and_gradient_equal_a_plain_version(shift):
    rng = np.random.default_rng(3)
    signs = set()
    for prior in (0.05, 0.4, 0.8):
        toxic = rng.random(40) < 0.4
        g = rng.normal(size=40) * 2 + np.where(toxic, shift, 0)
        pos, unl = np.where(toxic, prior / toxic.sum(), 0.0), np.where(toxic, 0.0, 1 / (~toxic).sum())
        negative, step = T.risk_and_step(g, pos, unl)
        positive, want = plain_risk(g, toxic, prior)
        assert negative == pytest.approx(want)
        signs.add(want >= 0)
        for i in range(40):  # the slope of the part that the step descends
            e = np.zeros(40)
            e[i] = 1e-6
            up, down = (plain_risk(g + k * e, toxic, prior) for k in (1, -1))
            slope = (sum(up) - sum(down)) / 2e-6 if want >= 0 else -(up[1] - down[1]) / 2e-6
            assert step[i] == pytest.approx(slope, abs=1e-7)
    assert shift < 4 or signs == {True, False}


def test_fit_equals_a_plain_version():
    """The whole fit, with dictionaries and loops."""
    rng = np.random.default_rng(5)
    docs = [sorted(set(rng.integers(0, 30, rng.integers(0, 12)).tolist()) | ({40, 41} if i % 3 == 0 else set())) for i in range(90)]
    toxic, prior = np.array([i % 3 == 0 for i in range(90)]), 0.3
    lengths = np.array([len(d) for d in docs])
    ids, w, bias = T.fit(np.array([f for d in docs for f in d], np.int64), lengths, toxic, prior, steps=25)
    df = {}
    for d, t in zip(docs, toxic):
        for f in d if t else ():
            df[f] = df.get(f, 0) + 1
    weights = {f: 0.0 for f in sorted(df) if df[f] >= 3}
    b, past, b_past, n_pos = math.log(prior / (1 - prior)), {f: 1e-8 for f in weights}, 1e-8, int(toxic.sum())
    penalty = 0.3 * prior / math.sqrt(n_pos)
    for _ in range(25):
        g = [b + math.fsum(weights.get(f, 0.0) for f in d) for d in docs]
        _, negative = plain_risk(g, toxic, prior)
        step = []
        for x, t in zip(g, toxic):
            p = 1 / (1 + math.exp(-x))
            d_neg = -prior / n_pos * p if t else p / (len(docs) - n_pos)
            step.append((prior / n_pos * (p - 1) if t else 0.0) + d_neg if negative >= 0 else -d_neg)
        for f in weights:
            grad = math.fsum(s for s, d in zip(step, docs) if f in d)
            past[f] += grad * grad
            moved = weights[f] - 0.5 / math.sqrt(past[f]) * grad
            weights[f] = math.copysign(max(abs(moved) - 0.5 / math.sqrt(past[f]) * penalty, 0.0), moved)
        b_past += math.fsum(step) ** 2
        b -= 0.5 / math.sqrt(b_past) * math.fsum(step)
    want = {f: x for f, x in weights.items() if x}
    assert ids.tolist() == sorted(want) and np.allclose(w, [want[f] for f in ids.tolist()], atol=1e-9) and bias == pytest.approx(b)
    assert 40 in want


def test_prior_counts_all_labels(spark):
    """More than half toxic: the prior says so; repeated rows of an id count once."""
    docs = spark.createDataFrame([(i, "scum words" if i % 5 else "fine words") for i in range(60)] + [(1, f"scum {k}") for k in range(50)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(60)] * 2, "doc_id long, toxic int")
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = T.train(docs, labels)
    assert model["prior"] == pytest.approx((sum(i % 5 > 0 for i in learnt) + 0.5) / (len(learnt) + 1)) and model["prior"] > 0.5


def test_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a = sorted((r.id, r.score) for r in T.score_toxicity(docs, labels).collect())
    assert a == sorted((r.id, r.score) for r in T.score_toxicity(docs, flipped).collect())


def test_edges(spark):
    schema, label_schema = "doc_id long, text string, score string, id int, toxic int", "doc_id long, quality int, toxic int, text string"
    none, no_labels = spark.createDataFrame([], schema), spark.createDataFrame([], label_schema)
    assert T.score_toxicity(none, no_labels).count() == 0
    rows = [(i, "you awful scum" if i % 3 == 0 else f"a good day number {i}", "s", 1, 1) for i in range(90)]
    rows += [(None, None, None, None, None), (500, "", "s", 1, 0), (500, "", "s", 1, 0), (501, "scum " * 60_000, "s", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    assert {r.score for r in T.score_toxicity(docs, no_labels).collect()} == {0.0}
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "t") for i in range(90)] + [(None, 1, 1, "t"), (7, 1, None, "t")], label_schema)
    out = T.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 500 in ids and 1 in ids and None in ids and 3 not in ids
