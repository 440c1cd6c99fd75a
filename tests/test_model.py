"""M1: the model is made once per task, batches are of like length, bounds hold, bad batches go text by text."""

import glob
import os

import pytest

from threadlens.operators import model as M


def frame(spark, texts, parts=2):
    return spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "thread_key string, model_input string").repartition(parts)


def test_one_load_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda texts, max_tokens, min_tokens: [f"{len(t)} {max_tokens} {min_tokens}" for t in texts]
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # many batches per task
    try:
        out = M.model_summary(frame(spark, ["x" * i for i in range(100)], 3), factory).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    assert len(glob.glob(f"{folder}/*")) == 3
    assert {r.thread_key: r.model_summary for r in out} == {f"t{i}": f"{i} 150 30" for i in range(100)}


def test_bad_batches_go_text_by_text(spark):
    def factory():
        def model(texts, max_tokens, min_tokens):
            if any("bad" in t for t in texts):
                raise RuntimeError("model")
            return [t.upper() for t in texts]
        return model
    got = {r.thread_key: r.model_summary for r in M.model_summary(frame(spark, ["a", "bad", "c", None], 1), factory).collect()}
    assert got == {"t0": "A", "t1": None, "t2": "C", "t3": ""}


def test_a_model_that_drops_texts_counts_as_failed():
    assert M.summarise(lambda texts, max_tokens, min_tokens: list(texts)[:1], ["a", "b"], M.Bounds()) == ["a", "b"]
    assert M.summarise(lambda texts, max_tokens, min_tokens: [], ["a"], M.Bounds()) == [None]


def test_a_factory_that_fails_fails_the_task(spark):
    def factory():
        raise OSError("no model")
    with pytest.raises(Exception, match="no model"):
        M.model_summary(frame(spark, ["a"]), factory).collect()


def test_batches_are_of_like_length_and_bounded():
    lengths = [5, 900, 6, 1000, 7, 0, 950] + [3] * 40
    batches = M.length_batches(lengths, M.Bounds(batch_texts=8, batch_chars=2000))
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    assert all(len(b) <= 8 and (len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 2000) for b in batches)
    assert {lengths[i] for i in batches[0]} == {1000, 950}


def test_summaries_are_cut_at_the_bound():
    out = M.summarise(lambda texts, max_tokens, min_tokens: ["w " * 200 for _ in texts], ["a"], M.Bounds(max_tokens=150))
    assert len(out[0].split()) == 150
