"""Model-written summaries (M1, M2): the only Python in the pipeline.

The caller gives a factory.  Each task calls it once, on its first text, and feeds the model it returns
batches of texts of like length (a model pads a batch to its longest text), with the bounds on the
summary's tokens.  Only <=1,003 chars per thread travel to Python.  No model ships with the library;
``lead_model`` is a deterministic stand-in.  A thread on which the model fails falls back to the rule
text (method column says which text was used).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

MAX_SUMMARY_CHARS = 150

# A model maps texts to summaries, given the bounds: model(texts, max_tokens=..., min_tokens=...)
Model = Callable[..., Sequence[str | None]]

# The batch functions below run in Python workers.  Ship this module's code with the task
# (pickled by value) so workers need no installed copy of the package.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must then be on the workers' path
    pass


@dataclass(frozen=True)
class Bounds:
    """Bounds of a summary (tokens as the model counts them; a summary of more blank-separated words than
    ``max_tokens`` is cut, as a word is a token at least) and of a batch."""

    max_tokens: int = 150
    min_tokens: int = 30
    batch_texts: int = 32
    batch_chars: int = 16_000  # of the longest text times the texts


def lead_model() -> Model:
    """Deterministic stand-in: the leading text cut at 150 chars on a word boundary."""
    def one(text: str) -> str:
        text = " ".join(text.split())
        if len(text) <= MAX_SUMMARY_CHARS:
            return text
        cut = text[:MAX_SUMMARY_CHARS]
        return cut.rsplit(" ", 1)[0] if " " in cut else cut
    return lambda texts, max_tokens, min_tokens: [one(t) for t in texts]


def length_batches(lengths: Sequence[int], bounds: Bounds) -> list[list[int]]:
    """Indexes of the texts by length, cut into batches within the bounds."""
    batches: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):  # the first of a batch is its longest
        last = batches[-1] if batches else None
        if last is None or len(last) >= bounds.batch_texts or lengths[last[0]] * (len(last) + 1) > bounds.batch_chars:
            batches.append([i])
        else:
            last.append(i)
    return batches


def summarise(model: Model, texts: Sequence[str], bounds: Bounds) -> list[str | None]:
    """The summaries of some texts; None where the model fails on a text by itself."""
    def call(some):
        out = list(model(some, max_tokens=bounds.max_tokens, min_tokens=bounds.min_tokens))
        if len(out) != len(some):
            raise ValueError(f"{len(out)} summaries of {len(some)} texts")
        return [s if s is None or len(s.split()) <= bounds.max_tokens else " ".join(s.split()[:bounds.max_tokens]) for s in out]

    def one(text):
        try:
            return call([text])[0]
        except Exception:  # noqa: BLE001 - this thread's model run failed; the rule text stands in
            return None

    found: list[str | None] = [None] * len(texts)
    for batch in length_batches([len(t) for t in texts], bounds):
        some = [texts[i] for i in batch]
        try:
            out = call(some)
        except Exception:  # noqa: BLE001 - one bad thread must not lose the batch: each by itself
            out = [one(t) for t in some]
        for i, s in zip(batch, out):
            found[i] = s
    return found


def model_summary(model_input: DataFrame, factory: Callable[[], Model] = lead_model, bounds: Bounds = Bounds()) -> DataFrame:
    """M1: thread_key, model_summary (NULL where the model failed on that thread).  A factory that fails in a
    task fails the task, so a missing model is seen and not written off thread by thread."""
    def run(batches):
        model = None
        for batch in batches:
            if not batch.num_rows:
                continue
            model = model or factory()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(summarise(model, texts, bounds), pa.string())],
                                             ["thread_key", "model_summary"])
    return model_input.select("thread_key", "model_input").mapInArrow(run, "thread_key string, model_summary string")


def summary_method(summary: DataFrame, model: DataFrame | None, label: str = C.METHOD_MODEL,
                   failed: DataFrame | None = None) -> DataFrame:
    """M2: the fallback text for threads in ``failed`` (thread_key), else the model's text where there is
    one, else the rule text; ``method`` records which."""
    s = summary.drop("method")
    s = s.withColumn("model_summary", F.lit(None).cast("string")) if model is None else s.join(model, "thread_key", "left")
    s = s.withColumn("_failed", F.lit(False)) if failed is None else s.join(
        failed.select("thread_key").distinct().withColumn("_failed", F.lit(True)), "thread_key", "left")
    bad, modelled = F.coalesce("_failed", F.lit(False)), F.col("model_summary").isNotNull()
    return s.withColumn("method", F.when(bad, F.lit(C.METHOD_FALLBACK)).when(modelled, F.lit(label))
                        .otherwise(F.lit(C.METHOD_RULES))) \
        .withColumn("executive_summary", F.when(bad, F.concat(
            F.lit("Thread with "), F.col("email_count").cast("string"), F.lit(" emails")))
            .when(modelled, F.col("model_summary")).otherwise(F.col("executive_summary"))) \
        .drop("model_summary", "_failed")
