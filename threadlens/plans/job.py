"""ThreadJob: one lazily-built plan over a messages table.

Stages are memoised DataFrames, so every output of one job derives from the
same featurised table.  That table (bounded features, no bodies) and the one-row-
per-thread metadata are the only things materialised, both in the shared
``spark.checkpoint.dir`` (a scratch folder is registered only when the session
names none, as in local tests): the features as a written parquet table
(computed once, read back column-pruned), the metadata as a checkpoint.  Lineage is cut
at both; a join against the metadata still exchanges it by thread_key.  Body-free outputs
come from ``envelope`` and ``facts``, which are lazy and read no body.  Everything
downstream is plain DataFrame operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Params
from ..functions import text as X
from ..operators import extract as E
from ..operators import features as FE
from ..operators import lifecycle as L
from ..operators import outputs as O
from ..operators import phrases as PH
from ..operators import render as R
from ..operators import scoring as S
from ..operators import sequence as Q
from ..operators import threads as T
from ..session import scratch_path, shared_dir
from ..sources.messages import split_rejects


class ThreadJob:
    def __init__(self, messages: DataFrame, params: Params = C.TEST_PARAMS, key: str = "conversation_id",
                 min_messages: int | None = None, materialize: str = "checkpoint"):
        self.spark = messages.sparkSession
        self.params = params
        self.key = key
        self.min_messages = params.min_messages if min_messages is None else min_messages
        self.materialize = materialize
        self.raw = messages

    @classmethod
    def from_features(cls, features: DataFrame, params: Params = C.TEST_PARAMS,
                      min_messages: int | None = None) -> "ThreadJob":
        """A job over an already featurised table (e.g. the streaming ingest's output).
        Thread-level outputs work; per-message timeline outputs need the messages."""
        j = cls(features, params, min_messages=min_messages, materialize="none")
        j.__dict__["features"] = features
        return j

    # -- scan ---------------------------------------------------------------
    @cached_property
    def _split(self):
        return split_rejects(self.raw)

    @property
    def valid(self) -> DataFrame:
        return self._split[0]

    @property
    def rejects(self) -> DataFrame:
        return self._split[1]

    @cached_property
    def kept(self) -> DataFrame:
        """F1 applied; thread key attached."""
        return FE.with_thread_key(FE.exclude_folders(self.valid, self.params.excluded_folders), self.key)

    @cached_property
    def envelope(self) -> DataFrame:
        """The body-free columns; lazy, read from the source with the body pruned."""
        return FE.envelope(self.kept)

    @cached_property
    def facts(self) -> DataFrame:
        """Names, endpoints and ages of the kept threads, from the envelope; lazy."""
        return T.thread_facts(self.envelope, self.params, self.min_messages).withColumns({
            "start_date": X.iso_text("start_time"), "end_date": X.iso_text("end_time")})

    @cached_property
    def features(self) -> DataFrame:
        f = FE.featurize(self.kept, self.params)
        if self.materialize == "checkpoint":
            # written once as a parquet table in the shared folder and read back: computed a
            # single time, lineage cut, and every branch reads only the columns it needs
            self.features_path = scratch_path(self.spark, "features")
            f.write.parquet(self.features_path)
            return self.spark.read.parquet(self.features_path)
        return self._materialize(f)

    # -- thread level -------------------------------------------------------
    @cached_property
    def meta(self) -> DataFrame:
        """Thread metadata + endpoints for threads with enough messages (one row per thread,
        materialised like the features: every branch reads it instead of re-aggregating)."""
        m = T.thread_metadata(self.features, self.params, self.min_messages)
        return self._materialize(PH.with_phrase_flags(m, self.features, self.params))

    def _materialize(self, df: DataFrame) -> DataFrame:
        """``checkpoint`` (default): written to the shared ``spark.checkpoint.dir`` and the lineage
        cut, so a lost executor costs no recomputation and later plans start from a plain scan
        (cheaper to plan than a cached plan).  ``persist`` keeps blocks in executors (recomputed
        from lineage when lost); ``none`` leaves the plan as is."""
        mode = self.materialize
        if mode == "checkpoint":
            shared_dir(self.spark)
            return df.checkpoint(eager=True)
        if mode == "persist":
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    def with_participants(self, threads: DataFrame) -> DataFrame:
        """A per-thread table with the sorted sender list added (for outputs that show it)."""
        # once the feature table exists it holds the senders: no second scan of the messages
        source = self.features if self.materialize == "none" or "features" in self.__dict__ else self.envelope
        return threads.join(T.participants(source), "thread_key", "left")

    def _from_table(self) -> bool:
        """Whether the features are there to be read; one list alone needs few of them and has none written."""
        return self.materialize == "none" or "features" in self.__dict__

    @property
    def list_features(self) -> DataFrame:
        """What a single list starts from: the feature table once it exists, else the same columns, lazily, of
        which the list's plan computes only those it takes."""
        return self.features if self._from_table() else FE.featurize(self.kept, self.params)

    def _kept_only(self, df: DataFrame) -> DataFrame:
        """Restrict a per-thread table to threads that passed the minimum count."""
        if self.min_messages <= 1:
            return df
        threads = self.meta if self._from_table() else T.identify_threads(self.envelope, self.min_messages)
        return df.join(threads.select("thread_key"), "thread_key", "left_semi")

    @cached_property
    def kept_features(self) -> DataFrame:
        """Features of messages whose thread passed the minimum count (left-semi join)."""
        return self._kept_only(self.features)

    @cached_property
    def scored(self) -> DataFrame:
        return S.with_scores(self.meta, self.params).withColumns({
            "start_date": X.iso_text("start_time"), "end_date": X.iso_text("end_time")})

    # -- lists --------------------------------------------------------------
    # raw_* lists cover every conversation; the summary's left join from ``meta`` keeps the
    # kept threads, so only the standalone outputs need the explicit semi-join.
    @cached_property
    def raw_sender_counts(self) -> DataFrame:
        return T.sender_counts(self.features)

    @cached_property
    def sender_counts(self) -> DataFrame:
        """A3 of the kept threads, from the envelope (no body, nothing written)."""
        return T.sender_counts(self.envelope).join(self.facts.select("thread_key"), "thread_key", "left_semi")

    @cached_property
    def events(self) -> DataFrame:
        return E.thread_events(self.features, self.meta)

    @cached_property
    def raw_stakeholders(self) -> DataFrame:
        return E.stakeholders(self.raw_sender_counts)

    @cached_property
    def stakeholders(self) -> DataFrame:
        return E.stakeholders(self.sender_counts)

    @cached_property
    def last5(self) -> DataFrame:
        """The last 5 messages of each thread (flow uses 5, action items the last 3 of them)."""
        return E.last_messages(self.features, C.FLOW_MESSAGES, E.LAST_COLUMNS)

    @cached_property
    def raw_action_items(self) -> DataFrame:
        return E.action_items(self.features, last=self.last5)

    @cached_property
    def action_items(self) -> DataFrame:
        return self._kept_only(self.raw_action_items)

    @cached_property
    def raw_key_points(self) -> DataFrame:
        return E.key_points(self.list_features)

    @cached_property
    def key_points(self) -> DataFrame:
        return self._kept_only(self.raw_key_points)

    @cached_property
    def raw_issues(self) -> DataFrame:
        return E.thread_issues(self.list_features)

    @cached_property
    def issues(self) -> DataFrame:
        return self._kept_only(self.raw_issues)

    @cached_property
    def raw_flow(self) -> DataFrame:
        return E.conversation_flow(self.features, last=self.last5)

    @cached_property
    def flow(self) -> DataFrame:
        return self._kept_only(self.raw_flow)

    @cached_property
    def model_input(self) -> DataFrame:
        return self._kept_only(E.model_input(self.features))

    # -- summary ------------------------------------------------------------
    @cached_property
    def lists(self) -> DataFrame:
        """The scored threads with all their capped lists as arrays, one row per thread.  Every kept thread
        has a sender and a last message, so it has a row of arrays."""
        raw = E.list_arrays(self.features)
        return self.scored.join(raw, "thread_key").withColumns(E.list_columns()).drop(*[f"_{t}" for t in E.LIST_CAPS])

    @cached_property
    def summary(self) -> DataFrame:
        """The rule-based summary row of every thread (J1: metadata beside its lists)."""
        s = self.lists.withColumn("method", F.lit(C.METHOD_RULES))
        s = s.withColumn("executive_summary", R.executive_summary())
        s = s.withColumn("reply_template", R.reply_template())
        return s

    @cached_property
    def markdown(self) -> DataFrame:
        return self.summary.withColumn("summary_markdown", R.summary_markdown())

    # -- per-message ordered outputs ----------------------------------------
    @cached_property
    def sequenced(self) -> DataFrame:
        """W1 + next message time, over kept threads; skew-safe.  The filter is per whole thread, so it
        comes after the numbering and leaves the exchange below the window as it is."""
        seq = Q.message_sequence(FE.timeline_features(self.kept), with_next_time=True)
        return seq.join(self.facts.select("thread_key"), "thread_key", "left_semi")

    # -- review / outputs -----------------------------------------------------
    @cached_property
    def active(self) -> DataFrame:
        """Threads of the active root (not archived)."""
        return self.scored.filter(~F.col("is_archived"))

    @cached_property
    def report_set(self) -> DataFrame:
        return self.active if self.params.report_active_only else self.scored

    @cached_property
    def dashboard_rows(self) -> DataFrame:
        return O.dashboard_rows(self.summary)

    @cached_property
    def attention(self) -> DataFrame:
        return O.attention_queue(self.active, self.params)

    @cached_property
    def routes(self) -> DataFrame:
        return L.routing(self.envelope, self.facts)

    @cached_property
    def palette(self) -> DataFrame:
        return O.sender_palette(self.envelope.join(self.facts.select("thread_key"), "thread_key", "left_semi"))

    @cached_property
    def timeline(self) -> DataFrame:
        return R.timeline_lines(self.scored, self.sequenced)

    def close(self) -> None:
        """Forget what the job has memoised; ``features_path`` tells where its feature table lies in the
        shared folder (to be removed with the folder, or kept for ``from_features``)."""
        for name in [n for n in self.__dict__ if isinstance(self.__dict__[n], DataFrame) and n != "raw"]:
            del self.__dict__[name]

    def model_summaries(self, factory=None, bounds=None) -> DataFrame:
        from ..operators import model as M
        return M.model_summary(self.model_input, factory or M.lead_model, bounds or M.Bounds())
