"""The versioned store: the archive applied, run again, cut off before its end; runs with observed counts."""

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, ago, frame, msg
from threadlens import config as C
from threadlens.config import Params
from threadlens.plans.job import ThreadJob
from threadlens.plans.run import run, write_observed
from threadlens.sources import versions as V

P = Params(as_of=AS_OF)


def rows(spark):
    def meta(end):
        return '{"thread_name": "x"' + (f', "end_date": "{end}"' if end else "") + "}"
    old, new = "2024-01-01T08:00:00", "2024-04-01T08:00:00"
    data = [("old", "t1", meta(old), C.ACTIVE_ROOT), ("new", "t2", meta(new), C.ACTIVE_ROOT), ("bare", "t3", None, C.ACTIVE_ROOT),
            ("undated", "t4", meta(None), C.ACTIVE_ROOT), ("twice", "t5", meta(old), C.ACTIVE_ROOT), ("twice", "t6", meta(old), C.ARCHIVE_ROOT),
            ("shared", "t7", meta(old), C.ACTIVE_ROOT), ("shared", "t8", meta(new), C.ACTIVE_ROOT)] + \
           [(f"old{i}", f"o{i}", meta(old), C.ACTIVE_ROOT) for i in range(30)]
    return spark.createDataFrame([(f, k, m, "# doc", r) for f, k, m, r in data],
                                 "folder string, thread_key string, metadata_json string, summary_markdown string, root string")


def state(spark, path, version=None):
    return sorted(map(tuple, V.read_rows(spark, path, version=version).select("thread_key", "folder", "root", "metadata_json").collect(),), key=str)


def test_archive_is_applied_once(spark, tmp_path):
    path = V.create_store(rows(spark), str(tmp_path / "store"), buckets=4)
    before = state(spark, path)
    outcomes = {r.folder: r.outcome for r in V.apply_archive(spark, path, P, buckets=4).collect()}
    assert [outcomes[f] for f in ("old", "new", "bare", "undated", "twice", "shared", "old7")] == \
        ["moved", "kept", "no metadata", "no end date", "exists", "kept", "moved"]
    after = state(spark, path)
    roots = {(k, f): r for k, f, r, _ in after}
    assert roots[("t1", "old")] == C.ARCHIVE_ROOT and roots[("t2", "new")] == C.ACTIVE_ROOT and roots[("o3", "old3")] == C.ARCHIVE_ROOT
    assert len(after) == len(before) and {a[:2] for a in after} == {b[:2] for b in before}
    again = V.apply_archive(spark, path, P, buckets=4)
    assert again.where("outcome = 'moved'").count() == 0 and state(spark, path) == after
    assert V.manifest(spark, path)[0] == 1 and state(spark, path, version=0) == before


def test_a_change_cut_off_before_its_manifest_is_invisible_and_run_again(spark, tmp_path, monkeypatch):
    path = V.create_store(rows(spark), str(tmp_path / "store"), buckets=4)
    before = state(spark, path)

    def lost(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lost)
        with pytest.raises(RuntimeError):
            V.apply_archive(spark, path, P, buckets=4)
    assert state(spark, path) == before
    V.apply_archive(spark, path, P, buckets=4)
    whole = V.create_store(rows(spark), str(tmp_path / "other"), buckets=4)
    V.apply_archive(spark, whole, P, buckets=4)
    assert state(spark, path) == state(spark, whole) != before


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = V.create_store(rows(spark).where("folder IN ('old', 'new', 'bare', 'undated')"), str(tmp_path / "s"), buckets=64)
    V.apply_archive(spark, path, P, buckets=64)
    entries = {(r.root, r.bucket): r.version for r in V.manifest(spark, path)[1].collect()}
    assert sorted(entries.values()) == [0, 0, 0, 1]


def test_store_without_a_manifest(spark, tmp_path):
    (tmp_path / "none" / "manifest").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        V.manifest(spark, str(tmp_path / "none"))


def test_run_counts_what_it_writes(spark, tmp_path):
    data = [msg(i, f"c{i % 5}", ago(days=i % 3), body="Can you confirm?" if i % 2 else "ok") for i in range(20)]
    data += [msg(100, "c1", None), msg(101, "old", ago(days=90)), msg(102, "old", ago(days=91)), msg(103, "single", ago(days=1))]
    s = run(ThreadJob(frame(spark, data), P), str(tmp_path / "run"))
    assert (s.threads_found, s.threads_processed, s.summaries_created, s.timelines_created, s.errors) == (6, 6, 6, 6, 1)
    assert s.emails_moved == 22 and s.reviewed == spark.read.parquet(str(tmp_path / "run/attention")).count() == s.drafts
    assert V.read_rows(spark, str(tmp_path / "run/store")).groupBy("root").count().where(F.col("root") == C.ARCHIVE_ROOT).first()[1] == 1


def test_observed_counts_of_an_empty_table(spark, tmp_path):
    assert write_observed(spark.range(0).toDF("id"), str(tmp_path / "e"), rows=F.count(F.lit(1)), big=F.count_if(F.col("id") > 3)) == {"rows": 0, "big": 0}
