"""Thread store readers (original folder layout and table layout), the archive transition
outcomes, and the streaming ingest path."""

import json
import os

from pyspark.sql import functions as F

from conftest import AS_OF, ago, frame, msg
from threadlens import config as C
from threadlens.config import Params
from threadlens.operators import lifecycle as LC
from threadlens.plans.job import ThreadJob
from threadlens.sources import stored as ST
from threadlens.streaming import ingest as IN

P = Params(as_of=AS_OF)


def _meta(name, end):
    d = {"conversation_id": "abc", "thread_name": name, "email_count": 3, "participants": ["a", "b"],
         "participant_count": 2, "start_date": "2024-01-01T08:00:00", "end_date": end, "duration_days": 1,
         "total_attachments": 0, "is_urgent": True, "has_delay": False, "is_transport": False, "is_customs": False}
    if end is None:
        del d["end_date"]
    return d


def test_reference_folder_layout(spark, tmp_path):
    root = tmp_path / "threads"
    for folder, meta, doc in [("t1_abc", _meta("2024-01-01 - One", "2024-01-02T08:00:00"), "# One\n"),
                              ("t2_def", _meta("2024-01-01 - Two", "2024-04-09T08:00:00"), None),
                              ("t3_ghi", None, "# orphan\n"),
                              ("t4_jkl", _meta("2024-01-01 - Four", None), "# Four\n")]:
        os.makedirs(root / folder)
        if meta is not None:
            (root / folder / ST.METADATA_FILE).write_text(json.dumps(meta, indent=2, ensure_ascii=False))
        if doc is not None:
            (root / folder / ST.SUMMARY_FILE).write_text(doc)
    got = {r.folder: r for r in ST.read_reference_folders(spark, str(root)).collect()}
    assert set(got) == {"t1_abc", "t2_def", "t4_jkl"}          # no metadata -> skipped
    assert got["t1_abc"].summary_text == "# One\n" and got["t2_def"].summary_text == ""
    assert got["t1_abc"].participants == ["a", "b"] and got["t4_jkl"].end_date is None

    stored = ST.read_reference_folders(spark, str(root)).select("folder", "end_date")
    folders = spark.createDataFrame([(f,) for f in ("t1_abc", "t2_def", "t3_ghi", "t4_jkl", "t5_old")], "folder string")
    archive = spark.createDataFrame([("t5_old",), ("t1_abc",)], "folder string")
    out = {r.folder: r.outcome for r in LC.archive_transition(folders, stored, archive, P).collect()}
    assert out == {"t1_abc": "exists", "t2_def": "kept", "t3_ghi": "no metadata", "t4_jkl": "no end date",
                   "t5_old": "no metadata"}


def test_table_store_round_trip(spark, tmp_path):
    rows = [msg(1, "c1", ago(days=1), body="Can you check?"), msg(2, "c1", ago(hours=2)),
            msg(3, "c2", ago(days=90)), msg(4, "c2", ago(days=80))]
    job = ThreadJob(frame(spark, rows), P)
    md = job.with_participants(job.markdown).withColumn("folder", F.col("thread_key"))
    path = ST.write_store(md, str(tmp_path / "store"))
    active = {r.thread_key for r in ST.read_store(spark, path).collect()}
    everything = {r.thread_key: r for r in ST.read_store(spark, path, root=None).collect()}
    assert active == {"c1"} and set(everything) == {"c1", "c2"}
    assert everything["c1"].summary_text.startswith("# ")
    assert everything["c2"].root == C.ARCHIVE_ROOT


def test_streaming_ingest_matches_batch(spark, tmp_path):
    rows = [msg(i, f"c{i % 4}", ago(days=i % 9, minutes=i), sender=f"s{i % 3}",
                body="urgent, please confirm?" if i % 5 == 0 else "late delivery") for i in range(40)]
    src = str(tmp_path / "in")
    frame(spark, rows[:20]).write.parquet(src)
    frame(spark, rows[20:]).write.mode("append").parquet(src)
    feats_path, ckpt = str(tmp_path / "features"), str(tmp_path / "ckpt")
    q = IN.append_features(IN.feature_stream(IN.message_stream(spark, src, max_files_per_trigger=1), P),
                           feats_path, ckpt)
    q.awaitTermination(120)
    streamed = ThreadJob.from_features(spark.read.parquet(feats_path), P).scored
    batch = ThreadJob(frame(spark, rows), P).scored
    cols = ["thread_key", "email_count", "priority_score", "next_action", "is_urgent", "has_delay"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_write_report_and_timeline_lines(spark, tmp_path):
    from threadlens.operators import outputs as OUT
    rows = [msg(1, "c1", ago(days=1), body="Dear all,\nPlease confirm?\nBest regards"),
            msg(2, "c1", ago(hours=2), body="urgent"), msg(3, "c2", ago(days=3)), msg(4, "c2", ago(days=2))]
    job = ThreadJob(frame(spark, rows), P)
    rep = ST.write_lines(OUT.report_lines(job.report_set, P), str(tmp_path / "report"),
                         ["section", "item_no", "item_key", "line_no"])
    text = [r.value for r in spark.read.text(rep).collect()]
    assert text[0] == C.REPORT_TITLE and "ALL THREADS:" in text
    assert any(t.startswith("1. ") for t in text) and any(t.startswith("2. ") for t in text)
    tl = job.timeline.withColumn("folder", F.col("thread_key"))
    out = ST.write_lines(tl, str(tmp_path / "timeline"), ["thread_key", "line_no"], ["folder"])
    c1 = [r.value for r in spark.read.text(f"{out}/folder=c1").collect()]
    assert c1[0].startswith("TIMELINE: ") and c1[4] == "Please confirm?" and c1[-1] == "Attachments: 0"


def test_rejects_and_fallback_from_json_source(spark, tmp_path):
    from threadlens.operators import lifecycle as LC
    from threadlens.sources.messages import read_messages
    src = tmp_path / "messages.json"
    src.write_text("\n".join([
        json.dumps({"message_id": 1, "conversation_id": "c1", "sender": "a", "subject": "RE: Plan",
                    "body": "Can you confirm?", "received_time": "2024-04-09T08:00:00"}),
        json.dumps({"message_id": 2, "conversation_id": "c1", "sender": "b", "subject": "Plan",
                    "body": "ok", "received_time": "2024-04-09T09:00:00"}),
        json.dumps({"message_id": 3, "conversation_id": "c1", "sender": "c", "subject": "Plan",
                    "body": "late", "received_time": None}),
        "{not json at all",
    ]))
    job = ThreadJob(read_messages(spark, str(src), fmt="json"), P)
    rej = {(r.message_id, r.reject_reason) for r in job.rejects.collect()}
    assert rej == {(3, "no received_time"), (None, "malformed")}
    assert job.meta.count() == 1 and job.meta.first().email_count == 2      # the scan goes on
    bad = job.rejects.select(F.col("conversation_id").alias("thread_key")).dropna().distinct()
    fb = LC.fallback_summary(job.with_participants(job.summary).join(bad, "thread_key", "left_semi")).collect()
    assert len(fb) == 1 and fb[0].current_status == C.FALLBACK_STATUS
    assert fb[0].executive_summary == "Thread with 2 emails" and fb[0].method == C.METHOD_FALLBACK


def test_folder_layout_writer(spark, tmp_path):
    rows = [msg(1, "c1", ago(days=1), body="Can you check?"), msg(2, "c1", ago(hours=2))]
    job = ThreadJob(frame(spark, rows), P)
    md = job.with_participants(job.markdown).withColumn("folder", F.lit("2024-04-09 - Plan_c1"))
    path = ST.write_folders(md, str(tmp_path / "out"))
    meta = spark.read.json(f"{path}/metadata/root=threads")
    doc = spark.read.text(f"{path}/summary/root=threads", wholetext=True).first().value
    assert meta.first().email_count == 2 and meta.first().folder == "2024-04-09 - Plan_c1"
    assert doc.startswith("# 2024-04-09 - Plan")


def test_folder_layout_writer_keeps_equal_names_apart(spark, tmp_path):
    rows = [msg(1, "c1", ago(days=1)), msg(2, "c1", ago(hours=2)), msg(3, "c2", ago(days=1)), msg(4, "c2", ago(hours=2))]
    job = ThreadJob(frame(spark, rows), P)
    md = job.with_participants(job.markdown).withColumn("folder", F.lit("2024-04-09 - Plan"))
    path = ST.write_folders(md, str(tmp_path / "out"))
    assert spark.read.json(f"{path}/metadata").count() == 2
    assert spark.read.text(f"{path}/summary", wholetext=True).count() == 2


def test_reference_folder_names_and_absent_summaries(spark, tmp_path):
    names = ["2024-01-01 - Plan 3_00000012", "2024-01-01 - Grüße + 100% é_1", "plain"]
    for n in names:
        os.makedirs(tmp_path / "a" / n)
        (tmp_path / "a" / n / ST.METADATA_FILE).write_text(json.dumps(_meta(n, "2024-01-02T08:00:00"), ensure_ascii=False))
    got = {r.folder: r for r in ST.read_reference_folders(spark, str(tmp_path / "a")).collect()}
    assert set(got) == set(names) and all(r.thread_name == f and r.summary_text == "" for f, r in got.items())
    (tmp_path / "a" / names[1] / ST.SUMMARY_FILE).write_text("# doc")
    got = {r.folder: r.summary_text for r in ST.read_reference_folders(spark, str(tmp_path / "a")).collect()}
    assert got == {names[0]: "", names[1]: "# doc", names[2]: ""}


def test_stream_keeps_rejects(spark):
    rows = [msg(1, "c1", ago(days=1)), msg(2, "c1", None), msg(None, "c1", ago(hours=1))]
    df = frame(spark, rows)
    assert IN.feature_stream(df, P).count() == 1
    assert sorted(r.reject_reason for r in IN.reject_stream(df).collect()) == ["no message_id", "no received_time"]
