"""Plan-shape checks: no keyed exchange carries a message body, Python only in the model hook,
top-k limits run before the shuffle, scans are pruned and filtered at the source."""

import pytest

from conftest import ROOT  # noqa: F401
from threadlens.plans import catalog

SF = "/root/testdata/sf0.001"
BODY_COLS = {"body", "_body", "_lb"}  # key points and issues carry single sentences named text, of bounded length
PY_NODES = ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups", "WindowInPandas", "ArrowWindowPython",
            "AggregateInPandas", "ArrowAggregatePython", "PythonUDTF")


def _walk(node, seen):
    name = node.nodeName()
    yield node
    if name == "InMemoryTableScan":
        yield from _walk(node.relation().cachedPlan(), seen)
    kids = node.children()
    for i in range(kids.size()):
        yield from _walk(kids.apply(i), seen)


def _plan(df):
    """The physical plan with its exchanges, before any runtime change."""
    p = df._jdf.queryExecution().executedPlan()
    return p.initialPlan() if p.nodeName() == "AdaptiveSparkPlan" else p


def _outputs(node):
    out = node.output()
    return {out.apply(i).name() for i in range(out.size())}


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """The tables as several files, read with broadcasts off: plans as on a large input."""
    base = tmp_path_factory.mktemp("spread")
    for t in ("conversations", "documents", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(9).write.parquet(f"{base}/{t}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    catalog._JOBS.clear()
    yield str(base)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    catalog._JOBS.clear()


# queries whose plan needs no keyed exchange: row-wise outputs, and what starts from stored tables
KEYLESS = {"message_scan", "exclude_folders", "mail_only", "rejects", "keyword_hits", "clean_body", "document_clean_body",
           "folder_tree_scan", "run_stats", "faulty_run_stats"}
# keyword tables: texts with candidates meet them by message, so there (and there alone) texts cross an exchange
TEXT_EXCHANGE = {"keyword_table_hits"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_body_in_keyed_exchange(spark, spread, name):
    seen = 0
    for node in _walk(_plan(catalog.QUERIES[name](spark, spread)), set()):
        if node.nodeName() == "Exchange":
            part = node.outputPartitioning().toString()
            if part.startswith("hashpartitioning") or part.startswith("rangepartitioning"):
                seen += 1
                assert not (_outputs(node) & BODY_COLS), (name, part, _outputs(node))
                if "message_id" in part and "text" in _outputs(node):
                    assert name in TEXT_EXCHANGE, (name, part)
    if name in ("existing_threads", "mode_both", "thread_summary", "summary_markdown", "dashboard_cards", "timeline_text",
                "message_sequence", "message_routing", "followup_marks", "find_thread", "identify_threads", "reply_queue"):
        assert seen > 0, name
    if name in KEYLESS:
        assert seen == 0, name


@pytest.mark.parametrize("name", ["identify_threads", "scan_preview", "thread_name", "thread_slug", "days_since",
                                  "thread_endpoints", "sender_counts", "stakeholders", "archive_split",
                                  "message_routing", "find_thread", "followup_marks"])
def test_body_free_queries_never_read_a_body(spark, tmp_path, name):
    """Over a stored messages table: the scans' read schemas lack the body, and building the plan
    writes nothing (apart from follow-up marks, whose selection needs the scores)."""
    from threadlens.sources.messages import messages_from_conversations, read_messages
    path = str(tmp_path / "messages")
    messages_from_conversations(spark, SF).write.parquet(path)
    before = dict(catalog._JOBS)
    key = (spark.sparkContext.applicationId, "stored-messages", "conversations", (None, None, None))
    catalog._JOBS[key] = catalog.ThreadJob(read_messages(spark, path), catalog.P)
    try:
        plan = _plan(catalog.QUERIES[name](spark, "stored-messages")).toString()
        reads = [x for x in plan.split("ReadSchema: ")[1:]]
        assert reads and not any("body" in r.split(">")[0] for r in reads), name
        assert name == "followup_marks" or "features" not in catalog._JOBS[key].__dict__
    finally:
        catalog._JOBS.clear()
        catalog._JOBS.update(before)


def test_python_only_in_model_hook(spark):
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF)).toString()
        has_py = any(n in plan for n in PY_NODES)
        assert has_py == (name in ("model_summary", "summary_method")), name


def test_top_k_limits_before_shuffle(spark):
    plan = _plan(catalog.QUERIES["thread_summary"](spark, SF)).toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_summary_lists_share_their_exchanges(spark, spread):
    """After the features: one exchange for the distinct texts, one below the group-limited window, one per
    thread; beside them only the metadata's.  The feature table is read twice, not once per list."""
    plan = _plan(catalog.QUERIES["thread_summary"](spark, spread)).toString()
    lists = plan.split("ObjectHashAggregate(keys=[thread_key", 1)[1]
    dealt = [x.split(")")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]
    assert len(dealt) == 4 and plan.count("WindowGroupLimit") == 2 and plan.count(" Window [") == 1, dealt
    assert lists.count("FileScan parquet") == 2
    below = plan.split("WindowGroupLimit", 2)[1]
    assert "Exchange hashpartitioning(thread_key" in below  # the limit also runs below the exchange


def test_excluded_folders_are_partition_filters(spark, tmp_path):
    from threadlens.sources import messages as MS
    MS.write_message_tree(MS.messages_from_conversations(spark, SF), str(tmp_path / "tree"))
    df = MS.read_message_tree(spark, str(tmp_path / "tree"), ("Customs", "2024"))
    line = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "folder" in line.split("PartitionFilters: [")[1].split("]")[0] and df.schema["folder"].dataType.simpleString() == "string"
    assert not any("folder=Customs" in f for f in {r[0] for r in df.select("_metadata.file_path").distinct().collect()})


def test_pushdown_and_pruning(spark, tmp_path):
    from threadlens.sources.messages import messages_from_conversations, read_messages
    path = str(tmp_path / "messages")
    messages_from_conversations(spark, SF).write.parquet(path)
    df = read_messages(spark, path, folder="Inbox").select("message_id", "sender")
    plan = _plan(df).toString()
    assert "PushedFilters: [IsNotNull(folder), EqualTo(folder,Inbox)]" in plan
    assert "ReadSchema: struct<message_id:bigint,folder:string,sender:string>" in plan


def test_sequence_is_one_exchange_below_the_window(spark, spread):
    """Nothing is written and no range sort runs: the source, one exchange by thread, the window
    (tests/test_skew.py covers hot threads, which are split by range)."""
    plan = _plan(catalog.QUERIES["message_sequence"](spark, spread)).toString()
    below = plan.split("Window [row_number", 1)[1].split("Window", 1)[0].split("SortMergeJoin", 1)[0]
    first = below.split("Exchange", 1)[1]
    assert first.startswith(" hashpartitioning(thread_key") and "rangepartitioning" not in plan
    assert "conversations.parquet" in below and "sequence-" not in plan


def test_no_cross_or_nested_loop_joins(spark):
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF)).toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
