"""Benchmark the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and
prints ONE JSON line.  Each query is timed cold: a fresh plan, cache cleared,
full execution into Spark's ``noop`` sink (no driver collect).  ``pipeline``
times every headline output of one job sharing its featurised table.
$BENCH_REPLICATE=n (default 1) replicates the messages n times with shifted
ids (a larger-volume run from the same tables).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["thread_metadata", "thread_summary", "summary_markdown", "attention_queue", "dashboard_cards",
            "dashboard_kpis", "timeline_text", "report_lines", "message_sequence"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rep = int(os.environ.get("BENCH_REPLICATE", "1"))
    from pyspark.sql import functions as F

    from threadlens.plans import catalog
    from threadlens.session import local_session
    from threadlens.sources import messages as MS

    spark = local_session(cores=cpus, partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    if rep > 1:
        base = MS.messages_from_conversations

        def replicated(spark_, sf):
            m = base(spark_, sf)
            # each copy is a distinct set of conversations (ids shifted), same texts
            return (m.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(rep - 1))))
                    .withColumn("message_id", F.col("message_id") + F.col("_copy") * F.lit(10**12))
                    .withColumn("conversation_id", F.concat(F.col("conversation_id"), F.lit("-"),
                                                            F.col("_copy").cast("string")))
                    .drop("_copy"))
        catalog.messages_from_conversations = replicated

    n_messages = catalog.messages_from_conversations(spark, sf_dir).count()
    # warm-up: JVM, codegen caches (not timed)
    run(catalog.QUERIES["thread_metadata"](spark, sf_dir))
    catalog._JOBS.clear()
    spark.catalog.clearCache()

    times = {}
    for name in HEADLINE:
        catalog._JOBS.clear()
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        run(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    catalog._JOBS.clear()
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    for name in HEADLINE:
        run(catalog.QUERIES[name](spark, sf_dir))
    pipeline = round(time.perf_counter() - t0, 3)

    total = round(sum(times.values()), 3)
    n_threads = catalog.QUERIES["identify_threads"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": total, "unit": "sec", "queries": times,
        "pipeline_all_headline_sec": pipeline, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "replicate": rep, "messages": n_messages, "threads": n_threads,
        "messages_per_sec_pipeline": round(n_messages / pipeline, 1) if pipeline else None,
        "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
