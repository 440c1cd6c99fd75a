"""The pipeline against the brute-force versions of its stages."""

import corpus_pipeline as P
from test_packing import check_packing
from test_secret_scan import base_spans
from test_simhash import brute_components, slow_print

from threadlens.llm import packing, secret_scan


def windows(words, n=10):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def words_of(text):
    import re
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secret_scans", "packing"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = P.stored(stage(spark, docs, sf), f"test-{name}")
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        left = {r.doc_id for r in rows}
        if name == "simhash_dedup":
            comp = brute_components({i: slow_print(r.text) for i, r in before.items()})
            assert left == set(comp.values()) and len(left) < len(before)
        elif name == "decontamination":
            bad = set()
            for i, r in before.items():
                w = words_of(r.text)
                if any(windows(w, min(10, len(it))) & windows(it, min(10, len(it))) for it in items if it):
                    bad.add(i)
            assert bad and left == set(before) - bad
        elif name == "secret_scans":
            assert left == set(before)
            for r in rows:
                assert not base_spans(r.text) and (r.text == before[r.doc_id].text) == (not secret_scan.spans(before[r.doc_id].text))
        elif name == "packing":
            pieces = [type("P", (), dict(zip(["id"] + docs.columns[1:], r))) for r in rows]
            check_packing(pieces, {i: r.text for i, r in before.items()}, Tokenizer.from_file(packing.tokenizer_path()), 2048)


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, "k"), (1, "", "en", "s", 0, "k"), (1, "", "en", "s", 0, "k"),
            (2, "one two three four five", "en", "s", 23, "k"), (2, "one two three four five", "en", "s", 23, "k"),
            (3, "x " * 30_000, None, "s", 60_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row0 string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in out.collect()}) == [1, 2, 3]
    empty = f"{tmp_path}/empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).count() == 0
