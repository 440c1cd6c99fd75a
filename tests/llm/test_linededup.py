"""Line dedup against a plain version; nulls, ties, repeated rows, clashing names, plan."""

import hashlib
import random
from collections import defaultdict

from threadlens.llm import linededup as L

WHITE = " \t\n\x0b\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, min_chars, min_docs):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(WHITE))
            if len(k) >= min_chars:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            ids = held.get(lower(line.strip(WHITE)), set())
            last = max((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == last:
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows],
                                 "doc_id long, text string, kept string, dropped int, `line.1` string").repartition(3)
    got = L.drop_repeated_lines(docs, **kw)
    return sorted(map(repr, (tuple(r) for r in got.select("row.doc_id", "n_lines", "n_dropped", "kept").collect())))


def test_equals_a_plain_version(spark):
    rng = random.Random(4)
    lines = ["  shared Line one \t", "SHARED line ONE", "É shared", "é shared", "short", "", "  ", "\x0bshared tail\f\r", "shared tail"]
    for trial in range(4):
        rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for _ in range(40)]
        rows += [(None, None), (3, None), (5, ""), rows[0], rows[0], (99, "shared tail\nshared tail"), (7, "shared tail\n" * 20_000)]
        for chars, docs in ((5, 3), (0, 1), (11, 5)):
            assert result(spark, rows, min_chars=chars, min_docs=docs) == sorted(map(repr, plain(rows, chars, docs)))


def test_code_points_and_thresholds(spark):
    key40, key39 = "é" * 40, "é" * 39
    rows = [(i, f"{key40}\n{key39}\nown {i}") for i in range(5)] + [(9, "x" * 40), (10, "x" * 40)]
    got = {r.doc_id: r for r in L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("row.doc_id", "kept", "n_dropped").collect()}
    assert got[0].kept == f"{key39}\nown 0" and got[0].n_dropped == 1 and got[4].n_dropped == 0 and got[9].n_dropped == 0


def test_empty_table(spark):
    assert L.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string, row int")).count() == 0


def test_whole_row_stays(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 2)], "doc_id long, text string, row string, id int")
    r = L.drop_repeated_lines(docs).first()
    assert r.row.asDict() == {"doc_id": 1, "text": "a\nb", "row": "x", "id": 2} and r.kept == "a\nb"


def test_plan_has_no_python_and_lines_leave_without_text(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = L.op11_line_dedup(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    text = L.op11_line_dedup(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    generate = [x for x in text.splitlines() if "Generate posexplode" in x]
    assert len(generate) == 2 and "xxhash64(text" in text.split(generate[0])[1].split("Relation")[0]


def test_hash_of_kept_text(spark, tmp_path):
    line = "a line of text that is long enough to count " * 2
    spark.createDataFrame([(i, f"{line}\nown") for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op11_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0].kept_sha256 == hashlib.sha256(b"own").hexdigest() and got[5].n_dropped == 0
