"""Queries that SQL can express, against DuckDB; edge cases of those operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from threadlens.llm import decontam, licenses, urlrules
from threadlens.llm.catalog import ORACLE, QUERIES
from tools.compare import digest


def compare(name, tables, rows, cols):
    con = duckdb.connect()
    for t, p in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(cols)
    a, b = digest(rows, cols), digest(rel.fetchall(), rel.columns)
    assert a[0] == b[0], (set(a[1]) - set(b[1]), set(b[1]) - set(a[1]))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_generated_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    compare(name, {t: f"{sf}/{t}.parquet" for t in ("documents", "pages", "benchmark", "conversations", "embeddings")},
            [tuple(r) for r in df.collect()], df.columns)


WORDS = "alpha beta gamma delta the under mit license apache version 2 cc by nc É é".split()


@pytest.mark.parametrize("name", ["op3_license_scan", "op7_decontamination", "op11_line_dedup"])
def test_odd_texts(spark, tmp_path, name):
    import random
    rng = random.Random(9)
    texts = [None, "", " \n\n ", "a", "The MIT\nLicense", "under the mit license", "Under the MIT License under the mit license",
             "cc by nc cc by nc cc by nc", "a a a a a a a a a a a a a a a", "É", "é", "Released, under: the MIT. License!",
             "lic\u212aense under the mit license", "word " * 20_000 + "under the mit license"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(i if i % 9 else None, t, i, "x", "y") for i, t in enumerate(texts + texts[:8])]
    spark.createDataFrame(rows, "doc_id long, text string, n long, key string, labels string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, None), (1, ""), (2, "alpha"), (3, "É"), (4, "a a a a a a a a a a a a"), (4, "under the"), (None, "cc by nc"),
             (6, "Nothing like this is anywhere"), (7, "alpha beta"), (7, "alpha beta")]
    items += [(20 + i, t) for i, t in enumerate(texts[20:30])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(rows)
    compare(name, {t: f"{tmp_path}/{t}.parquet/*.parquet" for t in ("documents", "benchmark")}, got, df.columns)


NOTICES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Released under the MIT License.", "mit"), ("This work is licensed under the Mozilla Public License, version 2.0.", "mpl-2"),
    ("The driver licensed under the old scheme lost the license", ""), ("a license under the sea, released by the mit", ""),
    ("Redistribution and use in source and\nbinary forms, with or without modification,\nare permitted provided that the\nfollowing conditions are met:", "bsd-3"),
    ("This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public\n * License as "
     "published by the Free Software Foundation, either version 3 of\n * the License, or (at your option) any later version.", "gpl-3"),
    ("This work is licensed under the GNU General Public\nLicense, version 3.", "gpl-3"),
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, "
     "to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\n"
     "distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Redistribution and use of this picture is not allowed", ""),
    ("Released under the MIT License. " + "x " * 40 + "Licensed under the Apache License, Version 2.0.", "apache-2,mit"),
    ("Released under the MIT License. Parts are licensed under CC BY-SA 4.0.", "cc-by-sa,mit"),
]


def test_each_notice_gets_its_own_label_alone(spark):
    rows = [(i, pad + text, label) for i, (text, label) in enumerate(NOTICES) for pad in ("", "Some words stand before.\n# ")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted((r.id, ",".join(r.labels)) for r in got) == sorted((i, label) for i, _, label in rows)


def test_template_words_lower_ascii_letters_alone():
    assert licenses.template_words([("x", "Über MIT", "Über MIT É")]) == [(0, "x", "Über mit", ["Über", "mit", "É"])]


def test_labels_of_the_generated_notices(spark):
    """Every document of the table that holds a notice, and no other, gets that notice's label."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.id: ",".join(r.labels) for r in licenses.scan_licenses(docs).collect()}
    want = {r.doc_id: ",".join(sorted({label for text, label in NOTICES[:7] if text in (r.text or "")}))
            for r in docs.select("doc_id", "text").collect()}
    found = {i for i, x in got.items() if x}
    assert len(found) > 200 and {i: x for i, x in want.items() if x and got[i] != x} == {}
    assert {i: got[i] for i in found if not want[i]} == {}


def found_places(docs, items):
    places, of_window = decontam.occurrences(docs, items)
    hits = decontam.text_hits(places, of_window)
    return sorted(map(tuple, places.collect())), sorted((r.key, r.n_hit, tuple(r.items)) for r in hits.collect())


def test_windows_too_many_to_broadcast_find_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = found_places(docs, items)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(decontam, "SECTION", 7)  # stretches reach over edges
    assert one[0] and one == found_places(docs, items)


def test_items_never_travel_with_the_broadcast_windows(spark):
    """A window that every item shares is one row of the broadcast, whatever their number."""
    words = "one two three four five six seven eight nine ten"
    items = spark.range(3000).selectExpr("id AS item_id", f"concat('{words} ', id) AS text")
    docs = spark.createDataFrame([(1, f"x {words} y"), (2, "no")], "doc_id long, text string")
    out = {r.id: (r.n_hit, len(r["items"])) for r in decontam.contamination(docs, items).collect()}
    assert out == {1: (10, 3000), 2: (0, 0)}
    once = decontam.item_windows(items, "item_id", "text", 10).select("win").distinct().count()
    plan = decontam._occurrences(docs.selectExpr("'k' AS key", "split(text, ' ') AS words"),
                                 decontam.item_windows(items, "item_id", "text", 10).withColumns(
                                     {"w1": F.xxhash64("win"), "w2": F.xxhash64(F.lit(1), F.col("win"))}).drop("item").distinct(), 2)
    assert once == 3001 and "collect_set" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, id int, words string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert licenses.scan_licenses(docs).count() == 0
    assert decontam.contamination(docs, items).count() == 0
    assert [tuple(r) for r in decontam.contamination(some, items).collect()] == [(1, 3, 0, [])]
    assert decontam.drop_contaminated(some.withColumnRenamed("doc_id", "_key0"), items).count() == 1
    pages = spark.createDataFrame([], "page_id long, url string, row int")
    assert urlrules.judge_urls(pages).count() == 0


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en",
            "http://a.b.example.com/en/?q", "https://net/es/", "https://x.NET/fr/#t", "https://notexample.com/en/",
            "http://casino-win.example.org/a", "http://m.free-bets.net/de/", "http://cheap-pills.com", "http://com?x",
            "http://x.com:80/", "a://b://c.net/es/", "http://É.net/es/é", "http://x.org/casino-win.html", "http://\n.net/es/"] * 2
    rows = [(i if i % 7 else None, u, "r", 1) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, rule string, row int").write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["op6_url_filter"](spark, str(tmp_path))
    compare("op6_url_filter", {"pages": f"{tmp_path}/pages.parquet/*.parquet"}, [tuple(r) for r in df.collect()], df.columns)


def test_pattern_rules_run_only_on_urls_with_their_token(spark):
    rules = ((r"foo[0-9]*\.html", ()), (r"/(promo)/", ("promo",)))
    pages = spark.createDataFrame([(1, "http://a/foo12.html"), (2, "http://a/promo/x"), (3, "http://a/b")], "page_id long, url string")
    out = {r.id: r.verdict for r in urlrules.judge_urls(pages, host_rules=(), pattern_rules=rules).collect()}
    assert out == {1: "block", 2: "block", 3: "allow"}


def test_literals_are_whole_tokens_of_every_match(spark, tmp_path):
    urls = ["http://ads.example.organic.net/", "http://ads.example.org/"] + [f"http://x.example.com/{i}" for i in range(5)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES["op6_url_filter"](spark, str(tmp_path))  # org is rarer than example here
    rows = [tuple(r) for r in df.collect()]
    compare("op6_url_filter", {"pages": f"{tmp_path}/pages.parquet/*.parquet"}, rows, df.columns)


def test_host_rules_are_filed_under_their_rarest_token(spark):
    urls = ["http://a.com/en/", "http://b.com/en/", "http://example.com/x", "http://c.net/es/", "http://d.net/x", "http://x.net/english"]
    rules = (*urlrules.HOST_RULES, ("block", "net", "/en"))
    offered = spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("explode(regexp_extract_all(url, '([a-z0-9]+)', 1)) AS token")
    out = {r.rule or r.pattern_id: r.token for r in urlrules.rule_index(offered, rules, urlrules.PATTERN_RULES).collect()}
    assert out["com/"] == "com" and out["example.com/en/"] == "example" and out["net/es/"] == "es" and out["net/en"] == "net"
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.id: r.rule for r in urlrules.judge_urls(pages, host_rules=rules).collect()}[5] == "net/en"


def test_very_long_urls_ties_and_capitals_in_rules(spark):
    long = "http://" + "a." * 50_000 + "net/es/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, long), (2, "http://one.two.org/"), (3, "http://X.Net/es/y")], "page_id long, url string")
    rules = (("block", "NET", "/es/"), ("allow", "Example.com", "/"))
    patterns = ((r"two\.org", ("two", "org")), (r"one\.two", ("one", "two")))
    out = {r.id: (r.rule, r.pattern, r.verdict) for r in urlrules.judge_urls(pages, host_rules=rules, pattern_rules=patterns).collect()}
    assert out == {1: ("NET/es/", None, "block"), 2: (None, patterns[0][0], "block"), 3: ("NET/es/", None, "block")}


def test_notices_without_a_naming_phrase_are_compared(spark):
    """A notice that names no license is found by its words, however it begins; and a block is as wide as its notice,
    repeated words and some of its own included."""
    mit = next(t for label, _, t in licenses.TEMPLATES if label == "mit" and t.startswith("Permission"))
    bsd = next(t for label, _, t in licenses.TEMPLATES if label == "bsd-3")
    texts = [("Permission is granted, free of charge" + mit.split("free of charge")[1], "mit"),
             (" ".join(mit.split()[9:]), "mit"), (bsd.replace("Redistribution and use", "Redistribution and any use"), "bsd-3"),
             (" ".join(mit.split()[20:]), ""), ("redistribution modification conditions following permitted", ""),
             ("lorem " * 500 + "Redistribution, use " + bsd.split("and use")[1] + " ipsum" * 500, "bsd-3")]
    got = {r.id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(t for t, _ in texts)), "doc_id long, text string")).collect()}
    assert [",".join(got[i].labels) for i in range(len(texts))] == [x for _, x in texts]
    whole = licenses.scan_licenses(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first()
    assert whole.score == 1.0
    # any run of words that meets the threshold holds an anchor
    for phrase, anchors in licenses.block_anchors(licenses.TEMPLATES, 0.8).items():
        n = len(next(ws for _, _, p, ws in licenses.template_words(licenses.TEMPLATES) if p == phrase))
        assert n - len(anchors) < licenses.words_needed(n, 0.8)
