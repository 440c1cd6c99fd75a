"""Keyword tables through the gram index: against plain substring tests, and the plan's size."""

import random

from pyspark.sql import functions as F

from conftest import AS_OF, frame, msg
from threadlens.operators import keywords as KW
from threadlens.operators.features import keyword_hits


def plain(rows, keywords):
    return sorted((r["message_id"], name, k) for r in rows for name, k in set(keywords)
                  if k and k in f"{r['subject'] or ''} {r['body'] or ''}".lower())


def messages(rng, n, alphabet="abcé ", longest=60):
    def text():
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
    return [msg(i, "c", AS_OF, subject=rng.choice([None, text()]), body=rng.choice([None, text(), text().upper()])) for i in range(n)]


def test_equals_plain_substring_tests(spark):
    rng = random.Random(3)
    rows = messages(rng, 60)
    kws = [(rng.choice("xyz"), "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 7)))) for _ in range(300)]
    kws += [("x", ""), ("x", None), ("y", "É"), ("y", "a.c"), ("z", "zzz"), ("x", "a" * 500)] + kws[:20]
    table = spark.createDataFrame(kws, "list_name string, keyword string")
    got = sorted(map(tuple, KW.keyword_table_hits(frame(spark, rows), table).collect()))
    assert got == plain(rows, kws) and len(got) > 500


def test_a_small_list_gives_what_the_literal_one_does(spark):
    rows = messages(random.Random(4), 40, "late urgnkm ")
    lists = {"delay": ("late", "lat"), "urgent": ("urgent", "ur", "e")}
    table = spark.createDataFrame([(n, k) for n, ks in lists.items() for k in ks], "list_name string, keyword string")
    m = frame(spark, rows)
    assert sorted(map(tuple, KW.keyword_table_hits(m, table).collect())) == sorted(map(tuple, keyword_hits(m, lists).collect()))


def test_index_files_each_keyword_under_its_rarest_gram(spark):
    texts = spark.createDataFrame([(1, "the cat"), (2, "the cow"), (3, "the quick cat")], "message_id long, text string")
    kws = spark.createDataFrame([("l", "the cat"), ("l", "the"), ("l", "no such"), ("l", "he q")], "list_name string, keyword string")
    got = {r.keyword: r.gram for r in KW.keyword_index(texts, kws, [3]).collect()}
    assert got == {"the cat": " ca", "the": "the", "he q": "e q"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "list_name string, keyword string")
    m = frame(spark, [msg(1, "c", AS_OF, body="x")])
    assert KW.keyword_table_hits(m, none).count() == 0
    some = spark.createDataFrame([("l", "x")], "list_name string, keyword string")
    assert KW.keyword_table_hits(m.limit(0), some).count() == 0


def test_hundred_thousand_keywords_leave_the_plan_as_small(spark, tmp_path):
    def plan(n):
        spark.range(n).selectExpr("'l' AS list_name", "concat('kw', id, 'x') AS keyword").write.parquet(f"{tmp_path}/{n}")
        table = spark.read.parquet(f"{tmp_path}/{n}")
        rows = [msg(i, "c", AS_OF, body=f"see kw{i * 37}x and kw{i}") for i in range(300)]
        df = KW.keyword_table_hits(frame(spark, rows), table)
        return df, len(df._jdf.queryExecution().optimizedPlan().toString())
    few, size_few = plan(10)
    many, size_many = plan(100_000)
    assert abs(size_few - size_many) < 50 and "Cartesian" not in many._jdf.queryExecution().toString()
    assert sorted(r.keyword for r in many.collect()) == sorted(f"kw{i * 37}x" for i in range(300))


def test_words_that_share_grams_are_no_candidates(spark):
    """Words of few syllables: nearly every word has nearly every three characters.  Only true hits leave the index,
    keywords longer than a gram included; rows of equal ids and texts each keep their hits."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["tha", "ing", "ere", "on"]) for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = [msg(i, "c", AS_OF, subject=None, body=" ".join(rng.sample(words, 8)) + "." + "thaing" * 20) for i in range(60)]
    rows += [msg(0, "c", AS_OF, subject=None, body=rows[0]["body"])]
    kws = [("x", w) for w in sorted(set(words))] + [("y", "thaing" * 15), ("y", "e th"), ("y", "THA"), ("y", "athaing.thaing")]
    table = spark.createDataFrame(kws, "list_name string, keyword string")
    assert sorted(map(tuple, KW.keyword_table_hits(frame(spark, rows), table).collect())) == plain(rows, kws)
    texts = spark.createDataFrame([(w, w) for w in sorted(set(words))], "key string, text string")
    index = KW.keyword_index(texts, table.where("list_name = 'x'"), [6, 7, 8])
    offered = texts.select("key", F.explode(KW.grams(F.col("text"), [6, 7, 8])).alias("gram")).join(index, "gram").count()
    assert offered < 3 * KW.contained(texts, table.where("list_name = 'x'"), [6, 7, 8]).count()


def test_grams_and_texts_are_not_multiplied_by_the_keywords_of_a_gram(spark):
    """A message meets what its words hold: rows that cross exchanges are in proportion to words and hits."""
    table = spark.createDataFrame([("x", f"prefix{i:05d}") for i in range(2000)], "list_name string, keyword string")
    rows = [msg(i, "c", AS_OF, subject=None, body=f"see prefix{i:05d} and prefixes") for i in range(50)]
    df = KW.keyword_table_hits(frame(spark, rows), table)
    assert df.count() == 50
    index = KW.keyword_index(spark.createDataFrame([(w,) for r in rows for w in r["body"].split()], "text string"), table, [KW.GRAM])
    assert max(r["count"] for r in index.groupBy("gram").count().collect()) <= 100
