"""SimHash fingerprints and components against brute force."""

import random

import xxhash

from threadlens.llm import simhash as S


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_fingerprint_definition():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(rng.choice(["The", "É", "cat x", "\x1cq", "a"]) for _ in range(n))
        assert S.fingerprint(t.encode()) == slow_print(t)
    assert S.fingerprint(None) == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    got = S.linked_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    want = {(a, b) for a in prints for b in prints
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_registered_query_equals_brute_force(spark):
    from threadlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    assert set(out) == set(docs)
    for i, r in out.items():
        assert r.fingerprint == f"{prints[i]:016x}" and r.component_id == want[i]


def test_long_chain_of_links_and_kept_rows(spark):
    # fingerprints 0, 3, 15, 63, ...: each two bits from the next, a chain of 33
    chain = [(1 << 2 * k) - 1 for k in range(33)]
    rows = [(100 - k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(chain)]
    out = S.fingerprint_components(spark.createDataFrame(rows, "id long, fp long")).collect()
    assert len(out) == 33 and {r.component_id for r in out} == {68}


def test_edges(spark):
    schema = "doc_id long, text string, fp int, _row0 string, id string"
    assert S.simhash_components(spark.createDataFrame([], schema)).count() == 0
    text = "one two three four five six " * 3000
    rows = [(None, text, 1, "a", "x"), (5, text, 2, "b", "y"), (3, text, 3, "c", "z"), (3, text, 3, "c", "z"),
            (9, None, 4, "d", "w"), (8, "  ", 5, None, None), (7, "another text here to keep", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = S.simhash_components(docs).collect()
    assert len(out) == 7 and sorted(r.component_id for r in out) == [3, 3, 3, 3, 7, 8, 8]
    kept = S.keep_one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
