"""Spelling variants against brute force; blocks cut into parts; edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadlens.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, longer = sorted((a, b), key=len)
    return any(longer[:i] + longer[i + 1:] == short for i in range(len(longer)))


def random_words(rng, n, letters="abcdéö"):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
        out.add(w)
        if rng.random() < 0.5:
            i = rng.randrange(len(w) + 1)
            out.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:] or "x"]))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_near_words_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_WORDS", block)
    monkeypatch.setattr(S, "CELLS", 50)
    words = random_words(random.Random(block), 400) + ["x" * 3000, "x" * 3001, "x" * 2999 + "y"]
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(5)
    got = Counter(tuple(r) for r in S.near_words(frame).collect())
    want = {(a, b, j + 1) for a in words for j, b in enumerate(words) if one_edit(a, b)}
    assert len(want) > 500 and set(got) == want and max(got.values()) == 1


def test_group_count_follows_the_vocabulary():
    sums = {c: (1000.0 * (i % 3 + 1), 3000.0 * (i % 3 + 1)) for i, c in enumerate(range(97, 123))}
    counts = [len(S.letter_groups({c: (s * n, s2 * n) for c, (s, s2) in sums.items()}, n * 1000)) for n in (1, 1000, 10**6)]
    assert counts == sorted(counts) and counts[0] < counts[-1] <= 12
    assert sorted(x for g in S.letter_groups(sums, 1000) for x in g) == list(range(97, 123))
    for g in range(1, 13):
        S.moves(g)


def test_one_edit_of_padded_words():
    words = ["", "a", "b", "ab", "ba", "aab", "abb", "abcabc", "bcabc", "abcabca", "abxabc", "é", "éa"]
    w = S.Words(pa.array([x.encode("latin-1") for x in words], pa.binary()), np.ones(len(words)))
    i, j = map(np.ravel, np.meshgrid(range(len(words)), range(len(words))))
    assert S.one_edit(w, i, w, j).tolist() == [one_edit(words[a], words[b]) for a, b in zip(i, j)]


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(6)
    base = ["garden", "gardens", "gerden", "Straße", "strasse", "ÿÀ×÷é", "abcde", "abcdef", "abcdx", "four", "GARDEN", "Ｇarden", "gardeńs"]
    texts = [None, "", "  ", "x" * 100_000, "aĀgarden", *(" ".join(rng.choice(base) for _ in range(rng.randint(0, 60))) for _ in range(120))]
    rows = [(i if i % 11 else None, t, "w", 1) for i, t in enumerate(texts + texts[:30])]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text, _, _ in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                word = S.drop_a_letter(doc_id, run.encode("latin-1")).decode("latin-1")
                counts[word] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form = {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    want = {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}
    got = [tuple(r) for r in S.op12_spelling_variants(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and any(w in form and form[w] in form for w in words) | bool(form)


def test_damage():
    import zlib
    run = next(r for r in (f"w{chr(97 + i // 26)}{chr(97 + i % 26)}é" for i in range(676)) if zlib.crc32(f"7:{r}".encode()) % 97 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % 4
    assert S.drop_a_letter(7, run.encode("latin-1")).decode("latin-1") == run[:at] + run[at + 1:]


def test_long_chains_end_at_one_root(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(50)], "word string, form string")
    assert {r.root for r in S.roots_of(links).collect()} == {"w50"}


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
