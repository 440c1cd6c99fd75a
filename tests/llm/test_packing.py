"""Packing: exact round trip of the ids, sequences within bounds, little padding."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadlens.llm import packing as P


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.tokenizer_path())


def test_cached_tokenizer_equals_the_tokenizer(tok):
    rng = random.Random(1)
    parts = ["the", "The,", "don't", "é", "日本", " ", "  ", "   ", "\n", "\n\n", "\t", "12", "x9", "!!", " ", "　",
             "\x1c", "\x85", "á", "<|endoftext|>", "_", "'s", "🙂"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    ranked = P.CachedTokenizer(P.tokenizer_path(), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    alone = P.CachedTokenizer(P.tokenizer_path())
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        cached = alone if at == 0 else ranked
        for t, got in zip(some, cached.encode_many(some)):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def first_fit(sizes, room):
    free, out = [], []
    for s in sizes:
        i = next((i for i, f in enumerate(free) if f >= s), len(free))
        if i == len(free):
            free.append(room)
        out.append((i, room - free[i]))
        free[i] -= s
    return out


def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 300):
        sizes = np.array([rng.randint(1, 50) for _ in range(n)], np.int64)
        bins, offsets = P.first_fit_decreasing(sizes, 50)
        order = np.argsort(-sizes, kind="stable")
        assert list(zip(bins[order], offsets[order])) == first_fit(sizes[order].tolist(), 50)


def check_packing(rows, texts, tok, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return sum(r.length for r in rows) / (len(by_seq) * length)


def test_documents_round_trip(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    full = check_packing(P.pack_documents(docs).collect(), texts, tok, 2048)
    assert full > 0.97
    several = P.pack_documents(docs, group_pieces=40)
    assert check_packing(several.collect(), texts, tok, 2048) > 0.85


def test_edges(spark, tok):
    schema = "doc_id long, text string, start string, draw int, sequence_id int"
    assert P.pack_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", 1, 1), (1, None, "x", 1, 1), (1, None, None, None, None), (2, "", "", 0, 0),
            (2**60 + 1, "word " * 30_000, "", 0, 0)]
    out = P.pack_documents(spark.createDataFrame(rows, schema), keep_ids=True).collect()
    assert sorted((r.id, r.length) for r in out if r.id in (1, 2)) == [(1, 1), (1, 1), (2, 1)]
    long = [r for r in out if r.id == 2**60 + 1]
    assert sum(r.length for r in long) == long[0].doc_tokens > 30_000
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)
