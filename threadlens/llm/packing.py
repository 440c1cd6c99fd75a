"""Packing documents into token sequences: first-fit decreasing in randomised groups.

Each task turns whole texts into token ids and cuts every document into pieces of at most
``length`` ids.  Pieces get a random group number (a hash of where the row was read, fixed once the
pieces are written); each group is packed by itself by first-fit decreasing, a tournament tree over
the bins' free room finding the first bin that a piece fits.  Groups hold about ``group_pieces``
pieces whatever the input, so no task grows with it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

END = np.array([1], "<u4").tobytes()
BLANKS = regex.compile("[\\s\x1c-\x1f\x85] [\\s\x1c-\x1f\x85]")
CACHE_WORDS = 400_000
"""Distinct words kept by a task."""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def rank_encoder(path: str):
    """ids of a word by the rank file of a byte-level vocabulary (the fast way for single words)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordIds(dict):
    """word -> the ids of a space and the word, as bytes; kept once found, for so many words."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


class CachedTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer never joins characters across a single space after which a word
    begins: the space opens the next word.  So a text is cut before each space and each piece is
    encoded by itself, distinct ones once: by the same vocabulary's rank file if one is given, else by
    the tokenizer.  Texts with a space between two white-space characters, where the rule is another, go
    to the tokenizer whole.  ``encode_many`` equals the tokenizer on whole texts (see the tests)."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(rank_encoder(ranks) if ranks else self.ids)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out = []
        word_ids = self.words.__getitem__
        for t in texts:
            if BLANKS.search(t) or any(s in t for s in self.special):
                out.append(np.array(self.ids(t), "<u4").tobytes())
            else:
                head, *words = t.split(" ")
                begin = np.array(self.ids(head), "<u4").tobytes() if head else b""
                out.append(begin + b"".join(map(word_ids, words)))
        return out


def piece_rows(texts: list[str], tokenizer: CachedTokenizer, length: int, keep_ids: bool) -> dict:
    """Columns of the pieces of some texts; ``doc`` is the text's place in the list."""
    out: dict = {k: [] for k in ("doc", "start", "length", "ids_crc32", "doc_tokens", "ids")}
    for doc, ids in enumerate(tokenizer.encode_many(texts)):
        ids += END
        n = len(ids) // 4
        for start in range(0, n, length):
            part = ids[4 * start:4 * (start + length)]
            for k, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None)):
                out[k].append(v)
    return out


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
                     tokenizer: str | None = None, ranks: str | None = None, keep_ids: bool = False, seed: int = 7) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, draw[, ids]): every id of every document (with a
    closing id 1) in exactly one piece.  Null text: empty.  ``draw``: a random long."""
    ids_field = ", ids binary" if keep_ids else ""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, draw long{ids_field}"

    def run(batches):
        if tokenizer:
            tok = CachedTokenizer(tokenizer, ranks)
        else:
            tok = CachedTokenizer(tokenizer_path(), ranks or tokenizer_path("byte_bpe_50k.tiktoken"))
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                p = piece_rows([t or "" for t in some.column(1).to_pylist()], tok, length, keep_ids)
                doc = np.array(p["doc"], np.int64)
                rng = np.random.default_rng([seed, part, row])
                row += some.num_rows
                cols = [some.column(0).take(pa.array(doc))]
                cols += [pa.array(p[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")]
                cols.append(pa.array(rng.integers(0, 2**62, some.num_rows)[doc]))
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "draw"]
                if keep_ids:
                    cols.append(pa.array(p["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  The tournament tree holds at each node the largest free room
    below it, so the first bin with enough is found from the root in log(bins) steps."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            top = left if left > right else right
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """Pieces (a stored table) with sequence_id and offset added.  Sequence ids are unique over
    all groups; offsets are gapless from 0 in a sequence."""
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    fields = [f for f in pieces.schema.fields if f.name != "draw"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    names = [f.name for f in fields]

    def run(key, group):
        group = group.sort_by([("draw", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        return (group.select(names).append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
                .append_column("offset", pa.array(offsets)))

    return pieces.withColumn("pack_group", F.pmod("draw", F.lit(groups))).groupBy("pack_group") \
        .applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
                   tokenizer: str | None = None, ranks: str | None = None, keep_ids: bool = False, group_pieces: int = 8192) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    ``keep_ids``: carry the ids (little-endian unsigned 32-bit) for writing sequences.  A null or
    empty text is one piece of one id; repeated rows are packed each; a text longer than a sequence is
    cut at its multiples; an empty table gives an empty result."""
    pieces = stored(tokenized_pieces(docs, id_col, text_col, length, tokenizer, ranks, keep_ids), "pieces")
    return pack(pieces, length, group_pieces)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
