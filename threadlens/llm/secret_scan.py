"""Secret scans: pattern spans, and guess-cost spans for values in credential contexts.

Three fixed patterns give the base spans.  Beside them, every value that stands after a credential
word (links such as "is" or "Bearer" in between are passed) is priced, whole if quoted: the cheapest segmentation into dictionary words, dates, repeats,
keyboard walks and brute-force characters says how many guesses an attacker would need, and a value
of at least ``min_guesses`` (log10) is a span of kind ``guess``.  The dynamic program is linear in the
value's length, as repeats and walks grow by a step cost and words and dates have bounded length.
Words cost their rank in the documents at hand or among the frequent words of passwords.

Values are first priced by the frequent words of passwords alone, text by text.  The few distinct ones that are
dear then meet the ranks of the words inside them in joins (``cheap_values``); a value that its words make
cheap is taken off the texts that hold it, by the text's key and place.  Ranks, words and values stay in tables.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, ship, stored

ship(__name__)

# FIXED VALUES: base patterns, credential words, frequent words of passwords, keyboard rows.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASIDE = r"(?:[^\S\r\n]*(?:\([^()\r\n]{1,60}\)|\[[^\[\]\r\n]{1,60}\]))?"  # password (staging): ...
MARKS = r"""["'`)\]]{0,3}"""
NAME = (r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|"
        rf"(?<![a-z])pass(?={MARKS}{ASIDE}[^\S\r\n]*[:=])|credentials?|bearer|authorization)s?(?![a-z])")
# a value may stand on the line after a colon, an equals sign or an arrow
SEPARATOR = rf"""{MARKS}{ASIDE}(?:([^\S\r\n]*(?:[:=]+>?|->)[^\S\r\n]*(?:\r?\n[^\S\r\n]*)?)|[^\S\r\n]+)"""
CONTEXT = re.compile(rf"{NAME}[A-Za-z0-9_-]*(?P<separator>{SEPARATOR})?")
# the password for the admin account is ...: words up to a verb or a separator
TAIL = re.compile(r"(?:[A-Za-z][A-Za-z'’-]{0,19}[^\S\r\n]+){0,8}?[A-Za-z][A-Za-z'’-]{0,19}(?=[^\S\r\n]+(?i:is|was|are|equals?)\b|[^\S\r\n]*[:=])")
BLANK = re.compile(r"[^\S\r\n]*")
IN_URL = re.compile(r"://[^\s/?#:@]*:([^\s/@]+)@")
LINK = re.compile(rf"({NAME}[A-Za-z_-]*|(?i:is|was|are|be|as|to|set|equals?|follows|the|a|an|my|our|your|his|her|their|of|for|"
                  rf"and|or|use|value|basic|digest|negotiate)\b){SEPARATOR}")
QUOTED = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\.|{q}(?=\w))*(?={q}(?!\w))") for q in "\"'`”’»"}
CLOSING = {"\"": "\"", "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»"}
PLAIN = re.compile(r"\S+")
WORD = re.compile(r"""(?<![^\s"'(\[<])[^\W\d_]{2,32}(?![^\s.,;:!?)"'\]>])""")
LETTERS = re.compile(r"[^\W\d_]{2,}")
LINE = re.compile(r"[^\r\n]*")
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
WORDS = ("password pass secret token admin user login welcome letmein hello qwerty test example sample demo default "
         "changeme master root guest public private access system server client email account service database "
         "dragon monkey football baseball shadow sunshine princess iloveyou summer winter spring autumn monday friday "
         "january february march april june july august september october november december love baby angel flower "
         "money happy freedom whatever nothing computer internet google apple the and you that this with from have "
         "your here there value null none true false string key id name is of to in not for bearer basic").split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

YEAR_AT = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)
YMD_AT = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))", re.ASCII)
DMY_AT = re.compile(r"(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d))", re.ASCII)
LOWER = str.maketrans(UPPER, UPPER.lower())
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DAY, YEAR = math.log10(365.25 * 120), math.log10(120)
FLUSH = 300_000
START = 0.5
"""log10 cost of beginning another segment (where it begins)."""


def neighbours() -> set[tuple[str, str]]:
    """Pairs of keys next to each other, in their row or diagonally, and successive letters/digits."""
    out = set()
    for r, row in enumerate(ROWS):
        for i, key in enumerate(row):
            near = [row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)]
            if r + 1 < len(ROWS):
                near += [ROWS[r + 1][j] for j in (i - 1, i) if 0 <= j < len(ROWS[r + 1])]
            out |= {(key, k) for k in near} | {(k, key) for k in near}
    for seq in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        out |= set(zip(seq, seq[1:])) | set(zip(seq[1:], seq))
    return out


NEAR = neighbours()
RANKS = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
LONGEST = max(map(len, RANKS))


def char_cost(c: str) -> float:
    """log10 of the alphabet that a brute-force attack would need for this character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def shortest(min_guesses: float) -> int:
    """Characters that a value must have to cost that much: brute force, at its dearest, is never dearer."""
    return max(1, math.ceil((min_guesses - START) / math.log10(33)))


def guess_cost(value: str, ranks: dict[str, float] = RANKS, longest: int | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; ``longest``: of the ranked words."""
    n = len(value)
    low = value.translate(LOWER)
    plain = low.translate(LEET)
    longest = max(map(len, ranks), default=0) if longest is None else longest
    best = [0.0] + [math.inf] * n
    walk = repeat = brute = math.inf  # cheapest segmentation whose last segment, of this kind, ends here
    periodic = [math.inf] * 5  # the same for a unit of 1..4 characters said again
    dates: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in ((YEAR_AT, YEAR), (YMD_AT, DAY), (DMY_AT, DAY)):
        for m in pattern.finditer(value):
            dates.setdefault(m.end(1), []).append((m.start(1), cost))
    for i in range(1, n + 1):
        c = low[i - 1]
        one = char_cost(value[i - 1])
        brute = min(brute, best[i - 1] + START) + one
        here = brute
        if i > 1 and (low[i - 2], c) in NEAR:
            walk = min(walk, best[i - 2] + START + char_cost(value[i - 2]) + 0.3) + 0.3
            here = min(here, walk)
        else:
            walk = math.inf
        for p in range(1, 5):
            if i > p and value[i - 1] == value[i - 1 - p]:
                begun = math.inf
                if i >= 2 * p and value[i - p:i] == value[i - 2 * p:i - p]:
                    begun = best[i - 2 * p] + START + sum(map(char_cost, value[i - 2 * p:i - p])) + 0.3
                periodic[p] = min(periodic[p] + 0.05, begun)
                here = min(here, periodic[p])
            else:
                periodic[p] = math.inf
        for k in range(2, min(longest, i) + 1):
            seen = low[i - k:i]
            rank = ranks.get(seen)
            if rank is None and (rank := ranks.get(plain[i - k:i])) is not None:
                rank += 0.5
            if rank is not None:
                upper = 0.0 if value[i - k:i] == seen else 0.5
                here = min(here, best[i - k] + START + rank + upper)
        for a, cost in dates.get(i, ()):
            here = min(here, best[a] + START + cost)
        best[i] = here
    return best[n]


def may_hold(low: str) -> bool:
    """Could this lower-cased text hold a value in a credential context at all?"""
    return any(h in low for h in HINTS) or ("://" in low and "@" in low)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end), sorted, of the values in credential contexts: those named by a credential word, and
    passwords in URLs (``scheme://user:password@host``)."""
    return sorted({*named_values(text), *(m.span(1) for m in IN_URL.finditer(text))})


def named_values(text: str):
    """(start, end) of what stands behind each context word, its separator (a remark in brackets may stand before
    it) and any links (is, Bearer, further context words, up to nine words and a verb ...); the whole of a
    quoted value, else up to the next blank.  A value of letters alone needs a separator or quotes before it."""
    reached = 0  # links passed on the way to the last value lead to that same value
    run_end = end = 0  # of the last run of non-blanks, with and without closing marks
    closed = dict.fromkeys(QUOTED, (0, 0))  # up to here a quote of this kind closes there (0: nowhere)
    for m in CONTEXT.finditer(text):
        if m.start() < reached or m["separator"] is None:
            continue
        at, separated = m.end(), m[2] is not None
        if not separated and (tail := TAIL.match(text, at)):  # other words in between: letters alone stay prose
            at = BLANK.match(text, tail.end()).end()
            if text[at:at + 1] in (":", "="):
                at = BLANK.match(text, at + 1).end()
        while link := LINK.match(text, at):
            if separated and link.end(1) - at >= 6:  # the value itself may begin like a context word
                yield at, link.end(1)
            at, separated = link.end(), separated or link[2] is not None
        reached = at
        closing = CLOSING.get(text[at:at + 1])
        if closing:
            at, separated = at + 1, True
            if at > closed[closing][0]:
                inner = QUOTED[closing].match(text, at)
                closed[closing] = (inner.end(), inner.end()) if inner else (LINE.match(text, at).end(), 0)
            if stop := closed[closing][1]:
                while (link := LINK.match(text, at)) and link.end() < stop:
                    at = link.end()
                yield at, stop
                continue
        if at < run_end:
            yield at, end
        elif run := PLAIN.match(text, at):
            run_end = run.end()
            end = at + len(run[0].rstrip("\"',;.)]}>”’»"))
            if separated or not run[0].strip(".,;:!?\"'()[]{}<>”’»").replace("-", "").replace("'", "").replace("’", "").isalpha():
                yield at, end


def dear_values(text: str, low: str, min_guesses: float):
    """(start, end) of the values that cost ``min_guesses`` or more by the frequent words of passwords.  A value
    that ends inside a longer one is part of it: it costs no more, so what makes the longer one cheap holds for it."""
    least, inside = shortest(min_guesses), 0
    for a, b in values(text) if may_hold(low) else ():
        if b - a >= least and b > inside and guess_cost(text[a:b], RANKS, LONGEST) >= min_guesses:
            yield a, b
            inside = b


def spans(text: str, min_guesses: float = 10.0, cheap=()) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points: the matches of the base patterns that
    are long enough, and the dear values in credential contexts but those of ``cheap`` (start, end)."""
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    low = text.lower()
    if may_hold(low):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [("guess", a, b) for a, b in dear_values(text, low, min_guesses) if (a, b) not in cheap]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    """The text with every span (overlaps merged) replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def text_key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(docs: DataFrame, text_col: str, min_guesses: float) -> DataFrame:
    """One pass over the texts: (word, rows) partial counts of the rows that say a word, and
    (key, start, end, value) of the dear values.  Words stand alone (2 to 32 letters) and outside of
    values in credential contexts, so a secret does not become a word by its own copies."""
    def run(batches):
        def out(rows, dear):
            n, m = len(rows), len(dear)
            return pa.RecordBatch.from_arrays([
                pa.array([*rows, *[None] * m], pa.string()), pa.array([*rows.values(), *[None] * m], pa.int64()),
                *[pa.array([*[None] * n, *[d[k] for d in dear]], t)
                  for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]],
                ["word", "rows", "key", "start", "end", "value"])

        rows, dear = Counter(), []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                low, at, said = text.lower(), 0, []
                if may_hold(low):
                    for a, b in values(text):
                        said.append(text[at:max(a, at)])
                        at = max(at, b)
                    found = list(dear_values(text, low, min_guesses))
                    key = text_key(text) if found else None
                    dear += [(key, a, b, text[a:b]) for a, b in found]
                rows.update(set(WORD.findall(lowered(" ".join([*said, text[at:]])))))
                if len(rows) > FLUSH or len(dear) > FLUSH // 10:
                    yield out(rows, dear)
                    rows, dear = Counter(), []
        yield out(rows, dear)

    return docs.selectExpr(f"`{text_col}` AS text").mapInArrow(
        run, "word string, rows long, key string, start long, `end` long, value string")


def value_words(found: DataFrame) -> DataFrame:
    """(value) -> (value, word): every run of 2 to 32 letters inside it, as it is and unmasked (@ for a ...)."""
    def run(batches):
        def out(some):
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in some], pa.string()), pa.array([w for _, w in some], pa.string())],
                                              ["value", "word"])
        some: set = set()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                low = lowered(value)
                for form in {low, low.translate(LEET)}:
                    for m in LETTERS.finditer(form):
                        for i in range(m.start(), m.end() - 1):
                            some.update((value, form[i:j]) for j in range(i + 2, min(i + 32, m.end()) + 1))
                            if len(some) > FLUSH:
                                yield out(some)
                                some = set()
        yield out(some)

    return found.mapInArrow(run, "value string, word string").distinct()


def cheap_values(docs: DataFrame, text_col: str = "text", min_guesses: float = 10.0, min_rows: int = 3) -> DataFrame:
    """(key, cheap array<struct<start, end>>): by text, the dear values that cost less than ``min_guesses`` once
    the words of at least ``min_rows`` rows of ``docs`` cost their rank by rows."""
    found = stored(candidates(docs, text_col, min_guesses), "secret-candidates")
    counts = found.where("word IS NOT NULL").groupBy("word").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= min_rows)
    counts = stored(counts, "secret-words")
    # one row per number of rows that some word has; a word's rank is one more than the words of more rows
    more = Window.orderBy(F.col("rows").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.groupBy("rows").count().select("rows", (F.coalesce(F.sum("count").over(more), F.lit(0)) + 1).alias("rank"))
    dear = found.where("value IS NOT NULL")
    words = value_words(dear.select("value").distinct()).join(counts, "word").join(ranks, "rows") \
        .groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))

    def price(batches):
        for batch in batches:
            cheap = []
            for value, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = dict(RANKS)
                for w in words:
                    known[w["word"]] = min(known.get(w["word"], math.inf), math.log10(w["rank"] + 1))
                if guess_cost(value, known, max(map(len, known))) < min_guesses:
                    cheap.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cheap, pa.string())], ["value"])

    return stored(dear.join(words.mapInArrow(price, "value string"), "value").select("key", "start", "end").distinct()
                  .groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("cheap")), "cheap-values")


def with_cheap(docs: DataFrame, text_col: str, min_guesses: float, cheap: DataFrame | None) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name is returned) of each text's cheap values; few texts hold any."""
    name, key = (next(x for i in range(99) if (x := f"_{n}{i}") not in docs.columns) for n in ("cheap", "key"))
    cheap = cheap_values(docs, text_col, min_guesses) if cheap is None else cheap
    small = cheap.select(F.col("key").alias(key), F.col("cheap").alias(name))
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    return keyed.join(small, key, "left").drop(key), name


def places(column) -> list[set]:
    return [{(p["start"], p["end"]) for p in some or ()} for some in column.to_pylist()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_guesses: float = 10.0, cheap: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, spans array<struct<kind, start, end>> and the redacted text.

    Null text: no span, redacted text null.  Texts are scanned whole; repeated rows keep a row each.
    ``cheap``: values that are none, by default those of ``cheap_values`` over ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t or "", min_guesses, c) for t, c in zip(texts, places(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], kind),
                pa.array([t if t is None else redact(t, f) if f else t for t, f in zip(texts, found)], pa.string()),
            ], ["id", "spans", "redacted"])

    rows, name = with_cheap(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), "text", min_guesses, cheap)
    return rows.select("id", "text", name).mapInArrow(
        run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars",
                     min_guesses: float = 10.0, cheap: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with every secret span of the text replaced; ``length_col``,
    where there is one, is the new length in characters of a text that changed.  ``cheap`` as in ``scan_secrets``.
    Null texts stay null; an empty table gives none."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            texts = batch.column(text_col).to_pylist()
            found = [spans(t or "", min_guesses, c) for t, c in zip(texts, places(batch.column(len(names))))]
            if any(found):
                new = [redact(t, f) if f else t for t, f in zip(texts, found)]
                columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
                if length_col in columns:
                    old = columns[length_col].to_pylist()
                    columns[length_col] = pa.array([len(t) if f else n for t, f, n in zip(new, found, old)],
                                                   batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    rows, name = with_cheap(docs, text_col, min_guesses, cheap)
    return rows.select(*[F.col(f"`{c}`") for c in names], name).mapInArrow(run, docs.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Registered query: secret spans of all documents."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(text.cast("binary"), 256).alias("base_sha256"), every.alias("spans"),
        count("guess").alias("n_guess"))
