"""Structure repair of conversations: cheapest edits that make the roles follow ``(s?(ua)+)?``.

Every row becomes one symbol: the initial of its role (s, u, a, o for others; capital if the text is
truncated), or x if it must go (blank, or role and text seen earlier).  A conversation's symbols are its
signature.  Distinct signatures of all conversations are sorted by their reversed text and cut into ranges,
so signatures that share a tail lie side by side: each tail is one node of an automaton minimised from the
end, and a task that walks its range in order keeps the nodes of the tail at hand on a stack.  Per node and
grammar state the cost to go and the first edit of the ASCII-least cheapest audit are worked out once
(again only for the tail shared across the edge of two ranges).  Two edits with the same initial never
lead to different states, so ties are settled by the initials alone and no audit text is compared.

Rows cross one narrow exchange (hashes and flags, equal rows counted beforehand) for the signatures, and one
with their texts for the hash, sorted by conversation and read as a stream: of a conversation a task holds
the signature or the audit, a byte per row, never its texts.  The digest of a conversation is one SHA-256
over all of it, so a single conversation's texts pass one task, as a stream.

Nulls in role and text read as one space; rows without an id are one conversation (id null), rows without a
turn come first.  Rows of equal turn are ordered by role, then by the MD5 of the text; equal rows are rows of
their own, the later ones duplicates.  Gaps beyond the range of a long count as the largest long.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

WHITE = " \t\n\x0b\f\r"
LEGAL = {b"su", b"ua", b"au"}
# grammar states: nothing yet, after s, after u, after a; the first and the last accept
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # state behind an inserted or re-roled row
ROLE = (b"user", b"user", b"assistant", b"user")  # and that row's role
KEEP = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))  # cost to go and first edit behind the last row


@lru_cache(maxsize=None)
def node(symbol: str, behind: tuple) -> tuple:
    """Cost to go and first edit per state, of the tail that starts with ``symbol``; ``behind`` has the
    costs of the rest, less their smallest, so there are but a few dozen different ones."""
    options = []
    for state in range(4):
        ways = [(DELETE + behind[state], "D")]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            ways.append((REROLE + extra + behind[NEXT[state]], "R"))
            if symbol.lower() in KEEP[state]:
                ways.append((extra + behind[KEEP[state][symbol.lower()]], "K"))
        options.append(min(ways))
    best = options
    for _ in range(3):  # inserted rows, at most one per state on a cheapest way
        best = [min(options[s], (INSERT + best[NEXT[s]][0], "I")) for s in range(4)]
    costs = [c for c, _ in best]
    least = min(costs)
    return tuple(c - least for c in costs), least, "".join(e for _, e in best)


def solve(signatures):
    """(signature, cost, audit) of signatures, in an order in which shared tails lie side by side."""
    costs, firsts, totals, before = [END[0]], [END[1]], [0], ""
    for signature in signatures:
        tail = signature[::-1]
        same = 0
        for a, b in zip(tail, before):
            if a != b:
                break
            same += 1
        del costs[same + 1:], firsts[same + 1:], totals[same + 1:]
        for symbol in tail[same:]:
            rest, least, edits = node(symbol, costs[-1])
            costs.append(rest)
            firsts.append(edits)
            totals.append(totals[-1] + least)
        before = tail
        yield signature, totals[-1] + costs[-1][START], walk(signature, firsts)


def walk(signature: str, firsts: list) -> str:
    """The audit from the first edits of every tail (by its length)."""
    out, state, left = [], START, len(signature)
    while edit := firsts[left][state]:
        out.append(edit)
        if edit == "K":
            state = KEEP[state][signature[len(signature) - left].lower()]
        elif edit != "D":
            state = NEXT[state]
        if edit != "I":
            left -= 1
    return "".join(out)


def read_rows(batches, binary=()):
    """Rows of Arrow batches as tuples; texts as bytes."""
    for batch in batches:
        yield from zip(*[(c.cast(pa.binary()) if n in binary else c).to_pylist()
                         for n, c in zip(batch.schema.names, batch.columns)])


def in_batches(rows, schema: pa.Schema, size: int = 2000):
    """Tuples as Arrow batches of at most ``size`` rows."""
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def conversations_of(rows):
    """(id, rows) of sorted rows whose first field is the id; the rows are read once, as they come."""
    from itertools import groupby

    yield from groupby(rows, key=lambda r: r[0])


def signatures_of(rows):
    """Sorted (id, turn, initial, blank, truncated, fresh, copies) -> one summary per conversation; copies 0
    stands for a conversation without rows."""
    for conv, some in conversations_of(rows):
        symbols, blanks, duplicates, cuts, illegal = [], 0, 0, 0, 0
        low = high = before = None
        turns = 0
        for _, turn, initial, blank, truncated, fresh, copies in some:
            if not copies:
                continue
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            illegal += (copies - 1) * (initial + initial not in LEGAL)
            if before is not None:
                illegal += before + initial not in LEGAL
            before = initial
            if blank:
                blanks += copies
                symbols.append("x" * copies)
                continue
            kept = 1 if fresh else 0
            duplicates += copies - kept
            if fresh:
                name = initial.decode() if initial in (b"s", b"u", b"a") else "o"
                cuts += truncated
                symbols.append(name.upper() if truncated else name)
            symbols.append("x" * (copies - kept))
        gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
        yield conv, "".join(symbols), gaps, blanks, duplicates, cuts, illegal


def repaired(rows):
    """Sorted (id, kind, role, text, audit): of each conversation its audit (kind 0), then its rows ->
    (id, SHA-256 of the repaired rows, written role:text, one per line)."""
    for conv, some in conversations_of(rows):
        digest, first, state, at, audit = hashlib.sha256(), True, START, 0, next(some)[4] or ""

        def put(role, text):
            nonlocal first
            digest.update(b"" if first else b"\n")
            digest.update(role + b":")
            digest.update(text)
            first = False

        def insert():
            nonlocal state, at
            while audit[at:at + 1] == "I":
                put(ROLE[state], b"")
                state, at = NEXT[state], at + 1

        for _, _, role, text, _ in some:
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(role, text)
                state = KEEP[state][role[:1].decode()]
            elif edit == "R":
                put(ROLE[state], text)
                state = NEXT[state]
        insert()
        yield conv, digest.hexdigest()


def stream(df: DataFrame, order: list, take: list, fn, schema: str, binary=()) -> DataFrame:
    """All rows of a conversation in one partition, in order, their columns ``take`` through ``fn`` (an
    iterator of rows to one of rows).  Sorting spills; the rows pass as a stream."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        yield from in_batches(fn(read_rows(batches, binary)), arrow)

    return df.repartition("id").sortWithinPartitions(*order).select(*take).mapInArrow(run, schema)


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.  ``ids`` may name further conversations (column ``id_col``); those without rows get
    zeros, an empty audit and the hash of the empty text."""
    kind = rows.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(" "))
    stripped = F.btrim(text, F.lit(WHITE))
    base = rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.md5(text.cast("binary")).alias("hash"),
        text.alias("text"), (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    # equal rows are counted, then the first of each role and text is marked; blank rows never need that, so
    # they are dealt by turn
    counted = base.groupBy("id", "turn", "role", "hash", "blank", "truncated").agg(F.count("*").alias("copies"))
    seen = Window.partitionBy("id", "role", "hash", F.when(F.col("blank"), F.col("turn"))).orderBy(
        F.col("turn").asc_nulls_first())
    narrow = counted.withColumns({"fresh": F.row_number().over(seen) == 1, "initial": F.substring("role", 1, 1)})
    if ids is not None:
        none = ids.select(F.col(id_col).cast(kind).alias("id")).distinct()
        narrow = narrow.unionByName(none.withColumn("copies", F.lit(0).cast("long")), allowMissingColumns=True)
    order = ["id", F.col("turn").asc_nulls_first(), "role", "hash"]

    found = stored(stream(narrow, order, ["id", "turn", "initial", "blank", "truncated", "fresh", "copies"], signatures_of,
                          f"id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long",
                          binary=("initial",)), "signatures")
    tails = found.select("signature").distinct().withColumn("tail", F.reverse("signature"))

    def solved(batches):
        schema = pa.schema([("solved", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
        yield from in_batches(solve(r[0] for r in read_rows(batches)), schema)

    plans = tails.repartitionByRange("tail").sortWithinPartitions("tail").select("signature").mapInArrow(
        solved, "solved string, cost long, audit string")
    planned = stored(found.join(plans, F.col("signature") == F.col("solved"), "left").drop("signature", "solved"), "plans")
    texts = base.select("id", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("audit"), "turn", "hash")
    audits = planned.select("id", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "audit",
                            F.lit(None).cast("long").alias("turn"), F.lit("").alias("hash"))

    hashes = stream(audits.unionByName(texts), ["id", "kind", *order[1:]], ["id", "kind", "role", "text", "audit"], repaired,
                    f"same_id {kind}, repaired_sha256 string", binary=("role", "text"))
    return planned.join(hashes, F.col("id").eqNullSafe(F.col("same_id"))).select(
        "id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of id and turn, modulo 20: 0 drops the row, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.  Nulls are written as one space."""
    def word(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(word("text"), ".!?", "")) \
        .otherwise(word("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(word("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
            .drop("copy"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Registered query: all conversations, damaged, then repaired; every original conv_id."""
    whole = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damage(whole), ids=whole).withColumnRenamed("id", "conv_id")


# One recursive step per row from the end: per state the cost to go (c), the audit (a) and the repaired rows (t).
_STATES = {"z": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
_KEEPS = {"z": (("s", "s"), ("u", "u")), "s": (("u", "u"),), "u": (("a", "a"),), "a": (("u", "u"),)}


def _step() -> tuple[str, str]:
    """SQL of one step: the ways of each state without an inserted row, then with up to two before it."""
    rows, found = [], []
    for s, (n, role) in _STATES.items():
        ways = [f"(4 + r.{s}.c, 'D' || r.{s}.a, r.{s}.t)",
                f"(CASE WHEN NOT p.gone THEN 3 + p.extra + r.{n}.c ELSE 1e9::BIGINT END, 'R' || r.{n}.a, list_prepend('{role}:' || p.text, r.{n}.t))"]
        ways += [f"(CASE WHEN NOT p.gone AND p.initial = '{i}' THEN p.extra + r.{to}.c ELSE 1e9::BIGINT END, 'K' || r.{to}.a, list_prepend(p.role || ':' || p.text, r.{to}.t))"
                 for i, to in _KEEPS[s]]
        ways = [w[:1] + "c := " + w[1:].replace(", '", ", a := '", 1).replace(", list_prepend", ", t := list_prepend").replace(f", r.{s}.t)", f", t := r.{s}.t)") for w in ways]
        rows.append("list_min([" + ", ".join("struct_pack" + w for w in ways) + f"]) AS {s}")

    def inserted(s, depth):
        if not depth:
            return s
        n, role = _STATES[s]
        more = inserted(n, depth - 1)
        return f"least({s}, struct_pack(c := 3 + ({more}).c, a := 'I' || ({more}).a, t := list_prepend('{role}:', ({more}).t)))"
    found = [f"{inserted(s, 2)} AS {s}" for s in _STATES]
    return ", ".join(rows), ", ".join(found)


_ROWS, _FOUND = _step()

ORACLE = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
crced AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS fault
  FROM keyed, crc_table),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crced WHERE fault <> 0),
ordered AS (
  SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial,
         row_number() OVER w AS i, lead(left(role, 1)) OVER w AS following
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
counted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered),
flagged AS (
  SELECT *, core = '' AS blank, core <> '' AND nth > 1 AS duplicate,
         core <> '' AND nth = 1 AND right(core, 1) NOT IN ('.', '!', '?') AS truncated FROM counted),
positions AS MATERIALIZED (
  SELECT conv_id, i, role, text, initial, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS extra FROM flagged),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (following IS NOT NULL AND (initial || following) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM flagged GROUP BY conv_id),
steps AS (
  SELECT conv_id, n AS i, struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[]) AS z,
         struct_pack(c := 6::BIGINT, a := 'II', t := ['user:', 'assistant:']) AS s,
         struct_pack(c := 3::BIGINT, a := 'I', t := ['assistant:']) AS u,
         struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[]) AS a FROM facts
  UNION ALL
  SELECT conv_id, i, {_FOUND} FROM (
    SELECT p.conv_id, p.i - 1 AS i, {_ROWS}
    FROM steps r JOIN positions p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0) AS cost,
       coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.t, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN steps ON steps.conv_id IS NOT DISTINCT FROM ids.conv_id AND steps.i = 0
"""
