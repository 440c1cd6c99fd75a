"""Conversation repair: the automaton against a search over all cheapest edits, the query against a plain version."""

import hashlib
import heapq
import random
import zlib

from threadlens.llm import convrepair as C

WHITE = " \t\n\x0b\f\r"


def cheapest(symbols):
    """(cost, audit) by shortest paths over (row, state), audits compared as whole texts."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = "" if not roles else roles[-1]
        if i == len(symbols) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))

        def go(c, letter, j, role=""):
            heapq.heappush(heap, (cost + c, audit + letter, j, role or roles))
        then = "a" if state == "u" else "u"
        go(3, "I", i, then)
        if i < len(symbols):
            go(4, "D", i + 1)
            if symbols[i] != "x":
                more = 3 * symbols[i].isupper()
                go(3 + more, "R", i + 1, then)
                if symbols[i].lower() == then or (symbols[i].lower() == "s" and state == ""):
                    go(more, "K", i + 1, symbols[i].lower())


def plain(rows, ids):
    out = []
    for conv in ids:
        some = [r for r in rows if r[0] == conv]
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in some:
            core = text.strip(WHITE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            name = role[:1] if role[:1] in "sua" and role else "o"
            symbols += "x" if fault in ("blank", "duplicate") else name.upper() if fault else name
        turns = [r[1] for r in some if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit = cheapest(symbols)
        fixed, at, last = [], 0, ""
        for e in audit:
            then = "a" if last == "u" else "u"
            full = {"a": "assistant", "u": "user"}[then]
            if e == "I":
                fixed.append(f"{full}:")
                last = then
                continue
            _, _, role, text = some[at]
            at += 1
            if e == "K":
                fixed.append(f"{role}:{text}")
                last = role[0]
            elif e == "R":
                fixed.append(f"{full}:{text}")
                last = then
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(map(repr, out))


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "a", "s x"]
    texts = ["Hi.", "Hi", "", " \n", "What?", "Yes!", None, "long word " * 3, "é.", "\x0b.\t"]
    return [(rng.choice([None, *range(n // 4)]), rng.choice([None, 0, 1, 2, 3, 4, 7, 9]), rng.choice(roles), rng.choice(texts))
            for _ in range(n)]


def test_automaton_equals_search():
    rng = random.Random(2)
    signatures = {"".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 9))) for _ in range(3000)} | {""}
    for s, cost, audit in C.solve(sorted(signatures, key=lambda x: x[::-1])):
        assert (cost, audit) == cheapest(s), s
    unsorted = list(signatures)[:300]
    assert [r[1:] for r in C.solve(unsorted)] == [cheapest(s) for s in unsorted]


def test_few_nodes_however_long_the_signatures():
    rng = random.Random(3)
    long = ["".join(rng.choice("suaoSUAOx") for _ in range(50_000)) for _ in range(2)]
    assert all(len(a) >= 50_000 and c > 0 for _, c, a in C.solve(sorted(long, key=lambda x: x[::-1])))
    assert C.node.cache_info().currsize < 1000


def test_query_equals_plain_version(spark, tmp_path):
    rows = random_rows(5, 120) + [(1000, i, "user" if i % 2 else "assistant", f"text {i}.") for i in range(400)]
    rows += rows[:9] + [(2000, None, None, None), (2001, 2**63 - 1, "user", "a."), (2001, -2**63, "assistant", "b.")]
    spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, audit int") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = plain(plain_damage(rows), {r[0] for r in rows})
    capped = [w.replace(str(2**64 - 2), str(2**63 - 1)) for w in want]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(capped)


def test_undamaged_conversations_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "You help."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (2, 5, "assistant", "cut of")]
    got = {r.id: r for r in C.repair_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].cost, got[1].audit, got[1].gaps) == (0, "KKK", 0) and (got[2].cost, got[2].audit) == (4, "D")
    empty = spark.createDataFrame([], schema)
    assert C.repair_conversations(empty).count() == 0 and C.repair_conversations(empty, ids=empty).count() == 0
