"""Keywords with spaces: against the joined text of the thread, whatever the borders; hot threads."""

import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import AS_OF, frame, msg
from threadlens.config import Params
from threadlens.operators import phrases as PH
from threadlens.operators import sequence as Q
from threadlens.operators import threads as T
from threadlens.plans.job import ThreadJob

P = Params(as_of=AS_OF, min_messages=1, keywords_urgent=("a b",), keywords_delay=("b a b", " a", "x y z w v"),
           keywords_transport=("loading dock", "b  b"), keywords_customs=("b ", "a"))


def expected(rows, p=P):
    threads = {}
    for r in sorted(rows, key=lambda r: (r["received_time"], r["message_id"])):
        threads.setdefault(r["conversation_id"], []).append(f"{r['subject'] or ''} {r['body'] or ''}")
    texts = {k: " ".join(v).lower() for k, v in threads.items()}
    return {k: tuple(any(kw in t for kw in getattr(p, n)) for n in PH.FLAGS.values()) for k, t in texts.items()}


def found(spark, rows, p=P):
    j = ThreadJob(frame(spark, rows), p)
    return {r.conversation_id: tuple(r[f] for f in PH.FLAGS) for r in j.meta.select("conversation_id", *PH.FLAGS).collect()}


def test_borders(spark):
    def thread(name, *texts):
        return [msg(len(name) * 1000 + i, name, AS_OF + timedelta(minutes=i), subject=s, body=b) for i, (s, b) in enumerate(texts)]
    rows = (thread("inside", ("x", "the Loading dock")) + thread("border1", ("main loading", "dock 3")) +
            thread("border22", ("x", "now loading"), ("Dock", "")) + thread("whole333", ("q", "x"), ("y", "z"), ("w", "v")) +
            thread("none4444", ("x", "loading"), ("", "dock")) + thread("null55555", (None, "loading"), ("dock", None)) +
            thread("gap666666", ("x", "loading"), ("", ""), ("dock", "")) + thread("one7777777", ("x", "loading")))
    got = found(spark, rows)
    assert got == expected(rows)
    assert got["border22"][2] and got["border1"][2] and got["whole333"][1] and not got["none4444"][2] and not got["gap666666"][2]


texts = st.text(alphabet="ab ", max_size=4)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from("pqr"), st.integers(0, 5), texts, texts), min_size=1, max_size=25))
def test_any_texts(spark, data):
    rows = [msg(i, c, AS_OF + timedelta(minutes=m), subject=s, body=b) for i, (c, m, s, b) in enumerate(data)]
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("small", [100, 10_000])
def test_hot_thread(spark, monkeypatch, small):
    monkeypatch.setattr(Q, "SMALL", small)
    rng = random.Random(1)
    rows = [msg(i, "hot" if i % 5 else f"c{i % 50}", AS_OF + timedelta(minutes=rng.randrange(900)), subject=f"n{i}", body="update")
            for i in range(2000)]
    rows += [msg(9001, "hot", AS_OF + timedelta(minutes=444, seconds=1), body="near the loading"),
             msg(9002, "hot", AS_OF + timedelta(minutes=444, seconds=2), subject="dock", body="x")]
    got = found(spark, rows, P.with_(keywords_customs=("never here",)))
    assert got["hot"] == (False, False, True, False) and sum(any(v) for v in got.values()) == 1


def test_words_alone_leave_the_plan_as_it_is(spark):
    plain = P.with_(keywords_urgent=("urgent",), keywords_delay=("late",), keywords_transport=("truck",), keywords_customs=("duty",))
    assert not PH.phrases(plain)
    j = ThreadJob(frame(spark, [msg(1, "c", AS_OF)]), plain)
    assert not set(PH.COLUMNS) & set(j.features.columns)
    with pytest.raises(ValueError):
        PH.with_phrase_flags(j.meta, j.features, P)


def test_message_flags_test_subject_and_body_by_themselves(spark):
    p = P.with_(keywords_urgent=("loading dock",))
    rows = [msg(1, "c", AS_OF, subject="loading", body="dock"), msg(2, "c", AS_OF + timedelta(hours=1), subject="the loading dock")]
    j = ThreadJob(frame(spark, rows), p)
    assert {r.message_id: r.is_urgent for r in j.features.collect()} == {1: False, 2: True} and j.meta.first().is_urgent


def test_places_are_not_broadcast(spark):
    """They grow with the messages, and as files they are many times smaller than in memory."""
    rows = [msg(i, f"t{i % 3}", AS_OF + timedelta(minutes=i), subject="x", body=("loading", "dock", "a b")[i % 3]) for i in range(30)]
    j = ThreadJob(frame(spark, rows), P)
    df = PH.with_phrase_flags(T.thread_metadata(j.features, P, 1), j.features, P)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
