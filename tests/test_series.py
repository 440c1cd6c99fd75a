"""Series of a sender in chunks of bounded size."""

from datetime import timedelta

from conftest import AS_OF, frame, msg
from threadlens.config import Params
from threadlens.operators import outputs as OUT
from threadlens.operators import sequence as Q
from threadlens.plans.job import ThreadJob


def test_chunks_are_bounded_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 50)
    rows = [msg(i, "hot", AS_OF + timedelta(minutes=i // 3), sender="busy" if i % 10 else f"s{i % 3}") for i in range(400)]
    rows += [msg(1000 + i, "c", AS_OF + timedelta(minutes=i), sender=None) for i in range(3)]
    job = ThreadJob(frame(spark, rows).repartition(4), Params(as_of=AS_OF))
    got = OUT.sender_series_chunks(job.sequenced, 50).collect()
    assert all(1 <= len(r.y) <= 50 and len(r.y) == len(r.x) == len(r.hover_text) == len(r.text) for r in got)
    busy = sorted((r for r in got if r.sender == "busy"), key=lambda r: r.chunk)
    assert [r.chunk for r in busy] == list(range(len(busy))) and len(busy) == 8
    assert [y for r in busy for y in r.y] == [i for i in range(400) if i % 10]
    assert busy[0].text[0] == "Email 2" and {r.series_name for r in got} == {"busy", "s0", "s1", "s2", "Unknown"}
