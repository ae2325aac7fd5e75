import random

import pytest

from loomfield.operators import breaker as B
from loomfield.streaming import state as S


def plain(rows, threshold, reset_s, as_of=None):
    """The state machine call by call: history and last states."""
    out, held = [], {}
    for k, t, i, ok in sorted(rows):
        b = held.get(k, S.Breaker())
        if b.state == "open" and t >= b.opened + reset_s:
            out.append((k, b.opened + reset_s, None, "half_open", b.failures, None))
        held[k], passed = S.next_breaker(b, t, ok, threshold, reset_s)
        out.append((k, t, i, held[k].state, held[k].failures, passed))
    for k, b in held.items():
        if as_of is not None and b.state == "open" and b.opened + reset_s <= as_of:
            out.append((k, b.opened + reset_s, None, "half_open", b.failures, None))
            held[k] = S.Breaker("half_open", b.failures, b.opened)
    return sorted(out, key=repr), {k: (b.state, b.failures) for k, b in held.items()}


@pytest.mark.parametrize("seed", range(6))
def test_summaries_compose_to_the_plain_fold(seed):
    rnd = random.Random(seed)
    threshold, reset = rnd.choice([1, 2, 3, 5]), rnd.choice([1.0, 4.0, 20.0])
    t, ok, now = [], [], 0.0
    for _ in range(120):
        now += rnd.choice([0, 0.5, 1, 3])
        t.append(now), ok.append(rnd.random() < 0.5)
    b = S.Breaker()
    whole = None
    edges = sorted(rnd.sample(range(1, 120), 7))
    for lo, hi in zip([0, *edges], [*edges, 120]):
        piece = B.summarize(t[lo:hi], ok[lo:hi], threshold, reset)
        whole = piece if whole is None else B.compose(whole, piece)
        for i in range(lo, hi):
            b, _ = S.next_breaker(b, t[i], ok[i], threshold, reset)
        got = whole.closed[0]
        assert ("open" if got.open else "closed", got.failures, got.opened if got.open else None) == (b.state, b.failures, b.opened if b.state == "open" else None)
    one = B.summarize(t, ok, threshold, reset)
    assert one.closed == whole.closed
    for o in [-50, *t[::5], 10**6]:  # open since any time, with some failures
        b = S.Breaker("open", 7, o)
        for x, y in zip(t, ok):
            b, _ = S.next_breaker(b, x, y, threshold, reset)
        got = B._after(whole, B.Outcome(True, 7, o))
        assert (got.open, got.failures) == (b.state == "open", b.failures)
    assert len(one.steps) < 120


def calls(seed, n=900):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 30)}", float(rnd.randint(0, 400)), i, rnd.random() < 0.55) for i in range(n)]
    return rows + rows[:3]


def test_breakers_over_many_ranges(spark):
    rows = calls(1)
    df = spark.createDataFrame([*rows, (None, 1.0, 1, True), ("k1", None, 1, True), ("k1", 1.0, 1, None)], "key string, t double, id long, ok boolean").selectExpr("*", "1 as range", "'x' as was")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        b = B.Breakers(df, 3, 10)
        assert b.keys.where("size(ranges) > 4").count() == 1  # the hot key is split
        want, last = plain(rows, 3, 10, 405.0)
        assert {r.key: (r.state, r.failures) for r in b.final(405.0).collect()} == last
        assert sorted(map(tuple, b.history(405.0).collect()), key=repr) == want
        assert sorted(map(tuple, b.history().collect()), key=repr) == plain(rows, 3, 10)[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_calls(spark):
    b = B.Breakers(spark.createDataFrame([], "key string, t double, id long, ok boolean"))
    assert b.final(1.0).collect() == [] and b.history(1.0).collect() == []
