"""Circuit breakers over logs of calls, as finite-state machines with a clock whose runs compose.

A breaker is closed with so many failures in a row, or open since some time.  What a run of calls makes of it is a
bounded summary: an outcome for each number of failures a closed breaker may come with, and for an open one a step
function of the time it opened at, whose steps with equal outcomes are one.  Two summaries in a row are a summary
again.  So calls are dealt by ranges of (key, time), each range gives one summary a key, and only a key's summaries
meet: a key with a third of all calls takes as many tasks as its calls fill, and none holds its history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.session import ensure_checkpoint_dir

THRESHOLD, RESET_S = 5, 60.0


class Outcome(NamedTuple):
    """A breaker after a run: open since ``opened`` or closed, and its failures, which count on from those before
    the run if ``more``."""

    open: bool
    failures: int
    opened: float
    more: bool = False


class Summary(NamedTuple):
    """closed[f]: the outcome for a breaker that comes closed with f failures.  steps: (until, outcome) by time; a
    breaker that opened at o has the first outcome whose until is o or later, and stays as it is without one."""

    closed: list[Outcome]
    steps: list[tuple[float, Outcome]]


def _added(o: Outcome, failures: int) -> Outcome:
    return Outcome(o.open, o.failures + failures, o.opened) if o.more else o


def _merged(steps: list[tuple[float, Outcome]]) -> list[tuple[float, Outcome]]:
    out: list[tuple[float, Outcome]] = []
    for until, o in steps:
        if out and out[-1][1] == o:
            out.pop()
        out.append((until, o))
    return out


def summarize(t: Sequence[float], ok: Sequence[bool], threshold: int, reset_s: float) -> Summary:
    """The summary of calls at ascending times, from the last call to the first."""
    n = len(t)
    trial = np.searchsorted(np.asarray(t), np.asarray(t) + reset_s, "left")
    closed = [Outcome(False, f, 0.0) for f in range(threshold)]
    fresh = [None] * n + [closed[0]]  # closed without failures before call i
    opened: list[Outcome] = [None] * n  # opened by call i, failures from there
    tried: list[Outcome] = [None] * n  # let through on trial at call i
    for i in range(n - 1, -1, -1):
        j = int(trial[i])
        opened[i] = tried[j] if j < n else Outcome(True, 0, t[i], True)
        if ok[i]:
            tried[i] = fresh[i + 1]
            closed = [closed[0]] * threshold
        else:
            tried[i] = opened[i]._replace(failures=opened[i].failures + 1) if opened[i].more else opened[i]
            closed = [*closed[1:], _added(opened[i], threshold)]
        fresh[i] = closed[0]
    return Summary(closed, _merged([(t[i] - reset_s, tried[i]) for i in range(n)]))


def _after(s: Summary, o: Outcome) -> Outcome:
    if not o.open:
        return s.closed[o.failures]
    for until, then in s.steps:
        if until >= o.opened:
            return Outcome(then.open, o.failures + then.failures, then.opened, o.more) if then.more else then
    return o


def compose(first: Summary, second: Summary) -> Summary:
    """The summary of both runs in a row; a breaker that no call of the first run is late enough for meets the
    second as it came."""
    last = first.steps[-1][0] if first.steps else -np.inf
    steps = [(until, _after(second, o)) for until, o in first.steps] + [(u, o) for u, o in second.steps if u > last]
    return Summary([_after(second, o) for o in first.closed], _merged(steps))


_OUTCOME = "struct<open: boolean, failures: long, opened: double, more: boolean>"
_ARROW = pa.struct([("open", pa.bool_()), ("failures", pa.int64()), ("opened", pa.float64()), ("more", pa.bool_())])
_STEP = pa.struct([("until", pa.float64()), ("then", _ARROW)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, object, int, int]]:
    """(batch, key, begin, end) of runs of equal keys."""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key"))
        values, begin = keys.to_pylist(), 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[begin]:
                yield batch, values[begin], begin, i
                begin = i


def _summaries(threshold: int, reset_s: float):
    def run(batches):
        key, held, at, found, kind = None, None, 0, [], None

        def batch_of(rows):
            dicts = lambda o: o._asdict()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([[dicts(o) for o in r[2].closed] for r in rows], pa.list_(_ARROW)),
                    pa.array([[{"until": u, "then": dicts(o)} for u, o in r[2].steps] for r in rows], pa.list_(_STEP)),
                ],
                ["key", "range", "closed", "steps"],
            )

        for batch, k, a, b in _runs(batches):
            kind = kind or batch.schema.field("key").type
            column = lambda name: batch.column(batch.schema.get_field_index(name))[a:b].to_pylist()
            s = summarize(column("t"), column("ok"), threshold, reset_s)
            if held and k == key:
                held = compose(held, s)
                continue
            if held:
                found.append((key, at, held))
                if len(found) >= 1000:
                    yield batch_of(found)
                    found = []
            key, held, at = k, s, column("range")[0]
        if held:
            yield batch_of([*found, (key, at, held)])

    return run


def _next(state: Column, s: Column) -> Column:
    """_after() as an expression; state and outcomes are structs."""
    hit = F.element_at(F.filter(s["steps"], lambda p: p["until"] >= state["opened"]), 1)["then"]
    counted = F.struct(hit["open"].alias("open"), (hit["failures"] + F.when(hit["more"], state["failures"]).otherwise(0)).alias("failures"), hit["opened"].alias("opened"))
    resting = F.element_at(s["closed"], F.greatest(state["failures"], F.lit(0)).cast("int") + 1)
    resting = F.struct(resting["open"].alias("open"), resting["failures"].alias("failures"), resting["opened"].alias("opened"))
    return F.when(~state["open"], resting).when(hit.isNull(), state).otherwise(counted)


class Breakers:
    """Breakers of the calls (key, t in seconds, id, ok); see final() and history().

    Calls of a key are taken by t, then id.  Calls without key, t or ok tell nothing and are left out; repeated rows
    are calls of their own."""

    def __init__(self, calls: DataFrame, threshold: int = THRESHOLD, reset_s: float = RESET_S):
        self.threshold, self.reset_s = threshold, float(reset_s)
        ensure_checkpoint_dir(calls.sparkSession)
        rows = calls.select("key", F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id"), F.col("ok").cast("boolean").alias("ok"))
        rows = rows.where("key IS NOT NULL AND t IS NOT NULL AND ok IS NOT NULL")
        order = [F.col("key"), F.col("t"), F.col("id")]
        self.dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id().cast("long")).checkpoint()
        kind = dict(self.dealt.dtypes)["key"]
        schema = f"key {kind}, range long, closed array<{_OUTCOME}>, steps array<struct<until: double, then: {_OUTCOME}>>"
        parts = self.dealt.mapInArrow(_summaries(threshold, self.reset_s), schema)
        start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("failures"), F.lit(0.0).alias("opened"))
        ordered = F.array_sort(F.collect_list(F.struct("range", "closed", "steps")))
        folded = parts.groupBy("key").agg(ordered.alias("parts"))
        states = F.aggregate("parts", F.array(start), lambda acc, s: F.concat(acc, F.array(_next(F.element_at(acc, -1), s))))
        self.keys = folded.select("key", F.transform("parts", lambda p: p["range"]).alias("ranges"), states.alias("states")).checkpoint()

    def final(self, as_of: float | None = None) -> DataFrame:
        """(key, state, failures, opened) after the last call; an open breaker that by ``as_of`` has been open for
        reset_s is half_open, though no call came."""
        last = F.element_at("states", -1)
        cooled = F.lit(False) if as_of is None else last["opened"] + self.reset_s <= as_of
        state = F.when(~last["open"], "closed").when(cooled, "half_open").otherwise("open")
        return self.keys.select("key", state.alias("state"), last["failures"].alias("failures"), last["opened"].alias("opened"))

    def history(self, as_of: float | None = None) -> DataFrame:
        """(key, t, id, state, failures, passed) after every call, passed telling whether it was let through; and
        with a null id and passed, at the time it happens, every change from open to half_open by the clock."""
        threshold, reset_s = self.threshold, self.reset_s
        starts = self.keys.where(F.size("ranges") > 1).select("key", F.explode(F.arrays_zip("ranges", F.slice("states", 1, F.size("ranges")).alias("was"))).alias("z"))
        # two rows a range at most: a range's first and last key alone can go on in another one
        starts = starts.select("key", F.col("z.ranges").alias("range"), F.col("z.was").alias("was"))
        rows = self.dealt.join(F.broadcast(starts), ["key", "range"], "left").select("key", "t", "id", "ok", "was")

        def run(batches):
            key, is_open, failures, opened = None, False, 0, 0.0
            for batch, k, a, b in _runs(batches):
                column = lambda name: batch.column(batch.schema.get_field_index(name))[a:b].to_pylist()
                if k != key:
                    was = column("was")[0]
                    key, is_open, failures, opened = k, was["open"] if was else False, was["failures"] if was else 0, was["opened"] if was else 0.0
                out = []
                for t, i, ok in zip(column("t"), column("id"), column("ok")):
                    half = is_open and t >= opened + reset_s
                    if half:
                        out.append((opened + reset_s, None, "half_open", failures, None))
                    passed = half or not is_open
                    if passed:
                        failures = 0 if ok else failures + 1
                        is_open = not ok and (half or failures >= threshold)
                        opened = t if is_open else opened
                    out.append((t, i, "open" if is_open else "closed", failures, passed))
                kinds = (pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                arrays = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), batch.schema.field("key").type), *arrays], ["key", "t", "id", "state", "failures", "passed"])

        schema = f"key {dict(self.dealt.dtypes)['key']}, t double, id long, state string, failures long, passed boolean"
        got = rows.mapInArrow(run, schema)
        if as_of is None:
            return got
        last = self.final(as_of).where("state = 'half_open'")
        return got.unionAll(last.select("key", F.col("opened") + reset_s, F.lit(None).cast("long"), "state", "failures", F.lit(None).cast("boolean")))
