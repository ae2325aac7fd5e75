"""Stateful streams: adaptive delays, circuit breakers, retry queues, sliding limits, seen-sets, snapshots.

Each state machine is one plain function, shared by a keyed processor and by tests that fold it over a
list.  State is per key and of fixed size; the session should use the RocksDB store (session.create()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomfield.operators.records import new_items

# ---- state machines


@dataclass(frozen=True)
class DelayRules:
    """Start, floor and cap in seconds; success multiplies by down, 429 by limited, 5xx by failed; a
    retry-after hint counts retry_scale times and, if uncapped, may pass the cap."""

    start: float = 3.0
    floor: float = 1.0
    cap: float = 60.0
    down: float = 0.95
    limited: float = 2.0
    failed: float = 1.5
    retry_scale: float = 1.0
    capped_hint: bool = True


GLOBAL_DELAY = DelayRules()
DOMAIN_DELAY = DelayRules(start=2.0, floor=0.5, down=0.9, retry_scale=1.5, capped_hint=False)


def next_delay(delay: float, status: int, retry_after: float | None, rules: DelayRules) -> float:
    if status == 429:
        if retry_after is not None:
            hint = retry_after * rules.retry_scale
            return min(rules.cap, hint) if rules.capped_hint else hint
        return min(rules.cap, delay * rules.limited)
    if status >= 500:
        return min(rules.cap, delay * rules.failed)
    return max(rules.floor, delay * rules.down)


@dataclass(frozen=True)
class Breaker:
    state: str = "closed"
    failures: int = 0
    opened: float = 0.0


def next_breaker(b: Breaker, t: float, ok: bool, threshold: int = 5, reset_s: float = 60) -> tuple[Breaker, bool]:
    """The new state and whether the call was let through."""
    state = "half_open" if b.state == "open" and t - b.opened >= reset_s else b.state
    if state == "open":
        return b, False
    if ok:
        return Breaker("closed", 0, b.opened), True
    failures = b.failures + 1
    if state == "half_open" or failures >= threshold:
        return Breaker("open", failures, t), True
    return Breaker(state, failures, b.opened), True


def next_queue_item(state: str, executions: int, event: str, max_executions: int) -> tuple[str, int]:
    """pending -> active -> completed, or back to pending until max_executions, then failed; events that don't
    fit the state change nothing."""
    if event == "fetch" and state == "pending":
        return "active", executions + 1
    if event == "complete" and state == "active":
        return "completed", executions
    if event == "fail" and state == "active":
        return ("failed" if executions >= max_executions else "pending"), executions
    return state, executions


# ---- keyed processors


class _Keyed(StatefulProcessor):
    """A processor with one state row per key; events of a batch are taken in order of their time, then id."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema)

    def close(self) -> None:
        pass

    def _events(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["t", "id"])


class DelayProcessor(_Keyed):
    schema = "delay double"

    def __init__(self, rules: DelayRules = GLOBAL_DELAY):
        self.rules = rules

    def handleInputRows(self, key, rows, timerValues):
        delay = self.held.get()[0] if self.held.exists() else self.rules.start
        out = []
        for e in self._events(rows).itertuples():
            delay = next_delay(delay, int(e.status), None if pd.isna(e.retry_after) else float(e.retry_after), self.rules)
            out.append((key[0], int(e.id), delay))
        self.held.update((delay,))
        yield pd.DataFrame(out, columns=["key", "id", "delay"])


class BreakerProcessor(_Keyed):
    schema = "state string, failures int, opened double"

    def __init__(self, threshold: int = 5, reset_s: float = 60):
        self.threshold, self.reset_s = threshold, reset_s

    def handleInputRows(self, key, rows, timerValues):
        b = Breaker(*self.held.get()) if self.held.exists() else Breaker()
        out = []
        for e in self._events(rows).itertuples():
            b, passed = next_breaker(b, float(e.t), bool(e.ok), self.threshold, self.reset_s)
            out.append((key[0], int(e.id), b.state, b.failures, passed))
        self.held.update((b.state, b.failures, b.opened))
        yield pd.DataFrame(out, columns=["key", "id", "state", "failures", "passed"])


class ClockedBreakerProcessor(StatefulProcessor):
    """A breaker whose change from open to half_open comes by an event-time timer, whether or not a call does.  A
    closed breaker without failures has no state, so only keys in trouble are held."""

    def __init__(self, threshold: int = 5, reset_s: float = 60):
        self.threshold, self.reset_s = threshold, reset_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", BreakerProcessor.schema)

    def close(self) -> None:
        pass

    def _due(self, b: Breaker) -> int:
        return round((b.opened + self.reset_s) * 1000)

    def _keep(self, before: Breaker, after: Breaker) -> None:
        if before.state == "open" and (after.state != "open" or after.opened != before.opened):
            self.handle.deleteTimer(self._due(before))
        if after.state == "open" and (before.state != "open" or after.opened != before.opened):
            self.handle.registerTimer(self._due(after))
        if after.state == "closed" and not after.failures:
            self.held.clear()
        else:
            self.held.update((after.state, after.failures, after.opened))

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "t", "id", "state", "failures", "passed"])
        return out.astype({"id": "Int64", "passed": "boolean"})

    def handleInputRows(self, key, rows, timerValues):
        start = b = Breaker(*self.held.get()) if self.held.exists() else Breaker()
        out = []
        events = pd.concat(list(rows))
        events["t"] = (events.ts - pd.Timestamp(0)) / pd.Timedelta(seconds=1)
        for e in events.sort_values(["t", "id"]).itertuples():
            if b.state == "open" and e.t >= b.opened + self.reset_s:
                out.append((key[0], b.opened + self.reset_s, None, "half_open", b.failures, None))
            b, passed = next_breaker(b, float(e.t), bool(e.ok), self.threshold, self.reset_s)
            out.append((key[0], float(e.t), int(e.id), b.state, b.failures, passed))
        self._keep(start, b)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        b = Breaker(*self.held.get()) if self.held.exists() else Breaker()
        if b.state != "open" or self._due(b) != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.held.update(("half_open", b.failures, b.opened))
        yield self._table([(key[0], b.opened + self.reset_s, None, "half_open", b.failures, None)])


class QueueProcessor(_Keyed):
    schema = "state string, executions int"

    def __init__(self, max_executions: int = 3):
        self.most = max_executions

    def handleInputRows(self, key, rows, timerValues):
        state, n = self.held.get() if self.held.exists() else ("pending", 0)
        for e in self._events(rows).itertuples():
            state, n = next_queue_item(state, n, e.event, self.most)
        self.held.update((state, n))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "executions": [n]})


class ResultQueueProcessor(QueueProcessor):
    """A queue item with the result of its last finished or failed execution, kept for a time after it was written."""

    def __init__(self, max_executions: int = 3, keep_ms: int | None = None):
        super().__init__(max_executions)
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.result = handle.getValueState("result", "event string, result string, t double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        state, n = self.held.get() if self.held.exists() else ("pending", 0)
        last = None
        for e in self._events(rows).itertuples():
            before = state
            state, n = next_queue_item(state, n, e.event, self.most)
            if before == "active" and e.event in ("complete", "fail"):
                last = (e.event, None if pd.isna(e.result) else e.result, float(e.t))
        self.held.update((state, n))
        if last:
            self.result.update(last)
        kept = self.result.get() if self.result.exists() else (None, None, None)
        yield pd.DataFrame({"key": [key[0]], "state": [state], "executions": [n], "result": [kept[1]]})


def adaptive_delays(events: DataFrame, rules: DelayRules = GLOBAL_DELAY) -> DataFrame:
    """events: key, id, t, status, retry_after.  (key, id, delay) after each event."""
    return events.groupBy("key").transformWithStateInPandas(DelayProcessor(rules), "key string, id long, delay double", "Append", "None")


def circuit_breakers(events: DataFrame, threshold: int = 5, reset_s: float = 60) -> DataFrame:
    """events: key, id, t, ok."""
    return events.groupBy("key").transformWithStateInPandas(BreakerProcessor(threshold, reset_s), "key string, id long, state string, failures int, passed boolean", "Append", "None")


def circuit_breakers_by_clock(events: DataFrame, threshold: int = 5, reset_s: float = 60, late: str = "1 minute") -> DataFrame:
    """events: key, id, ts, ok; rows where one is null are left out, as are those later than ``late``.

    (key, t, id, state, failures, passed) after each call, and with null id and passed each change from open to
    half_open at the time it happens, as soon as the watermark is past it.  The rows are those of
    operators.breaker's history() up to the watermark, where calls come in order of their times."""
    rows = timed(events).select("key", "id", "ts", "ok").dropna().withWatermark("ts", late)
    schema = f"key {dict(events.dtypes)['key']}, t double, id long, state string, failures int, passed boolean"
    return rows.groupBy("key").transformWithStateInPandas(ClockedBreakerProcessor(threshold, reset_s), schema, "Append", "EventTime")


def retry_queue(events: DataFrame, max_executions: int = 3) -> DataFrame:
    """events: key, id, t, event.  Each key's state after a batch, in update mode."""
    return events.groupBy("key").transformWithStateInPandas(QueueProcessor(max_executions), "key string, state string, executions int", "Update", "None")


def retry_queue_results(events: DataFrame, max_executions: int = 3, keep_ms: int | None = None) -> DataFrame:
    """events: key, id, t, event, result.  (key, state, executions, result) after a batch, in update mode: the result
    of the item's last execution, which is forgotten ``keep_ms`` after it came, if that is given."""
    schema = f"key {dict(events.dtypes)['key']}, state string, executions int, result string"
    return events.groupBy("key").transformWithStateInPandas(ResultQueueProcessor(max_executions, keep_ms), schema, "Update", "None" if keep_ms is None else "ProcessingTime")


# ---- reading state back


def read_state(spark: SparkSession, checkpoint: str, variable: str = "held", batch: int | None = None) -> DataFrame:
    """(key, fields of the variable) of every key that a stopped or running stream of this module holds, as it was
    after ``batch``, the last finished one if None.  Spark reads the state store's files where they are."""
    r = spark.read.format("statestore").option("stateVarName", variable)
    rows = (r if batch is None else r.option("batchId", batch)).load(checkpoint)
    value = rows.schema["value"].dataType
    fields = value.names if "value" not in value.names else [f"value.{n}" for n in value["value"].dataType.names]
    return rows.select(F.col(f"key.{rows.schema['key'].dataType.names[0]}").alias("key"), *[F.col(f"value.{n}").alias(n.rpartition(".")[2]) for n in fields])


# ---- event time


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as instants, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts per key; events later than ``late`` are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def over_limit(events: DataFrame, key: str, limit: int, length: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Keys and sliding windows with more than ``limit`` events."""
    return windowed_counts(events, key, length, slide, late).where(F.col("n") > limit)


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def seen_once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, its state kept as long as late events may come."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


# ---- pausing


class PausableQuery:
    """A streaming query that can be stopped and started again: its checkpoint holds what was done, so that it goes
    on behind the last finished batch.  ``writer`` gives a DataStreamWriter that names its checkpointLocation."""

    def __init__(self, writer: Callable[[], object]):
        self._writer, self._query = writer, None

    @property
    def status(self) -> str:
        if self._query is None:
            return "stopped"
        return "running" if self._query.isActive else "complete"

    def start(self):
        if self.status != "running":
            self._query = self._writer().start()
        return self._query

    resume = start

    def pause(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None


# ---- batches


def snapshot_sink(path: str, key: str, deliver: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: passes on the rows whose key the snapshot lacks, then keeps the batch as the
    new snapshot.  Snapshots are numbered by batch, so that a batch which runs again compares with the same
    one as before."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        try:
            before = _latest(spark, path, batch_id)
            deliver(held if before is None else new_items(held, spark.read.schema(held.schema).parquet(before), key), batch_id)
            held.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        finally:
            held.unpersist()

    return run


def _latest(spark, path: str, batch_id: int) -> str | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    old = [n for n in names if n.startswith("batch=") and int(n[6:]) < batch_id]
    return f"{path}/{max(old)}" if old else None
