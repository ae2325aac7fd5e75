import random

from pyspark.sql import functions as F

from loomfield.streaming import state as S


def stream(spark, tmp_path, rows, schema, batches=3):
    """rows as a file stream of several batches."""
    src = str(tmp_path / "src")
    step = -(-len(rows) // batches)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_delay_cases():
    d = [3.0]
    for status in (429, 200, 500):
        d.append(S.next_delay(d[-1], status, None, S.GLOBAL_DELAY))
    assert [round(x, 9) for x in d] == [3.0, 6.0, 5.7, 8.55]
    assert S.next_delay(3, 429, 100, S.GLOBAL_DELAY) == 60 and S.next_delay(3, 429, 100, S.DOMAIN_DELAY) == 150
    assert S.next_delay(1.0, 200, None, S.GLOBAL_DELAY) == 1.0 and S.next_delay(0.5, 200, None, S.DOMAIN_DELAY) == 0.5


def test_breaker_and_queue_cases():
    b = S.Breaker()
    for t in range(5):
        b, passed = S.next_breaker(b, t, False)
    assert b.state == "open" and passed and not S.next_breaker(b, 10, True)[1]
    b, passed = S.next_breaker(b, 64, True)
    assert passed and b.state == "closed" and b.failures == 0
    s = ("pending", 0)
    for e in ["fetch", "fail"] * 3 + ["fetch"]:
        s = S.next_queue_item(*s, e, 3)
    assert s == ("failed", 3) and S.next_queue_item("completed", 1, "fetch", 3) == ("completed", 1)


def test_stream_delays_equal_the_fold(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"k{rnd.randint(0, 3)}", i, float(i), rnd.choice([200, 200, 429, 503]), rnd.choice([None, None, 7.0])) for i in range(60)]
    want, held = {}, {}
    for k, i, _, st, ra in rows:
        held[k] = want[i] = S.next_delay(held.get(k, 3.0), st, ra, S.GLOBAL_DELAY)
    got = run(S.adaptive_delays(stream(spark, tmp_path, rows, "key string, id long, t double, status int, retry_after double")), tmp_path, "delays")
    assert {r.id: r.delay for r in got} == want


def test_stream_breakers_equal_the_fold(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randint(0, 1)}", i, float(i * 5), rnd.random() < 0.4) for i in range(60)]
    want, held = {}, {}
    for k, i, t, ok in rows:
        held[k], passed = S.next_breaker(held.get(k, S.Breaker()), t, ok, 2, 30)
        want[i] = (held[k].state, passed)
    got = run(S.circuit_breakers(stream(spark, tmp_path, rows, "key string, id long, t double, ok boolean"), 2, 30), tmp_path, "breakers")
    assert {r.id: (r.state, r.passed) for r in got} == want


def test_windows_and_seen_once(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00") for m in (0, 1, 2, 2, 30, 31)] + [("b", "2024-01-01 05:00:00")]
    src = stream(spark, tmp_path, rows, "key string, s string", 1).withColumn("ts", F.to_timestamp_ntz("s"))
    got = run(S.windowed_counts(src, "key", "10 minutes"), tmp_path, "tumbling", "complete")
    assert sorted((r.key, r.n) for r in got) == [("a", 2), ("a", 4), ("b", 1)]
    assert len(run(S.seen_once(src.select("key", "ts"), ["key"]), tmp_path, "once")) == 2
    assert [r.n for r in run(S.over_limit(src, "key", 3, "10 minutes", "10 minutes"), tmp_path, "limit", "complete")] == [4]


def test_snapshot_sink(spark, tmp_path):
    seen = []
    sink = S.snapshot_sink(str(tmp_path / "snap"), "k", lambda df, i: seen.append((i, sorted(r.k for r in df.collect()))))
    one, two = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    sink(one, 2)
    assert seen == [(0, [1, 2]), (1, [3]), (1, [3]), (2, [1])]


def test_paused_queries_go_on(spark, tmp_path):
    src = stream(spark, tmp_path, [(i,) for i in range(9)], "id long")
    out = str(tmp_path / "out")
    q = S.PausableQuery(lambda: src.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    assert q.status == "stopped"
    q.start().awaitTermination(120)
    assert q.status == "complete"
    q.pause()
    spark.createDataFrame([(100,)], "id long").write.mode("append").parquet(str(tmp_path / "src"))
    q.resume().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(9), 100]


def test_breakers_by_clock_equal_the_history_of_events(spark, tmp_path):
    """The stream of the events table gives the batch operator's rows, changes without a call among them."""
    from loomfield.operators.breaker import Breakers

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    held = rows.orderBy("ts", "id").collect()
    end = held[-1].ts.timestamp()
    schema = "key long, id long, ts timestamp, ok boolean"
    df = stream(spark, tmp_path, [tuple(r) for r in held] + [(-1, 10**9, held[-1].ts.replace(year=2030), True), (-1, None, held[-1].ts, True)], schema, 4)
    got = run(S.circuit_breakers_by_clock(df, 2, 3600.0), tmp_path, "clocked")
    calls = rows.select("key", F.unix_micros("ts").alias("us"), "id", "ok").select("key", (F.col("us") / 1e6).alias("t"), "id", "ok")
    want = Breakers(calls, 2, 3600.0).history(end + 10 * 3600).collect()
    plain = lambda rows: sorted(((r.key, round(r.t, 3), r.id, r.state, r.failures, r.passed) for r in rows if r.key != -1), key=repr)
    assert plain(got) == plain(want)
    assert sum(r.state == "half_open" for r in got) > len({r.key for r in got}) / 2


def test_state_of_a_stopped_stream_is_a_table(spark, tmp_path):
    """Every key's state after each batch equals the fold of what came by then; results are kept beside it."""
    rnd = random.Random(8)
    rows = [(f"k{rnd.randint(0, 6)}", i, float(i), rnd.choice(["fetch", "complete", "fail"]), rnd.choice([None, "ok", "bad"])) for i in range(90)]
    src = stream(spark, tmp_path, rows, "key string, id long, t double, event string, result string")
    run(S.retry_queue_results(src), tmp_path, "results", "update")
    place = str(tmp_path / "cp-results")

    def fold(part):
        held, results = {}, {}
        for k, _, t, e, r in part:
            before = held.get(k, ("pending", 0))
            held[k] = S.next_queue_item(*before, e, 3)
            if before[0] == "active" and e in ("complete", "fail"):
                results[k] = (e, r, t)
        return held, results

    for batch, n in ((1, 60), (None, 90)):
        held, results = fold(rows[:n])
        assert {r.key: (r.state, r.executions) for r in S.read_state(spark, place, batch=batch).collect()} == held
        assert {r.key: (r.event, r.result, r.t) for r in S.read_state(spark, place, "result", batch).collect()} == results


def test_breaker_state_read_back_equals_the_batch_fold(spark, tmp_path):
    from loomfield.operators.breaker import Breakers

    rnd = random.Random(4)
    rows = [(f"k{rnd.randint(0, 4)}", i, float(i * 5), rnd.random() < 0.5) for i in range(80)]
    schema = "key string, id long, t double, ok boolean"
    run(S.circuit_breakers(stream(spark, tmp_path, rows, schema), 2, 30), tmp_path, "readback")
    got = {r.key: (r.state, r.failures) for r in S.read_state(spark, str(tmp_path / "cp-readback")).collect()}
    assert got == {r.key: (r.state, r.failures) for r in Breakers(spark.createDataFrame(rows, schema), 2, 30).final().collect()}


def test_results_are_forgotten_after_their_time(spark, tmp_path):
    rows = [("a", 1, 1.0, "fetch", None), ("a", 2, 2.0, "complete", "done")]
    src = stream(spark, tmp_path, rows, "key string, id long, t double, event string, result string", 1)
    df = S.retry_queue_results(src, keep_ms=3_600_000)
    q = df.writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "cp-kept")).start()
    for _ in range(60):  # a stream with times of its own goes on without data
        if q.awaitTermination(1) or spark.table("kept").count() and q.lastProgress:
            break
    q.stop()
    assert {r.result for r in spark.table("kept").collect()} == {"done"}
    kept = S.read_state(spark, str(tmp_path / "cp-kept"), "result").collect()
    assert [(r.key, r.result) for r in kept] == [("a", "done")]
