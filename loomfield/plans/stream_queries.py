"""Streams of the events table run to their end, and what else needs more than one step: pauses, several stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators import graph, records
from loomfield.plans.page_queries import _edges
from loomfield.plans.registry import SQL, query
from loomfield.plans.views import table
from loomfield.session import STATE_STORE, ensure_checkpoint_dir
from loomfield.sources import readers, writers
from loomfield.streaming import state


def _place(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    """The events table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _run(df, place: str, mode: str = "append") -> str:
    """Runs a stateful stream to its end; returns its checkpoint.  Rows go to the parquet files of place/rows where
    they are only appended, else to nowhere, as the state tells."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
        q = w.format("parquet").start(f"{place}/rows") if mode == "append" else w.format("noop").start()
        q.awaitTermination()
        return f"{place}/checkpoint"
    finally:
        spark.conf.set(key, before)


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 429 ELSE 503 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
d(user_id, k, event_id, delay) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, 3.0::DOUBLE FROM a UNION ALL
SELECT a.user_id, a.k, a.event_id, CASE status WHEN 429 THEN least(60.0, delay * 2.0) WHEN 503 THEN least(60.0, delay * 1.5) ELSE greatest(1.0, delay * 0.95) END FROM d JOIN a ON a.user_id = d.user_id AND a.k = d.k + 1)
SELECT user_id, event_id, round(delay, 6) AS delay FROM d WHERE k > 0""")
def stream_delays(spark, sf_dir):
    """The adaptive delay after every event of a stream."""
    status = F.when(F.col("event_type") != "error", 200).when(F.pmod("event_id", F.lit(2)) == 0, 429).otherwise(503)
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), _seconds().alias("t"), status.alias("status"), F.lit(None).cast("double").alias("retry_after"))
    place = _place(spark)
    _run(state.adaptive_delays(rows), place)
    return spark.read.schema("key string, id long, delay double").parquet(f"{place}/rows").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), F.round("delay", 6).alias("delay"))


@query("""WITH RECURSIVE a AS (SELECT user_id, ['fetch', 'complete', 'fail'][event_id % 3 + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
q(user_id, k, state, executions) AS (SELECT DISTINCT user_id, 0::BIGINT, 'pending', 0 FROM a UNION ALL
SELECT a.user_id, a.k, CASE WHEN event = 'fetch' AND state = 'pending' THEN 'active' WHEN event = 'complete' AND state = 'active' THEN 'completed' WHEN event = 'fail' AND state = 'active' THEN CASE WHEN executions >= 3 THEN 'failed' ELSE 'pending' END ELSE state END,
  executions + CASE WHEN event = 'fetch' AND state = 'pending' THEN 1 ELSE 0 END FROM q JOIN a ON a.user_id = q.user_id AND a.k = q.k + 1)
SELECT user_id, state, executions FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def stream_queue_states(spark, sf_dir):
    """Queue items that events move on, read back from the state of the stream that has ended."""
    event = F.element_at(F.array(*[F.lit(x) for x in ("fetch", "complete", "fail")]), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), _seconds().alias("t"), event.alias("event"))
    checkpoint = _run(state.retry_queue(rows), _place(spark), "update")
    return state.read_state(spark, checkpoint).select(F.col("key").cast("long").alias("user_id"), "state", "executions")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_seen_once(spark, sf_dir):
    """Pairs of user and event type, each once."""
    place = _place(spark)
    _run(state.seen_once(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), place)
    return spark.read.schema("user_id long, event_type string").parquet(f"{place}/rows")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def stream_paused(spark, sf_dir):
    """A stream that is paused and resumed writes every row once."""
    place = _place(spark)
    rows = _events(spark, sf_dir).select("event_type", "event_id")
    q = state.PausableQuery(lambda: rows.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True))
    for _ in range(2):
        q.start().awaitTermination()
        q.pause()
    return spark.read.schema("event_type string, event_id long").parquet(f"{place}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, user_id FROM events")
def stream_new_items(spark, sf_dir):
    """A stream that is read twice from its beginning delivers what its snapshot lacks, so every event once."""
    place = _place(spark)
    deliver = lambda batch, _: batch.write.mode("append").parquet(f"{place}/delivered")
    sink = state.snapshot_sink(f"{place}/snapshots", "event_id", deliver)
    for i in range(2):
        rows = _events(spark, sf_dir).select("event_id", "user_id")
        # batches of the second run are numbered on, as those of a stream that goes on would be
        rows.writeStream.foreachBatch(lambda batch, n, i=i: sink(batch, 1000 * i + n)).option("checkpointLocation", f"{place}/checkpoint-{i}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{place}/delivered")


@query(SQL["crawl_first_pages"])
def crawl_paused(spark, sf_dir):
    """The crawl of crawl_first_pages, paused after every level."""
    edges, start, place = _edges(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")), _place(spark)
    ended = False
    while not ended:
        found, ended = graph.crawl_in_steps(edges, start, place, 3, 100, steps=1)
    return found


@query("SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/Sitemap.xml' AS url FROM pages")
def robots_sitemaps(spark, sf_dir):
    """Sitemaps that the hosts' robots files name, in any case of the field and with the urls' case."""
    host = F.concat(S.scheme(F.col("url")), F.lit("://"), S.netloc(F.col("url")), F.lit("/Sitemap.xml"))
    named = F.concat(F.when(F.pmod("page_id", F.lit(2)) == 0, "Sitemap: ").otherwise("  siteMAP:"), host)
    lines = table(spark, sf_dir, "pages").select(F.explode(F.array(F.lit("User-agent: *"), F.lit("Disallow: /sitemap:"), named)).alias("value"))
    return readers.robots_sitemaps(lines, "value")


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || split_part(trim(href), '#', 1) AS link, count(*) AS n FROM l GROUP BY ALL""")
def cleaned_links(spark, sf_dir):
    """Links of pages, absolute and without their fragments."""
    links = graph.page_links(table(spark, sf_dir, "pages"))
    return links.groupBy("page_id", S.clean_url(F.col("href"), F.col("url")).alias("link")).agg(F.count("*").alias("n"))


@query("SELECT store, s_suppkey, s_name FROM supplier, (SELECT unnest(['a', 'b']) AS store)")
def several_stores(spark, sf_dir):
    """The same rows in two stores, while a third one fails."""
    place = _place(spark)
    paths = {name: f"{place}/{name}" for name in "ab"}
    told = writers.write_everywhere(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), [*paths.values(), "nosuchstore://x/y"])
    if [told[p] for p in paths.values()] != [None, None] or not told["nosuchstore://x/y"]:
        raise RuntimeError(f"stores told {told}")
    one = lambda name: spark.read.parquet(paths[name]).select(F.lit(name).alias("store"), "s_suppkey", "s_name")
    return one("a").unionAll(one("b"))
