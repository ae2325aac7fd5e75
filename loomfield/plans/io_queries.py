"""Readers and writers by round trips through the folder that all executors share, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomfield.plans.registry import query
from loomfield.plans.views import table
from loomfield.session import ensure_checkpoint_dir
from loomfield.sources import documents, readers, writers
from loomfield.streaming import state


def _place(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/io-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey::INT AS c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    path = _place(spark)
    writers.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return readers.read_csv(spark, path, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE turn = 0")
def ndjson_round_trip(spark, sf_dir):
    """Texts with line breaks, and an appended part."""
    path, c = _place(spark), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    writers.write_ndjson(c, path)
    writers.write_ndjson(c.where("turn = 0"), path, append=True)
    return readers.read_ndjson(spark, path, "conv_id bigint, turn int, role string, text string", strict=True)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def json_array_round_trip(spark, sf_dir):
    """An array of all orders: written in parts by all tasks, read as parts."""
    path = _place(spark)
    writers.write_document(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path)
    return readers.read_document(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")[0]


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_array_file(spark, sf_dir):
    """The same as one file, for readers that know nothing of parts."""
    path = _place(spark)
    writers.write_json_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.read_json(spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def partitioned_parquet(spark, sf_dir):
    path = _place(spark)
    writers.write_parquet(table(spark, sf_dir, "events"), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT 'nation' AS sheet, n_nationkey::VARCHAR || ',' || n_name AS cells FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR || ',' || r_name FROM region UNION ALL SELECT 'kept', 'x,1'")
def workbook_round_trip(spark, sf_dir):
    """Two sheets added to a workbook, written as one file and read as an object."""
    parts = {"nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "region": table(spark, sf_dir, "region").select("r_regionkey", "r_name")}
    data = writers.workbook(parts, append_to=documents.make_xlsx({"kept": [["a", "b"], ["x", 1]]}))
    rows = documents.xlsx_rows(spark.createDataFrame([("w.xlsx", bytearray(data))], "path string, content binary"))
    return rows.where("row > 0").select("sheet", F.array_join("cells", ",").alias("cells"))


@query("SELECT 'csv' AS format, count(*) AS n FROM part UNION ALL SELECT 'json', count(*) FROM part UNION ALL SELECT 'ndjson', count(*) FROM part UNION ALL SELECT 'parquet', count(*) FROM part UNION ALL SELECT 'xlsx', count(*) FROM part")
def many_formats(spark, sf_dir):
    """One result in every format, each counted again."""
    paths = writers.write_all(table(spark, sf_dir, "part").select("p_partkey", "p_name"), _place(spark), ["csv", "json", "ndjson", "parquet", "xlsx"])
    objects = readers.read_objects(spark, paths["xlsx"])
    read = {
        "csv": readers.read_csv(spark, paths["csv"]), "json": readers.read_json(spark, paths["json"], "p_partkey bigint, p_name string"), "ndjson": readers.read_ndjson(spark, paths["ndjson"], "p_partkey bigint"),
        "parquet": spark.read.parquet(paths["parquet"]), "xlsx": documents.xlsx_rows(objects).where("row > 0"),
    }
    out = None
    for name, df in read.items():
        one = df.select(F.lit(name).alias("format")).groupBy("format").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY p_name")
def line_files(spark, sf_dir):
    path, p = _place(spark), table(spark, sf_dir, "part")
    p.select(F.concat(F.lit("  "), "p_name").alias("value")).unionAll(p.limit(3).select(F.lit("# comment"))).unionAll(p.limit(1).select(F.lit(" "))).write.text(path)
    return readers.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS key, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def sqlite_tables(spark, sf_dir):
    """SQLite files that tasks make of the customers, read by tasks."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    return documents.sqlite_rows(writers.sqlite_files(rows, "customers", 700), "SELECT key, name, balance FROM customers", "key bigint, name string, balance double").drop("path")


@query("SELECT s_suppkey::VARCHAR || ',' || s_name AS cells FROM supplier")
def workbook_parts(spark, sf_dir):
    """Workbooks that tasks make of the suppliers, read by tasks."""
    files = writers.workbook_files(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), rows=40)
    return documents.xlsx_rows(files).where("row > 0").select(F.array_join("cells", ",").alias("cells"))


def _sitemaps(spark, sf_dir):
    """A sitemap of one entry for each page."""
    xml = """concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), ' </loc><priority>0.', page_id % 10, '</priority><changefreq>', if(page_id % 2 = 0, 'daily', 'weekly'), '</changefreq><lastmod>2024-01-', lpad(page_id % 28 + 1, 2, '0'), '</lastmod></url></urlset>')"""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(xml).alias("xml"))


@query("SELECT page_id, url FROM pages WHERE page_id % 10 >= 5 AND page_id % 2 = 0 AND page_id % 28 >= 9")
def sitemap_filters(spark, sf_dir):
    rows = readers.sitemap_rows(_sitemaps(spark, sf_dir), "xml", ("page_id",))
    return readers.filter_sitemap(rows, 0.5, "daily", 20, F.lit("2024-01-30").cast("date")).select("page_id", "url")


@query("SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE contains(url, '/en/')) AND NOT regexp_matches(lower(url), '/tag/|/category/|/author/|/page/|\\.xml|\\.pdf|\\.jpg|\\.png')")
def pages_in_sitemaps(spark, sf_dir):
    """The pages that sitemaps list, each looked up by its url."""
    listed = _sitemaps(spark, sf_dir).where("contains(xml, '/en/')")
    return readers.sitemap_pages(table(spark, sf_dir, "pages").select("page_id", "url"), listed, "xml").select("page_id")


@query("SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    got = state.windowed_counts(table(spark, sf_dir, "events"), "user_id", "6 hours")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    got = state.sessions(table(spark, sf_dir, "events"), "user_id", "2 hours")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
