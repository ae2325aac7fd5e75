"""Tables of the engine's domain laid over the driver's tables, for queries and, as CTEs, for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(k) for k in ("bot_detected", "cloudflare", "rate_limited", "captcha", "js_required")])
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"), F.element_at(kinds, (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")).alias("problem_type"),
        F.replace("p_name", F.lit(" "), F.lit(",")).alias("tags"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(","), F.lower("p_brand")).alias("error_keywords"),
        (F.col("p_size") / 50.0).alias("confidence"), (F.pmod("p_partkey", F.lit(100)) / 100.0).alias("success_rate"), F.pmod("p_partkey", F.lit(7)).cast("int").alias("use_count"),
        F.when(F.pmod("p_partkey", F.lit(11)) == 0, "*example.com").alias("site_pattern"),
    )


SKILLS = """skills AS (SELECT p_partkey AS id, p_name AS name, lower(p_type) AS category,
  ['bot_detected', 'cloudflare', 'rate_limited', 'captcha', 'js_required'][(p_partkey % 5 + 1)::INT] AS problem_type, replace(p_name, ' ', ',') AS tags,
  split_part(p_name, ' ', 2) || ',' || lower(p_brand) AS error_keywords, p_size / 50.0::DOUBLE AS confidence, (p_partkey % 100) / 100.0::DOUBLE AS success_rate,
  (p_partkey % 7)::INT AS use_count, CASE WHEN p_partkey % 11 = 0 THEN '*example.com' END AS site_pattern FROM part)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    methods = F.array(*[F.lit(k) for k in ("http", "browser", "proxy", "api")])
    return e.select(
        F.col("event_id").alias("attempt_id"), "ts", F.col("user_id").alias("domain"), F.element_at(methods, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("method"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") != "error", F.floor("value").cast("int")).otherwise(0).alias("items"), F.col("value").alias("time_taken"),
    )


ATTEMPTS = """attempts AS (SELECT event_id AS attempt_id, ts, user_id AS domain, ['http', 'browser', 'proxy', 'api'][(event_id % 4 + 1)::INT] AS method,
  event_type <> 'error' AS success, CASE WHEN event_type <> 'error' THEN floor(value)::INT ELSE 0 END AS items, value AS time_taken FROM events)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("https://shop.example.com/"), F.pmod("o_custkey", F.lit(500)).cast("string")).alias("url"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), state.alias("state"), F.pmod("o_orderkey", F.lit(4)).cast("int").alias("attempts"), F.col("o_orderdate").alias("created_at"),
    )


QUEUE = """queue AS (SELECT o_orderkey AS seq, 'https://shop.example.com/' || (o_custkey % 500) AS url, left(o_orderpriority, 1)::INT AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS state, (o_orderkey % 4)::INT AS attempts, o_orderdate AS created_at FROM orders)"""

#: Rows that make every arm of the page rules fire: id, html, status, headers, error.
RULE_ROWS = (
    (1, "<p>Access Denied</p>", 200, "", ""),
    (2, "please wait, Ray ID 77", 200, "", ""),
    (3, "Too many requests, slow down", 200, "", ""),
    (4, "enter the characters", 200, "", ""),
    (5, '<div id="react-root"></div>', 200, "", ""),
    (6, "session expired", 200, "", ""),
    (7, "no results found", 200, "", ""),
    (8, "<p>ok</p>", 503, "", ""),
    (9, "<p>ok</p>", 200, "", "timed out"),
    (10, "<html><p>tiny</p></html>", 200, "", ""),
    (11, "please wait ... captcha", 200, "", ""),
    (12, "captcha and cloudflare", 200, "", ""),
    (13, "<div data-sitekey='k'></div>", 200, "", ""),
    (14, "h-captcha", 200, "", ""),
    (15, "what is 3 + 4", 200, "", ""),
    (16, "verify that you are human", 429, "", ""),
    (17, "just a moment... loading", 200, "retry-after: 5", ""),
    (18, "<p>ok</p>", 404, "", ""),
    (19, "window.__data = next", 200, "", ""),
    (20, "<body> </body>", 200, "", ""),
    (21, None, None, None, None),
    (22, "x" * 1200, 200, "", ""),
)


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture rows and all pages."""
    fixture = spark.createDataFrame(list(RULE_ROWS), "id long, html string, status int, headers string, error string")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "html", F.lit(200).alias("status"), F.lit("").alias("headers"), F.lit("").alias("error"))
    return fixture.unionByName(pages)


def values_sql(rows) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


RULE_PAGES = f"""rule_pages AS (SELECT id::BIGINT AS id, html::VARCHAR AS html, status::INT AS status, headers::VARCHAR AS headers, error::VARCHAR AS error
  FROM ({values_sql(RULE_ROWS)}) t(id, html, status, headers, error) UNION ALL SELECT page_id + 1000, html, 200, '', '' FROM pages)"""
