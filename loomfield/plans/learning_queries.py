"""Answers, demonstrations, skills, agents and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators import learning as L
from loomfield.plans.registry import query
from loomfield.plans.views import SKILLS, skills, table
from loomfield.session import ensure_checkpoint_dir

ANSWERS = ((1, '```json\n{"a": 1}\n```'), (2, '{"b": 2}'), (3, 'Sure: {"c": {"d": 3}} ok'), (4, "none"))


@query("""SELECT * FROM (VALUES (1::BIGINT, '{"a":1}', '{"a":1}'), (2, '{"b":2}', '{"b":2}'), (3, '{"c":{"d":3}}', '{"d":3}'), (4, '{"error":"no JSON found","raw":"none"}', NULL)) t(id, json, flat)
UNION ALL SELECT event_id + 10, CASE event_id % 4 WHEN 2 THEN '{"c":' || replace(props, ' ', '') || '}' WHEN 3 THEN '{"error":"no JSON found","raw":"none ' || event_type || '"}' ELSE replace(props, ' ', '') END, CASE WHEN event_id % 4 < 3 THEN replace(props, ' ', '') END FROM events""")
def answer_json(spark, sf_dir):
    """Answers around the properties of events: fenced, bare, within words, none."""
    props = F.col("props")
    said = F.array(F.concat(F.lit("```json\n"), props, F.lit("\n```")), props, F.concat(F.lit('Sure: {"c": '), props, F.lit("} ok")), F.concat(F.lit("none "), "event_type"))
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("id"), F.element_at(said, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("answer"))
    t = spark.createDataFrame(list(ANSWERS), "id long, answer string").unionByName(events)
    return t.select("id", L.repaired_json(F.col("answer")).alias("json"), L.flat_object(F.col("answer")).alias("flat"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-3][^>]*>([^<]*)', 1)[1:10])::INT AS n_titles, len(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)[1:20])::INT AS n_links, len(regexp_extract_all(html, '\$[0-9,]+\.?[0-9]*'))::INT AS n_prices FROM pages""")
def prompted_extraction(spark, sf_dir):
    got = L.prompted(F.col("html"), F.lit("all titles, links and prices"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(got["titles"]).alias("n_titles"), F.size(got["links"]).alias("n_links"), F.size(got["prices"]).alias("n_prices"))


@query("""SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 > 0 THEN [p_name, p_brand] ELSE [p_name] END) AS name, p_retailprice::DECIMAL(12, 1)::VARCHAR AS price, CASE WHEN p_size > 25 THEN true END AS in_stock, NULL AS rating FROM part WHERE p_partkey % 7 > 0""")
def template_products(spark, sf_dir):
    """Answers about the parts, in words or fenced, as typed rows; every seventh one holds nothing."""
    price = F.col("p_retailprice").cast("decimal(12,1)").cast("string")
    item = lambda name: F.struct(F.col(name).alias("name"), price.alias("price"), F.when(F.col("p_size") > 25, True).alias("in_stock"), F.lit(1).alias("odd"))
    items = F.when(F.pmod("p_partkey", F.lit(3)) > 0, F.array(item("p_name"), item("p_brand"))).otherwise(F.array(item("p_name")))
    body = F.to_json(F.struct(items.alias("products")))
    said = F.when(F.pmod("p_partkey", F.lit(7)) == 0, "nothing here").when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("Here: "), body, F.lit(" and so on"))).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    answers = table(spark, sf_dir, "part").select("p_partkey", said.alias("answer"))
    return L.template_items(answers, "answer", "products", ["p_partkey"]).select("p_partkey", "name", "price", "in_stock", "rating")


@query("""SELECT * FROM (VALUES (1::BIGINT, '{"n":1}'), (1, '{"n":2}'), (2, '{"x":[{"y":1}]}')) t(id, item)
UNION ALL SELECT event_id + 10, CASE WHEN event_id % 4 = 0 THEN unnest([replace(props, ' ', ''), '{"n":2}']) ELSE '{"x":[' || replace(props, ' ', '') || ']}' END FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id + 10, '{"x":[' || replace(props, ' ', '') || ']}' FROM events WHERE event_id % 4 = 1""")
def graphql_items(spark, sf_dir):
    """Responses around the properties of events: a list below objects, a list of objects, no JSON, no list."""
    rows = [(1, '{"data": {"user": {"items": [{"n": 1}, {"n": 2}, 3]}}}'), (2, '[{"x": [{"y": 1}]}]'), (3, "broken"), (4, '{"a": 1}')]
    props = F.col("props")
    said = F.array(F.concat(F.lit('{"data": {"user": {"items": ['), props, F.lit(', {"n": 2}, 3]}}}')), F.concat(F.lit('[{"x": ['), props, F.lit("]}]")), F.concat(F.lit("broken "), props), props)
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("id"), F.element_at(said, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("body"))
    return L.list_objects(spark.createDataFrame(rows, "id long, body string").unionByName(events), "body", ["id"])


@query("""WITH a AS (SELECT event_id // 10 AS demo_id, event_id AS seq, event_type AS action, ['div > h1:nth-child(2)', 'span[class*=''price'']', 'ul:nth-of-type(3) img', 'b', 'i > a'][(event_id % 5 + 1)::INT] AS s FROM events),
c AS (SELECT *, CASE s WHEN 'div > h1:nth-child(2)' THEN 'title' WHEN 'span[class*=''price'']' THEN 'price' WHEN 'ul:nth-of-type(3) img' THEN 'description' WHEN 'i > a' THEN 'link' END AS field FROM a WHERE action = 'click')
SELECT demo_id, field, regexp_replace(regexp_replace(arg_max(s, seq), ':nth-child\\([0-9]+\\)', '', 'g'), ':nth-of-type\\([0-9]+\\)', ':first-of-type', 'g') AS selector FROM c WHERE field IS NOT NULL GROUP BY ALL""")
def workflow_learning(spark, sf_dir):
    picks = F.array(*[F.lit(s) for s in ("div > h1:nth-child(2)", "span[class*='price']", "ul:nth-of-type(3) img", "b", "i > a")])
    e = table(spark, sf_dir, "events")
    actions = e.select(F.floor(F.col("event_id") / 10).alias("demo_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.element_at(picks, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("selector"))
    return L.learned_workflows(actions)


@query(f"""WITH {SKILLS} SELECT id, CASE problem_type WHEN 'bot_detected' THEN 'Bot Detection Bypass' WHEN 'cloudflare' THEN 'Cloudflare Challenge' WHEN 'rate_limited' THEN 'Rate Limit Handler' WHEN 'captcha' THEN 'CAPTCHA Solver' ELSE 'JS Render Fix' END || ' - for shop' || (id % 3) ||
CASE id % 2 WHEN 0 THEN ' - Browser Method' ELSE '' END AS name, CASE problem_type WHEN 'bot_detected' THEN 'anti_detection' WHEN 'cloudflare' THEN 'protection' WHEN 'rate_limited' THEN 'rate_limiting' WHEN 'captcha' THEN 'captcha' ELSE 'rendering' END AS category FROM skills""")
def skill_naming(spark, sf_dir):
    url = F.concat(F.lit("https://www.shop"), F.pmod("id", F.lit(3)).cast("string"), F.lit(".com/x"))
    method = F.when(F.pmod("id", F.lit(2)) == 0, "use_browser")
    return skills(spark, sf_dir).select("id", L.skill_name(F.col("problem_type"), url, method).alias("name"), S.lookup(F.col("problem_type"), S.CATEGORIES).alias("category"))


@query(f"""WITH {SKILLS} SELECT id, CASE problem_type WHEN 'captcha' THEN 'solve' WHEN 'cloudflare' THEN 'wait' END AS technique, round(CASE problem_type WHEN 'captcha' THEN 0.9 WHEN 'cloudflare' THEN 0.7 * 0.8 ELSE 0.4 END, 6)::DOUBLE AS confidence FROM skills""")
def solution_lookup(spark, sf_dir):
    words = F.when(F.col("problem_type") == "captcha", F.split("tags", ",")).otherwise(F.array().cast("array<string>"))
    problems = skills(spark, sf_dir).select("id", "problem_type", words.alias("keywords"))
    patterns = spark.createDataFrame([("captcha", 1, "solve", 0.9), ("captcha", 2, "prompt", 0.95), ("cloudflare", 1, "wait", 0.7)], "problem_type string, seq int, technique string, confidence double")
    return L.first_solution(problems, patterns).select("id", "technique", F.round("confidence", 6).alias("confidence"))


@query("""SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 2 = 0 THEN 'Use stealth browser mode' END, CASE WHEN user_id % 3 = 0 THEN 'Try proxy rotation' END, CASE WHEN user_id % 5 = 0 THEN 'Use scroll pattern' END,
CASE WHEN user_id % 7 = 0 OR user_id % 5 = 0 THEN 'Increase wait times' END], lambda x: x IS NOT NULL), '; ') AS tips FROM (SELECT DISTINCT user_id FROM events)""")
def site_suggestions(spark, sf_dir):
    flag = lambda n: F.pmod("user_id", F.lit(n)) == 0
    tips = L.suggestions({"cloudflare": flag(2), "antibot": flag(3), "lazy_load": flag(5), "captcha": flag(7)})
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.array_join(tips, "; ").alias("tips"))


@query("""WITH agents AS (SELECT * FROM (VALUES ('clicker', 'click', 20), ('veteran', 'nothing', 250), ('buyer', 'purchase and pay', 50)) t(agent, specialization, completed)
UNION ALL SELECT s_name, ['Click and View', 'errors', 'sign', 'parts', NULL][(s_suppkey % 5 + 1)::INT], (s_suppkey % 150)::INT FROM supplier),
types AS (SELECT DISTINCT event_type AS task_type FROM events UNION SELECT DISTINCT lower(p_type) || ' parts' FROM part),
scored AS (SELECT task_type, agent, CASE WHEN contains(lower(specialization), lower(task_type)) OR contains(lower(task_type), lower(specialization)) THEN 1.0 ELSE 0.0 END + completed / 100 AS score FROM types, agents)
SELECT task_type, agent, round(score, 6)::DOUBLE AS score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY score DESC, agent) = 1""")
def agent_for_task(spark, sf_dir):
    """Types of events and parts, and an agent for each supplier."""
    few = spark.createDataFrame([("clicker", "click", 20), ("veteran", "nothing", 250), ("buyer", "purchase and pay", 50)], "agent string, specialization string, completed int")
    skill = F.element_at(F.array(F.lit("Click and View"), F.lit("errors"), F.lit("sign"), F.lit("parts"), F.lit(None).cast("string")), (F.pmod("s_suppkey", F.lit(5)) + 1).cast("int"))
    agents = few.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("agent"), skill.alias("specialization"), F.pmod("s_suppkey", F.lit(150)).cast("int").alias("completed")))
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("task_type")).unionAll(table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit(" parts"))))
    ensure_checkpoint_dir(spark)
    return L.best_agent(types, agents).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 1 DAY + INTERVAL 30 MINUTE AS next_run FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate) AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 15 MINUTE FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate) AND o_orderkey % 2 = 1")
def cron_next_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate = date_trunc('day', o_orderdate)")
    jobs = o.select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "30 0 * * *").otherwise("*/15 * * * *").alias("cron"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_orderdate") + F.expr("interval 31 minutes")).otherwise(F.col("o_orderdate")).alias("last_run"))
    return L.next_runs(jobs).select("o_orderkey", "next_run")


@query("SELECT 'priced' AS rule, count(*) FILTER (WHERE NOT p_retailprice > 950) AS n_failed, count(*) AS n_rows FROM part UNION ALL SELECT 'named', 0, count(*) FROM part")
def data_expectations(spark, sf_dir):
    return L.expectations(table(spark, sf_dir, "part"), [("priced", F.col("p_retailprice") > 950), ("named", F.col("p_name").isNotNull())])


@query("SELECT user_id, round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 3)::DOUBLE AS seconds, count(*) AS n_actions FROM events GROUP BY user_id")
def demonstration_durations(spark, sf_dir):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000.0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(span, 3).alias("seconds"), F.count("*").alias("n_actions"))


@query("""SELECT page_id, coalesce('quality ' || any_value(quality), 'missing') AS status FROM pages LEFT JOIN labels ON doc_id = page_id GROUP BY page_id""")
def batch_statuses(spark, sf_dir):
    """Requested pages with their results, the labels of their numbers; those without one become error rows instead of
    vanishing."""
    results = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality"))
    asked = table(spark, sf_dir, "pages").select("page_id")
    return asked.join(results, "page_id", "left").select("page_id", F.coalesce(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.lit("missing")).alias("status"))
