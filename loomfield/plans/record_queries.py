"""Validation, de-duplication, snapshots, joins and export shapes over records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators import graph, substring
from loomfield.operators import records as R
from loomfield.plans.registry import query
from loomfield.plans.views import table, values_sql
from loomfield.session import ensure_checkpoint_dir
from loomfield.sources import readers, writers

RAW = ((1, "a", "12", None, "5"), (2, None, "7", "x", ""), (3, "c", "no", "y", "1.5"), (4, "d", " 8 ", "", None), (5, "", "9", "z", "true"))
_RAW = f"raw AS (SELECT id::BIGINT AS id, name, qty, note, price FROM ({values_sql(RAW)}) t(id, name, qty, note, price))"


def _raw(spark):
    return spark.createDataFrame(list(RAW), "id long, name string, qty string, note string, price string")


@query(f"WITH {_RAW} SELECT id, name, try_cast(trim(qty) AS BIGINT) AS qty FROM raw WHERE name IS NOT NULL AND try_cast(trim(qty) AS BIGINT) IS NOT NULL UNION ALL SELECT event_id + 100, event_type, user_id FROM events")
def validate_required_cast(spark, sf_dir):
    rules = {"name": R.FieldRule("string", required=True), "qty": R.FieldRule("bigint", required=True)}
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("id"), F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("qty"))
    return R.validate(_raw(spark).select("id", "name", "qty").unionByName(events), rules)


_LOOSE = """loose AS (SELECT id, name, qty, price FROM raw UNION ALL SELECT p_partkey + 10, CASE WHEN p_partkey % 5 > 0 THEN p_name END, [p_size::VARCHAR, 'no', ' ' || p_size || ' ', NULL][(p_partkey % 4 + 1)::INT], [p_retailprice::VARCHAR, '', 'true'][(p_partkey % 3 + 1)::INT] FROM part)"""


def _loose(spark, sf_dir):
    """Rows whose values are texts of more or less the wanted types: a few given ones and one for each part."""
    nth = lambda n, *values: F.element_at(F.array(*values), (F.pmod("p_partkey", F.lit(n)) + 1).cast("int"))
    size, none = F.col("p_size").cast("string"), F.lit(None).cast("string")
    parts = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 10).alias("id"), F.when(F.pmod("p_partkey", F.lit(5)) > 0, F.col("p_name")).alias("name"), nth(4, size, F.lit("no"), F.concat(F.lit(" "), size, F.lit(" ")), none).alias("qty"),
        nth(3, F.col("p_retailprice").cast("string"), F.lit(""), F.lit("true")).alias("price"),
    )
    return _raw(spark).select("id", "name", "qty", "price").unionByName(parts)


@query(f"WITH {_RAW}, {_LOOSE} SELECT id, coalesce(name, 'unnamed') AS name, coalesce(try_cast(trim(qty) AS BIGINT), 0) AS qty, coalesce(try_cast(price AS DOUBLE), 0.5) AS price, 'new' AS state FROM loose")
def default_coerce(spark, sf_dir):
    rules = {"name": R.FieldRule("string", default="unnamed"), "qty": R.FieldRule("bigint", default=0), "price": R.FieldRule("double", default=0.5), "state": R.FieldRule("string", default="new")}
    return R.coerce(_loose(spark, sf_dir), rules)


@query("SELECT p_partkey, nullif(p_name, '') AS p_name, nullif(p_size % 5, 0)::INT AS size, nullif(p_retailprice, 0) AS price FROM part")
def drop_falsy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 5).cast("int").alias("size"), F.col("p_retailprice").alias("price"))
    return R.null_falsy(p, "p_partkey")


@query("SELECT c_custkey AS customer_key, trim('  ' || c_name || ' ') AS customer_name FROM customer")
def normalize_record_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return R.normalize_keys(c.select(F.col("c_custkey").alias("Customer Key"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias(" Customer Name"), F.lit(1).alias("_private")))


@query("SELECT p_partkey, upper(trim(p_name)) || '!' AS p_name FROM part WHERE p_size > 10")
def ordered_stages(spark, sf_dir):
    stages = [(20, lambda d: d.withColumn("p_name", F.concat("p_name", F.lit("!")))), (10, lambda d: d.withColumn("p_name", F.upper(F.trim("p_name")))), (5, lambda d: d.where("p_size > 10"))]
    return R.compose(table(spark, sf_dir, "part"), stages).select("p_partkey", "p_name")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_text_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return R.first_wins(docs, F.col("h"), [F.col("doc_id")]).select("doc_id")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY rtrim(split_part(trim(url), '?', 1), '/') ORDER BY page_id) AS r FROM pages) WHERE r = 1 UNION ALL SELECT -1 UNION ALL SELECT -2")
def dedup_normalizer(spark, sf_dir):
    """Pages by normalised url; rows without one are told by their content."""
    blank = spark.createDataFrame([(-1, "", "x"), (-2, None, "y")], "page_id long, url string, html string")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), "url", F.lit("").alias("html")).unionByName(blank)
    return R.unique_records(pages, "url", [F.col("page_id")], leave=["page_id"]).select("page_id")


@query("SELECT p_partkey, p_name, NULL::VARCHAR AS s_name FROM part UNION ALL SELECT s_suppkey + 1000000, NULL, s_name FROM supplier")
def union_missing_columns(spark, sf_dir):
    return R.merge(table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("p_partkey"), "s_name"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return R.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH old AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0), new AS (SELECT s_suppkey AS k, upper(s_name) AS v FROM supplier WHERE s_suppkey % 3 = 0)
SELECT 'ignore' AS how, k, v FROM old UNION ALL SELECT 'ignore', k, v FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT 'replace', k, v FROM new UNION ALL SELECT 'replace', k, v FROM old WHERE k NOT IN (SELECT k FROM new)""")
def upserts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    old, new = s.where("k % 2 = 0"), s.where("k % 3 = 0").withColumn("v", F.upper("v"))
    return R.insert_or_ignore(old, new, ["k"]).select(F.lit("ignore").alias("how"), "k", "v").unionByName(R.upsert(old, new, ["k"]).select(F.lit("replace").alias("how"), "k", "v"))


@query("""WITH old AS (SELECT doc_id AS k, md5(text) AS v FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE md5(text) END AS v FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0)
SELECT 'new' AS how, k FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL SELECT 'changed', n.k FROM new n LEFT JOIN old o ON n.k = o.k AND n.v = o.v WHERE o.k IS NULL""")
def incremental_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.md5("text").alias("v"))
    old, new = d.where("k % 2 = 0"), d.where("k % 3 = 0 or k % 4 = 0").withColumn("v", F.when(F.col("k") % 4 == 0, "changed").otherwise(F.col("v")))
    fresh = R.new_items(new, old, "k").select(F.lit("new").alias("how"), "k")
    return fresh.unionByName(R.new_items(new, old, "k", changed=True).select(F.lit("changed").alias("how"), "k"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), d AS (SELECT DISTINCT host, length(host) AS score FROM p WHERE page_id % 2 = 0) SELECT p.page_id, d.score FROM p LEFT JOIN d USING (host)""")
def domain_profile_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", S.netloc(F.col("url")).alias("host"))
    d = p.where("page_id % 2 = 0").select("host").distinct().withColumn("score", F.length("host").cast("long"))
    return p.join(d, "host", "left").select("page_id", "score")


@query("""SELECT page_id, r AS site FROM pages, (SELECT unnest(['example.com', 'example.org', 'ads']) AS r) WHERE contains(regexp_extract(url, '://([^/?#]*)', 1), r)""")
def domain_contains_rules(spark, sf_dir):
    """A theta match against a literal rule list: one pass over pages, no join."""
    host = S.netloc(F.col("url"))
    rules = F.filter(F.array(*[F.lit(r) for r in ("example.com", "example.org", "ads")]), lambda r: F.contains(host, r))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rules).alias("site"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), d AS (SELECT DISTINCT unnest([host, regexp_replace(host, '^[^.]*\.', ''), split_part(host, '.', 2)]) AS domain FROM p)
SELECT page_id, domain FROM p JOIN d ON domain <> '' AND contains(host, domain)""")
def domain_contains_table(spark, sf_dir):
    """A table of domains, thousands of them, each with the pages whose host holds it."""
    p = table(spark, sf_dir, "pages").select("page_id", S.netloc(F.col("url")).alias("host"))
    domains = p.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""), F.split_part("host", F.lit("."), F.lit(2)))).alias("domain")).distinct()
    return substring.matches(p, "page_id", ["host"], domains).select("page_id", F.col("needle").alias("domain"))


@query("""WITH c AS (SELECT event_id, list_filter(['cloudflare', 'captcha', 'antibot'], lambda x: (event_id + length(x)) % 3 = 0) AS found FROM events) SELECT t AS technique, count(*) AS n FROM c, unnest(found) u(f), (VALUES ('stealth', 'cloudflare'), ('stealth', 'antibot'), ('solver', 'captcha')) x(t, k) WHERE f = k GROUP BY t""")
def technique_overlap(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("cloudflare", "captcha", "antibot")])
    found = table(spark, sf_dir, "events").select(F.explode(F.filter(kinds, lambda x: F.pmod(F.col("event_id") + F.length(x), F.lit(3)) == 0)).alias("k"))
    techniques = spark.createDataFrame([("stealth", "cloudflare"), ("stealth", "antibot"), ("solver", "captcha")], "technique string, k string")
    return found.groupBy("k").count().join(techniques, "k").groupBy("technique").agg(F.sum("count").alias("n"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS x FROM orders GROUP BY 1), b AS (SELECT c_custkey, list_transform(range(0, c_custkey % 4), lambda i: c_name || '-' || i) AS y FROM customer)
SELECT c_custkey, i::INT AS i, x[i + 1] AS order_key, y[i + 1] AS label FROM (SELECT c_custkey, coalesce(x, []) AS x, y, unnest(range(0, greatest(len(coalesce(x, [])), len(y)))) AS i FROM b LEFT JOIN a ON c_custkey = o_custkey)""")
def positional_zip(spark, sf_dir):
    """Two lists of each customer side by side: both as rows with their places, joined on them, so that no list is held
    whole and a customer with very many orders is rows like others."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    known = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.pmod("c_custkey", F.lit(4)).cast("int").alias("n"))
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), place.alias("i"), F.col("o_orderkey").alias("order_key")).join(known.select("c_custkey"), "c_custkey", "left_semi")
    b = known.where("n > 0").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("c_custkey", "i", F.concat("c_name", F.lit("-"), F.col("i").cast("string")).alias("label"))
    return a.join(b, ["c_custkey", "i"], "full").select("c_custkey", "i", "order_key", "label")


@query("""SELECT p_partkey, p_brand AS meta_brand, p_size AS meta_size_value, p_name || '; ' || p_type AS tags, '' AS none, '[{"k":' || p_size || '}]' AS rows FROM part""")
def flatten_records(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("value")).alias("size")).alias("meta"), F.array("p_name", "p_type").alias("tags"), F.array().cast("array<string>").alias("none"),
        F.array(F.struct(F.col("p_size").alias("k"))).alias("rows"),
    )
    return R.flatten(p)


@query("SELECT coalesce(n_name, '') AS n_name, n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_regionkey = 0 THEN 'None' ELSE n_regionkey::VARCHAR END AS n_regionkey FROM nation")
def export_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")))
    return R.export_columns(n, "None")


@query("""SELECT c_custkey, c_name, count(*) OVER () AS record_count, 'customers' AS source FROM customer""")
def metadata_envelope(spark, sf_dir):
    """A document {metadata, data} of all customers in ordered parts, read back: each row with what the metadata says."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/envelope-{uuid.uuid4().hex}"
    writers.write_envelope(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, "customers", "http://a.com", "2024-01-01T00:00:00", ["c_custkey"])
    rows, frame = readers.read_document(spark, path, "c_custkey bigint, c_name string")
    meta = F.from_json(F.lit(frame), "metadata struct<source: string, record_count: bigint>")["metadata"]
    return rows.select("c_custkey", "c_name", meta["record_count"].alias("record_count"), meta["source"].alias("source"))


@query("""SELECT conv_id, md5(string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn)) AS document FROM conversations GROUP BY conv_id""")
def conversation_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(F.lit("**"), x["role"], F.lit("**: "), x["text"]))
    return c.select("conv_id", F.md5(F.array_join(lines, "\n\n")).alias("document"))


@query("SELECT doc_id, left(text, 120) AS tagline, left(text, 200) AS description, array_to_string(string_split(text, ' ')[1:5], ',') AS tags, string_split(text, ' ')[1] AS topic FROM documents")
def directory_projection(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(120)).alias("tagline"), F.left("text", F.lit(200)).alias("description"), F.array_join(F.slice(words, 1, 5), ",").alias("tags"), words[0].alias("topic"))


BODIES = ((1, '[{"a":1},{"a":2}]'), (2, '{"data":[{"a":3}]}'), (3, '{"items":[4,5]}'), (4, '{"b":6}'), (5, "broken"), (6, '{"results":[]}'))


@query("""SELECT * FROM (VALUES (1::BIGINT, 0, '{"a":1}'), (1, 1, '{"a":2}'), (2, 0, '{"a":3}'), (3, 0, '4'), (3, 1, '5'), (4, 0, '{"b":6}')) t(id, pos, item) UNION ALL SELECT event_id + 10, 0, replace(props, ' ', '') FROM events""")
def unwrap_responses(spark, sf_dir):
    fixture = spark.createDataFrame(list(BODIES), "id long, body string")
    return R.unwrap_response(fixture.unionByName(table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("id"), F.col("props").alias("body"))), "body", ["id"])


@query("""SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type""")
def json_fields(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(v).alias("k"), F.count("*").alias("n"))


@query(f"""WITH {_RAW}, {_LOOSE} SELECT id, name, try_cast(trim(qty) AS BIGINT) AS qty, count(*) OVER () AS count FROM loose WHERE name IS NOT NULL AND try_cast(trim(qty) AS BIGINT) IS NOT NULL""")
def validated_envelope(spark, sf_dir):
    """A document {count, schema, data} of the rows that fit a schema, in parts, read back."""
    rules = {"id": R.FieldRule("bigint", required=True), "name": R.FieldRule("string", required=True), "qty": R.FieldRule("bigint", required=True)}
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/validated-{uuid.uuid4().hex}"
    writers.write_validated(_loose(spark, sf_dir), path, rules, ["id"])
    rows, frame = readers.read_document(spark, path, "id bigint, name string, qty bigint")
    return rows.withColumn("count", F.get_json_object(F.lit(frame), "$.count").cast("bigint"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part""")
def skill_import(spark, sf_dir):
    """All skills exported as JSON rows, read back and added where their key isn't there yet, which every second one's is."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    exported = p.withColumn("name", F.upper("name")).select(F.to_json(F.struct("id", "name")).alias("line"))
    given = exported.select(F.from_json("line", "id long, name string").alias("r")).select("r.*")
    return R.insert_or_ignore(p.where("id % 2 = 0"), given, ["id"])


@query("""WITH m AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT page_id + 1000000, url || '/' FROM pages WHERE page_id % 2 = 0 AND url NOT LIKE '%?%' AND url NOT LIKE '%/' UNION ALL SELECT s_suppkey + 2000000, NULL FROM supplier)
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CASE WHEN url IS NULL THEN id::VARCHAR ELSE rtrim(split_part(trim(url), '?', 1), '/') END ORDER BY id) AS r FROM m) WHERE r = 1""")
def merged_records(spark, sf_dir):
    """Lists of several workers with different fields, then one record per normalised url or content."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    again = pages.where("id % 2 = 0 and url not like '%?%' and url not like '%/'").select((F.col("id") + 1000000).alias("id"), F.concat("url", F.lit("/")).alias("url"))
    others = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2000000).alias("id"), F.col("s_suppkey").cast("string").alias("name"))
    return R.unique_records(R.merge(pages, again, others), "url", [F.col("id")], leave=["id"]).select("id")


@query(r"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) WHERE regexp_matches(href, '^/[A-Z]') GROUP BY page_id""")
def links_by_pattern(spark, sf_dir):
    """Links whose target matches a regular expression."""
    found = graph.page_links(table(spark, sf_dir, "pages")).where(F.col("href").rlike("^/[A-Z]"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"))
