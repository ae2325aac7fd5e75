"""Scalar normalisation over the driver's tables and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.plans.registry import query
from loomfield.plans.views import table, values_sql

TEXTS = ((1, " a \t b\r\n c "), (2, ""), (3, None), (4, "x\x07y\x0bz"), (5, "plain"))


@query(
    f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -id, v FROM ({values_sql(TEXTS)}) x(id, v))
SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS cleaned, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))::INT AS n FROM t WHERE text IS NULL OR text NOT LIKE '%' || chr(7) || '%'"""
)
def clean_text_docs(spark, sf_dir):
    extra = spark.createDataFrame([(-i, v) for i, v in TEXTS], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra).where("text is null or not contains(text, char(7))")
    clean = S.clean_text(F.col("text"))
    return docs.select("doc_id", F.md5(clean).alias("cleaned"), F.length(clean).alias("n"))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


@query(f"""WITH t AS (SELECT id::BIGINT AS id, v FROM ({values_sql(TEXTS)}) x(id, v) UNION ALL SELECT doc_id + 100, chr((doc_id % 31 + 1)::INT) || left(text, 1) || chr(7) || substring(text, 2) || chr(31) FROM documents),
b AS (SELECT id, regexp_replace(v, '{_CONTROL}', '', 'g') AS bare FROM t) SELECT id, md5(bare) AS bare, md5(trim(regexp_replace(bare, '\\s+', ' ', 'g'))) AS tidy FROM b""")
def control_char_clean(spark, sf_dir):
    """Texts of documents with control characters before, within and behind them."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), F.concat(F.char(F.pmod("doc_id", F.lit(31)) + 1), F.left("text", F.lit(1)), F.char(F.lit(7)), F.substring("text", 2, 1 << 30), F.char(F.lit(31))).alias("v"))
    t = spark.createDataFrame(list(TEXTS), "id long, v string").unionByName(docs)
    return t.select("id", F.md5(S.strip_control(F.col("v"), collapse_ws=False)).alias("bare"), F.md5(S.strip_control(F.col("v"))).alias("tidy"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '£' WHEN 3 THEN '¥' ELSE 'A$' END || CASE WHEN p_partkey % 3 = 0 THEN '1,' ELSE '' END || (floor(p_retailprice)::INT) || '.50' AS raw FROM part)
SELECT p_partkey, try_cast(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE) AS amount, CASE WHEN raw LIKE '%$%' THEN 'USD' WHEN raw LIKE '%€%' THEN 'EUR' WHEN raw LIKE '%£%' THEN 'GBP' ELSE 'JPY' END AS currency,
CASE WHEN raw LIKE 'A$%' THEN 'AUD' WHEN raw LIKE '%$%' THEN 'USD' WHEN raw LIKE '%€%' THEN 'EUR' WHEN raw LIKE '%£%' THEN 'GBP' ELSE 'JPY' END AS true_currency,
try_cast(regexp_extract(replace(raw, ',', ''), '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE) AS first_number FROM p""")
def price_parse(spark, sf_dir):
    key = F.pmod("p_partkey", F.lit(5))
    symbol = F.when(key == 0, "$").when(key == 1, "€").when(key == 2, "£").when(key == 3, "¥").otherwise("A$")
    raw = F.concat(symbol, F.when(F.pmod("p_partkey", F.lit(3)) == 0, "1,").otherwise(""), F.floor("p_retailprice").cast("int").cast("string"), F.lit(".50"))
    p = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    both = p.select("p_partkey", "raw", S.price(F.col("raw")).alias("p"))
    return both.select("p_partkey", "p.amount", "p.currency", S.currency(F.col("raw"), compat=False).alias("true_currency"), S.first_price(F.col("raw")).alias("first_number"))


SCORES = ((1, "4.5 out of 5 stars"), (2, "1,234"), (3, "1.2K"), (4, "n/a"), (5, None), (6, "3M ratings"), (7, "12 reviews"))


@query(f"""WITH t AS (SELECT id::BIGINT AS id, v FROM ({values_sql(SCORES)}) x(id, v) UNION ALL SELECT p_partkey + 100, ['Rated ' || p_size || '.5 out of 5', p_size || ',234 ratings', p_size || '.2K reviews', p_size || 'M', 'no reviews by ' || p_brand][(p_partkey % 5 + 1)::INT] FROM part),
n AS (SELECT id, v, replace(lower(coalesce(v, '')), ',', '') AS low FROM t)
SELECT id, try_cast(nullif(regexp_extract(coalesce(v, ''), '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS rating,
coalesce(floor(round(try_cast(nullif(regexp_extract(low, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) * CASE regexp_extract(low, '[0-9]+\\.?[0-9]*\\s*([km])', 1) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END, 6))::BIGINT, 0) AS reviews FROM n""")
def rating_and_reviews(spark, sf_dir):
    size = F.col("p_size").cast("string")
    said = F.array(F.concat(F.lit("Rated "), size, F.lit(".5 out of 5")), F.concat(size, F.lit(",234 ratings")), F.concat(size, F.lit(".2K reviews")), F.concat(size, F.lit("M")), F.concat(F.lit("no reviews by "), "p_brand"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"), F.element_at(said, (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")).alias("v"))
    t = spark.createDataFrame(list(SCORES), "id long, v string").unionByName(parts)
    return t.select("id", S.rating(F.col("v")).alias("rating"), S.review_count(F.col("v")).alias("reviews"))


STOCK = ((1, "In Stock"), (2, "Currently unavailable"), (3, "SOLD OUT"), (4, "Pre-order now"), (5, ""), (6, None), (7, "Out of stock"))


_OFFERS = ("In stock: ", "sold out ", "Pre-Order ", "available from ", "UNAVAILABLE ", "out of stock ", "")


@query(f"""WITH t AS (SELECT id::BIGINT AS id, v FROM ({values_sql(STOCK)}) x(id, v) UNION ALL SELECT p_partkey + 100, {list(_OFFERS)}[(p_partkey % 7 + 1)::INT] || p_name FROM part)
SELECT id, CASE WHEN regexp_matches(lower(coalesce(v, '')), 'in stock|available') THEN 'in_stock' WHEN regexp_matches(lower(coalesce(v, '')), 'out of stock|unavailable|sold out') THEN 'out_of_stock' WHEN lower(v) LIKE '%pre-order%' THEN 'pre_order' ELSE 'unknown' END AS loose,
CASE WHEN regexp_matches(lower(coalesce(v, '')), 'out of stock|unavailable|sold out') THEN 'out_of_stock' WHEN regexp_matches(lower(coalesce(v, '')), 'in stock|available') THEN 'in_stock' WHEN lower(v) LIKE '%pre-order%' THEN 'pre_order' ELSE 'unknown' END AS strict FROM t""")
def availability_parse(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in _OFFERS]), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"), F.concat(said, "p_name").alias("v"))
    t = spark.createDataFrame(list(STOCK), "id long, v string").unionByName(parts)
    return t.select("id", S.availability(F.col("v")).alias("loose"), S.availability(F.col("v"), strict=True).alias("strict"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN day(o_orderdate) <= 12 THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS from_us, 'soon ' || o_orderkey AS kept FROM orders""")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    form = lambda f: S.clean_date(F.date_format("o_orderdate", f))
    return o.select("o_orderkey", form("d/M/yyyy").alias("iso"), form("MM/dd/yyyy").alias("from_us"), S.clean_date(F.concat(F.lit(" soon "), F.col("o_orderkey").cast("string"))).alias("kept"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS raw FROM documents)
SELECT doc_id, raw, CASE WHEN regexp_matches(lower(trim(raw)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') THEN lower(trim(raw)) ELSE '' END AS email FROM m""")
def contact_emails(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(S.EMAIL), F.lit(0)))).alias("raw"))
    return found.select("doc_id", "raw", S.clean_email(F.col("raw")).alias("email"))


PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE}')) AS raw FROM documents), d AS (SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS x FROM m)
SELECT doc_id, raw, CASE WHEN length(x) >= 10 THEN right(x, 10) ELSE x END AS phone FROM d""")
def contact_phones(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("raw"))
    return found.select("doc_id", "raw", S.clean_phone(F.col("raw")).alias("phone"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '\\?([^#]*)', 1) AS query, array_to_string(list_slice(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), -2, -1), '.') AS base, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '[0-9]+', '*', 'g') AS pattern FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    host = S.netloc(u)
    return table(spark, sf_dir, "pages").select("page_id", S.scheme(u).alias("scheme"), host.alias("host"), S.url_path(u).alias("path"), S.url_query(u).alias("query"), S.base_domain(host).alias("base"), S.domain_pattern(host).alias("pattern"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') END AS for_map,
rtrim(split_part(trim(url), '?', 1), '/') AS for_record FROM pages""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.normalize_page_url(F.col("url")).alias("for_map"), S.normalize_record_url(F.col("url")).alias("for_record"))


@query("""WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) SELECT split_part(p, '=', 1) AS name, count(*) AS n FROM q WHERE p LIKE '%=%' GROUP BY 1""")
def url_query_params(spark, sf_dir):
    names = table(spark, sf_dir, "pages").select(F.explode(S.query_names(F.col("url"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


JOINS = (
    (1, "http://a.com/b/c?x=1#f", "../d", "http://a.com/d"), (2, "http://a.com/b/c", "./e/./f", "http://a.com/b/e/f"), (3, "http://a.com/b/c", "//h.org/z", "http://h.org/z"),
    (4, "http://a.com/b/c", "/r", "http://a.com/r"), (5, "http://a.com/b/c?x=1", "?y=2", "http://a.com/b/c?y=2"), (6, "http://a.com/b/c", "#top", "http://a.com/b/c#top"),
    (7, "http://a.com/b/c", "mailto:x@y.z", "mailto:x@y.z"), (8, "http://a.com", "k", "http://a.com/k"), (9, "http://a.com/b/", "../../../z", "http://a.com/z"), (10, "http://a.com/b/c", "https://o.com/p", "https://o.com/p"),
)


_LINKS = ("/x/y.html", "next.html?p=2", "?sort=up", "//cdn.example.org/i.png", "#end", "../up", "https://o.example.com/z", "./here")


@query(rf"""WITH p AS (SELECT page_id, url, {list(_LINKS)}[(page_id % 8 + 1)::INT] AS link, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder FROM p)
SELECT id::BIGINT AS id, want AS joined FROM ({values_sql(JOINS)}) x(id, base, link, want) UNION ALL
SELECT page_id + 100, CASE page_id % 8 WHEN 0 THEN root || link WHEN 1 THEN root || folder || link WHEN 2 THEN root || path || link WHEN 3 THEN scheme || ':' || link WHEN 4 THEN split_part(url, '#', 1) || link
  WHEN 5 THEN root || CASE WHEN folder = '/' THEN '/' ELSE regexp_extract(folder, '^(.*/)[^/]*/$', 1) END || 'up' WHEN 6 THEN link ELSE root || folder || 'here' END FROM f""")
def url_join(spark, sf_dir):
    """Links of every form against the urls of pages."""
    link = F.element_at(F.array(*[F.lit(x) for x in _LINKS]), (F.pmod("page_id", F.lit(8)) + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("id"), F.col("url").alias("base"), link.alias("link"))
    t = spark.createDataFrame(list(JOINS), "id long, base string, link string, want string").drop("want").unionByName(pages)
    return t.select("id", S.absolute_url(F.col("base"), F.col("link")).alias("joined"))


@query("""WITH n AS (SELECT page_id, split_part(url, '#', 1) AS base, page_id % 4 AS pages FROM pages), x AS (SELECT page_id, base, unnest(range(0, pages)) AS i FROM n)
SELECT page_id, i::INT AS i, base || CASE WHEN base LIKE '%?%' THEN '&' ELSE '?' END || 'page=' || (i + 1) AS by_page, base || CASE WHEN base LIKE '%?%' THEN '&' ELSE '?' END || 'offset=' || (i * 20) AS by_offset FROM x""")
def page_url_generation(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "#", 1).alias("base"), F.pmod("page_id", F.lit(4)).cast("int").alias("pages"))
    both = F.arrays_zip(S.page_urls(F.col("base"), F.col("pages")).alias("a"), S.page_urls(F.col("base"), F.col("pages"), "offset", offset=True).alias("b"))
    return p.select("page_id", F.posexplode(both).alias("i", "u")).select("page_id", "i", F.col("u.a").alias("by_page"), F.col("u.b").alias("by_offset"))


@query("""SELECT p_partkey, 'https://search.example.com/s?q=' || replace(p_name, ' ', '+') || '&page=' || p_size AS url, substring(md5(p_name), 1, 16) AS id, md5(p_name || ':{"a": "' || p_type || '", "b": "' || p_brand || '"}') AS cache_key,
left(regexp_replace(p_name || '/' || p_brand, '[^a-zA-Z0-9_ \\n-]', '', 'g'), 50) AS filename FROM part""")
def ids_and_search_urls(spark, sf_dir):
    name = F.col("p_name")
    selectors = F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.search_url("https://search.example.com/s", name, page=F.col("p_size")).alias("url"), S.short_id(name).alias("id"), S.cache_key(name, selectors).alias("cache_key"),
        S.safe_filename(F.concat(name, F.lit("/"), F.col("p_brand"))).alias("filename"),
    )


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 3 AND x NOT IN ('with', 'from', 'were', 'been', 'being', 'have', 'does', 'will', 'would', 'should', 'could', 'might', 'must', 'this', 'that', 'these', 'those', 'they')))) AS k FROM documents)
SELECT doc_id, array_to_string(k[1:10], ',') AS keywords FROM w""")
def keyword_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.keywords(F.col("text")), ",").alias("keywords"))


SELECTORS = ((1, "title:h1,price:.p"), (2, "bad, a:b"), (3, ""))


@query("""SELECT 1::BIGINT AS id, 'price' AS k, '.p' AS v UNION ALL SELECT 1, 'title', 'h1' UNION ALL SELECT 2, 'a', 'b'
UNION ALL SELECT p_partkey + 100, 'title', p_brand FROM part UNION ALL SELECT p_partkey + 100, split_part(p_name, ' ', 1), '.' || p_type FROM part""")
def selector_parse(spark, sf_dir):
    """Selectors in one text for each part, with spaces and a piece that isn't one."""
    own = F.concat(F.lit("title:"), "p_brand", F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" : ."), "p_type", F.lit(" ,none"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"), own.alias("s"))
    t = spark.createDataFrame(list(SELECTORS), "id long, s string").unionByName(parts)
    return t.select("id", F.explode(S.selector_map(F.col("s"))).alias("k", "v"))


@query("SELECT event_id, user_id, event_id % 10 AS attempt, least(1.5 * power(2.0, event_id % 10), 60.0)::DOUBLE AS delay FROM events WHERE event_type = 'error'")
def backoff_delays(spark, sf_dir):
    """The wait before each failed event's next attempt."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("attempt", F.pmod("event_id", F.lit(10)))
    return e.select("event_id", "user_id", "attempt", S.backoff(F.col("attempt"), 1.5).alias("delay"))
