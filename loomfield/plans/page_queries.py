"""Links, rules and graphs over pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomfield.functions import rules as R
from loomfield.functions import scalar as S
from loomfield.operators import discovery, graph, patterns, stats
from loomfield.plans.registry import SQL, query
from loomfield.plans.views import RULE_PAGES, rule_pages, table
from loomfield.session import ensure_checkpoint_dir

_LINKS = r"""links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
absolute AS (SELECT page_id, url, href, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS target FROM links)"""
_NORMAL = "regexp_extract(target, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN rtrim(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '/') END"


def _links(spark, sf_dir):
    found = graph.page_links(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "pos", "href", S.netloc(F.col("url")).alias("host"), S.absolute_url(F.col("url"), F.col("href")).alias("target"))


@query(f"""WITH {_LINKS} SELECT host, count(*) AS n_links, count(DISTINCT {_NORMAL}) AS n_distinct, count(*) FILTER (WHERE regexp_extract(target, '://([^/?#]*)', 1) = host) AS n_internal FROM absolute GROUP BY host""")
def page_link_stats(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct(S.normalize_page_url(F.col("target"))).alias("n_distinct"), F.count_if(S.netloc(F.col("target")) == F.col("host")).alias("n_internal"))


@query(r"""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS heading, regexp_extract(html, '<title[^>]*>([^<]*)', 1) AS title, regexp_extract(html, 'charset="?([A-Za-z0-9-]+)', 1) AS charset FROM pages""")
def page_title_headings(spark, sf_dir):
    one = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", one("<h1[^>]*>([^<]*)").alias("heading"), one("<title[^>]*>([^<]*)").alias("title"), one('charset="?([A-Za-z0-9-]+)').alias("charset"))


@query(f"""WITH {_LINKS} SELECT page_id, count(*) FILTER (WHERE h = host) AS same_host, count(*) FILTER (WHERE h = base OR h LIKE '%.' || base) AS same_domain,
count(*) FILTER (WHERE regexp_matches(lower(href), 'login|signup|register|signin|password|reset|auth|logout')) AS n_blocked FROM (SELECT *, regexp_extract(target, '://([^/?#]*)', 1) AS h, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS base FROM absolute) GROUP BY page_id""")
def internal_vs_external_links(spark, sf_dir):
    h, base = S.netloc(F.col("target")), S.base_domain(F.col("host"))
    links = _links(spark, sf_dir)
    return links.groupBy("page_id").agg(
        F.count_if(h == F.col("host")).alias("same_host"), F.count_if((h == base) | h.endswith(F.concat(F.lit("."), base))).alias("same_domain"), F.count_if(R.is_blocked_link(F.col("href"))).alias("n_blocked")
    )


_EXTRA = (
    "https://a.com/tag/x", "https://a.com/page/2", "https://a.com/x.PDF", "https://a.com/ok", "https://stats.g.doubleclick.net/r", "https://a.com/ads/1", "https://cdn.com/banner-1.png", "https://www.hotjar.com/x",
    "https://x.ads.com/", "https://a.com/login", "https://shop.squarespace.com/", "",
)


@query(
    "WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest([" + ", ".join(f"'{u}'" for u in _EXTRA) + "])) SELECT url, regexp_matches(lower(url), '/tag/|/category/|/author/|/page/|\\.xml|\\.pdf|\\.jpg|\\.png') AS excluded, "
    "regexp_matches(lower(url), 'login|signup|register|signin|password|reset|auth|logout') AS blocked, regexp_matches(lower(url), '" + "|".join(d.replace(".", "\\.") for d in R.AD_DOMAINS) + "|" + "|".join(R.AD_URL_PATTERNS) + "') AS ad, "
    "regexp_matches(lower(url), '" + "|".join(d.replace(".", "\\.") for d in R.AD_DOMAINS + R.TRACKER_DOMAINS) + "|" + "|".join(R.AD_URL_PATTERNS) + "') AS tracker, regexp_matches(lower(url), '" + "|".join(R.JS_URL_WORDS) + "') AS browser, count(*) AS n FROM u GROUP BY ALL"
)
def url_filters(spark, sf_dir):
    u = F.col("url")
    urls = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(x,) for x in _EXTRA], "url string"))
    flags = urls.select("url", R.is_excluded(u).alias("excluded"), R.is_blocked_link(u).alias("blocked"), R.is_ad_url(u).alias("ad"), R.is_ad_url(u, trackers=True).alias("tracker"), R.needs_browser(u).alias("browser"))
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


_EDGES = """edges AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT -1 - l_suppkey, l_partkey FROM lineitem)"""


def _edges(spark, sf_dir):
    """Parts and their suppliers linked both ways; a supplier's node is its number below zero."""
    one = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
    return one.unionAll(one.select("dst", "src"))


@query(f"WITH {_EDGES}, ends AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends GROUP BY node")
def link_graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def bfs_reachability(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")), 3)


@query(f"""WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3), best AS (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node)
SELECT node, depth FROM best ORDER BY depth, node LIMIT 100""")
def crawl_first_pages(spark, sf_dir):
    return graph.crawl(_edges(spark, sf_dir), spark.range(1, 2).select(F.col("id").alias("node")), 3, 100)


def _when_rules(column: str, groups) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in patterns) + f"') THEN '{name}'" for name, patterns in groups)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def _first_words(column: str, groups, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{k}'" for k, w in groups) + f" ELSE '{other}' END"


@query(f"""WITH {RULE_PAGES}, t AS (SELECT *, lower(coalesce(html, '')) || ' ' || coalesce(status, 200) || ' ' || lower(coalesce(headers, '')) || ' ' || lower(coalesce(error, '')) AS x FROM rule_pages),
k AS (SELECT *, CASE {_when_rules('x', [(n, p) for n, _, p in R.PROBLEM_PATTERNS])} WHEN status >= 400 THEN 'http_error' WHEN coalesce(error, '') <> '' THEN 'request_error' WHEN length(coalesce(html, '')) < 500 AND lower(coalesce(html, '')) LIKE '%<html%' THEN 'minimal_content' END AS problem_type FROM t)
SELECT id, problem_type, CASE problem_type {' '.join(f"WHEN '{n}' THEN '{s}'" for n, s, _ in R.PROBLEM_PATTERNS)} WHEN 'http_error' THEN CASE WHEN status < 500 THEN 'high' ELSE 'medium' END WHEN 'request_error' THEN 'medium' WHEN 'minimal_content' THEN 'low' END AS severity,
CASE problem_type WHEN 'http_error' THEN 'HTTP ' || status || ' error' WHEN 'request_error' THEN left(error, 200) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.DESCRIPTIONS.items() if k not in ('http_error', 'request_error'))} END AS description FROM k""")
def problem_classify(spark, sf_dir):
    p = R.problem(F.col("html"), F.col("status"), F.col("headers"), F.col("error"))
    return rule_pages(spark, sf_dir).select("id", p.alias("p")).select("id", "p.problem_type", "p.severity", "p.description")


@query(f"""WITH {RULE_PAGES}, t AS (SELECT *, lower(coalesce(html, '')) AS x FROM rule_pages) SELECT id, {_first_words('x', R.QUICK_RULES, 'unknown')} AS quick, {_first_words('x', R.CAPTCHA_TYPES, 'none')} AS captcha,
{_any('x', R.BLOCK_WORDS)} AS blocked, (coalesce(html, '') = '' OR {_any('x', R.CHALLENGE_PAGE)}) AS challenged, {_any('x', R.JS_HTML_WORDS)} AS js FROM t""")
def page_flags(spark, sf_dir):
    h = F.col("html")
    return rule_pages(spark, sf_dir).select("id", R.quick_problem(h).alias("quick"), R.captcha_type(h).alias("captcha"), R.is_blocked(h).alias("blocked"), R.is_challenge_page(h).alias("challenged"), R.has_js_markers(h).alias("js"))


@query(f"""WITH {RULE_PAGES}, t AS (SELECT *, lower(coalesce(html, '')) AS x FROM rule_pages) SELECT id, {', '.join(f"{_any('x', w)} AS {k}" for k, w in R.CHALLENGES.items())}, length(coalesce(html, '')) < 1000 AS empty,
{', '.join(f"{_any('x', w)} AS s_{k}" for k, w in R.STATUS_CHALLENGES.items() if k != 'antibot')}, (coalesce(status IN (403, 429), NULL) OR {_any('x', R.STATUS_CHALLENGES['antibot'])}) AS s_antibot,
((x LIKE '%captcha%' OR x LIKE '%verify%') AND x LIKE '%human%') AS s_captcha, status = 429 AS s_rate_limited FROM t""")
def challenge_flags(spark, sf_dir):
    first = R.challenge_flags(F.col("html"), F.lit(""))
    second = R.status_challenge_flags(F.col("html"), F.lit(""), F.col("status"))
    return rule_pages(spark, sf_dir).select("id", *[c.alias(k) for k, c in first.items()], *[c.alias(f"s_{k}") for k, c in second.items() if k in ("cloudflare", "antibot", "captcha", "rate_limited")])


@query(f"""WITH {RULE_PAGES}, t AS (SELECT id, lower(coalesce(html, '')) AS x FROM rule_pages), f AS (SELECT id, {', '.join(f"{_any('x', w)} AS {k}" for k, w in R.CHALLENGES.items())} FROM t)
SELECT id, CASE WHEN cloudflare THEN 'ua_rotate' WHEN antibot THEN 'proxy_rotate' WHEN captcha THEN 'wait_retry' WHEN lazy_load THEN 'scroll_pattern' END AS method FROM f""")
def next_technique(spark, sf_dir):
    flags = R.challenge_flags(F.col("html"), F.lit(""))
    ordered = {k: flags[k] for k in ("cloudflare", "antibot", "captcha", "lazy_load")}
    return rule_pages(spark, sf_dir).select("id", R.next_method(ordered, F.lit("playwright_stealth")).alias("method"))


@query(
    "SELECT * FROM (VALUES (1::BIGINT, 'fetch', 'https://a.com/api/v1/items?p=1&q=2', 'rest', 'p,q'), (1, 'axios.get', 'https://b.com/g', 'rest', ''), (1, '.get', 'https://b.com/g', 'rest', ''), (1, 'endpoint', 'https://a.com/rel/path', 'rest', ''), (1, '/api/', 'https://a.com/api/v1/items?p=1&q=2', 'rest', 'p,q')) t(page_id, rule, endpoint, api_type, params)"
)
def api_endpoints(spark, sf_dir):
    """Endpoint patterns over a fixture page and all pages: five hits a pattern, longer than three characters."""
    fixture = spark.createDataFrame([(1, "https://a.com/x", 'fetch("/api/v1/items?p=1&q=2"); axios.get("https://b.com/g"); x = {endpoint: "rel/path"}')], "page_id long, url string, html string")
    pages = fixture.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("page_id"), "url", "html"))
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.slice(F.regexp_extract_all("html", F.lit(f"(?i){p}"), F.lit(g)), 1, 5).alias("found")) for n, p, g in R.HTML_API_PATTERNS])
    rows = pages.select("page_id", "url", F.explode(hits).alias("h")).select("page_id", "url", "h.rule", F.explode("h.found").alias("hit"))
    rows = rows.where(F.length("hit") > 3).withColumn("hit", F.trim(F.col("hit"), F.lit('"')))
    kind = F.when(F.lower("hit").contains("graphql"), "graphql").otherwise("rest")
    return rows.select("page_id", "rule", S.absolute_url(F.col("url"), F.col("hit")).alias("endpoint"), kind.alias("api_type"), F.array_join(S.query_names(F.col("hit")), ",").alias("params"))


@query("SELECT * FROM (VALUES (1::BIGINT, '/api/', 'https://a.com/api/items'), (1, '/v/', 'https://a.com/v2/list'), (1, 'absolute', 'https://b.com/api/'), (1, 'baseURL', 'https://a.com/root'), (1, 'endpoint', 'https://a.com/e')) t(id, rule, endpoint)")
def script_endpoints(spark, sf_dir):
    """The patterns for script files, over a fixture file and the scripts within all pages: three hits a pattern."""
    script = """a("/api/items"); b('/v2/list'); c="https://b.com/api/"; baseURL = "/root"; endpoint: '/e'"""
    files = spark.createDataFrame([(1, "https://a.com/app.js", script)], "id long, url string, body string")
    files = files.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "url", F.col("html").alias("body")))
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.slice(F.regexp_extract_all("body", F.lit(f"(?i){p}"), F.lit(g)), 1, 3).alias("found")) for n, p, g in R.SCRIPT_API_PATTERNS])
    rows = files.select("id", "url", F.explode(hits).alias("h")).select("id", "url", "h.rule", F.explode("h.found").alias("hit"))
    return rows.select("id", "rule", S.absolute_url(F.col("url"), F.col("hit")).alias("endpoint"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || g AS endpoint FROM pages, (SELECT unnest(['/api', '/api/v1', '/graphql', '/rest', '/wp-json/wp/v2', '/feed.json']) AS g)""")
def guessed_endpoints(spark, sf_dir):
    root = F.concat(S.scheme(F.col("url")), F.lit("://"), S.netloc(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", root.alias("root"), F.explode(F.array(*[F.lit(g) for g in R.GUESSED_ENDPOINTS])).alias("g")).select("page_id", F.concat("root", "g").alias("endpoint"))


LOCATIONS = (
    # fixed values
    ("us-east", "US", "New York", 40.7128, -74.0060, "America/New_York"), ("us-west", "US", "Los Angeles", 34.0522, -118.2437, "America/Los_Angeles"), ("uk", "GB", "London", 51.5074, -0.1278, "Europe/London"),
    ("de", "DE", "Frankfurt", 50.1109, 8.6821, "Europe/Berlin"), ("fr", "FR", "Paris", 48.8566, 2.3522, "Europe/Paris"), ("jp", "JP", "Tokyo", 35.6762, 139.6503, "Asia/Tokyo"),
    ("sg", "SG", "Singapore", 1.3521, 103.8198, "Asia/Singapore"), ("au", "AU", "Sydney", -33.8688, 151.2093, "Australia/Sydney"), ("br", "BR", "São Paulo", -23.5505, -46.6333, "America/Sao_Paulo"),
    ("ca", "CA", "Toronto", 43.6532, -79.3832, "America/Toronto"), ("in", "IN", "Mumbai", 19.0760, 72.8777, "Asia/Kolkata"),
)


@query("WITH l(code, country, city, latitude, longitude, timezone) AS (VALUES " + ", ".join(str(x) for x in LOCATIONS) + ") SELECT page_id, code, country, city, timezone, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude FROM pages, l")
def url_locations(spark, sf_dir):
    """Each page with each of eleven fixed locations; the list is a literal, so nothing is joined."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("code", "country", "city", "latitude", "longitude", "timezone"), x)]) for x in LOCATIONS])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(rows).alias("l")).select("page_id", "l.code", "l.country", "l.city", "l.timezone", "l.latitude", "l.longitude")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), w AS (SELECT host, max(score) AS score FROM (SELECT host, (page_id % 10) * 10 + page_id % 3 AS score FROM p) WHERE score > 0 GROUP BY host),
best AS (SELECT host, min(page_id) AS workflow FROM (SELECT p.host, p.page_id, (p.page_id % 10) * 10 + p.page_id % 3 AS score FROM p) x WHERE score > 0 AND score = (SELECT score FROM w WHERE w.host = x.host) GROUP BY host)
SELECT p.page_id, best.workflow FROM p LEFT JOIN best USING (host)""")
def workflow_for_url(spark, sf_dir):
    """The workflow with the best positive score of the url's host; ties to the smaller id."""
    p = table(spark, sf_dir, "pages").select("page_id", S.netloc(F.col("url")).alias("host"))
    scored = p.withColumn("score", F.pmod("page_id", F.lit(10)) * 10 + F.pmod("page_id", F.lit(3))).where("score > 0")
    best = scored.groupBy("host").agg(F.max_by("page_id", F.struct("score", (-F.col("page_id")).alias("i"))).alias("workflow"))
    return p.join(best, "host", "left").select("page_id", "workflow")


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM p) SELECT page_id, host, rank::INT AS rank FROM r WHERE rank <= 5""")
def preview_per_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", S.netloc(F.col("url")).alias("host"))
    return stats.last_n(p, ["host"], [F.col("page_id")], 5)


@query(r"""WITH p AS (SELECT page_id, ['cloudflare', 'captcha', 'rate_limited'][(page_id % 3 + 1)::INT] AS kind, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter([kind, CASE WHEN len(string_split(host, '.')) >= 2 THEN string_split(host, '.')[-2] END, 'checking', 'your', 'browser', 'cf', 'ray'], lambda x: x IS NOT NULL))), ',') AS keywords,
kind || ',' || kind || '_' || left(md5(host), 8) || CASE WHEN path <> '' THEN ',' || kind || '_' || left(md5(path), 8) ELSE '' END AS signatures FROM p""")
def problem_keys(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("cloudflare"), F.lit("captcha"), F.lit("rate_limited")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    host, path = S.netloc(F.col("url")), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    evidence = F.array(F.lit("checking your browser now"), F.lit("cf-.*ray"))
    words = R.problem_keywords(kind, host, evidence)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(words), ",").alias("keywords"), F.array_join(R.problem_signatures(kind, host, path), ",").alias("signatures"))


_SITEMAPS = """pairs AS (SELECT '/index-' || (page_id // 50) AS parent, '/leaf-' || (page_id // 10) AS child FROM pages UNION SELECT '/index-' || (page_id // 50), '/index-' || (page_id // 50 + CASE WHEN page_id // 50 % 2 = 0 THEN 1 ELSE -1 END) FROM pages),
there AS (SELECT DISTINCT parent AS sitemap FROM pairs UNION SELECT DISTINCT '/leaf-' || (page_id // 10) FROM pages)"""


def _stored_sitemaps(spark, sf_dir):
    """A sitemap for every ten pages, an index for every five of them; indexes list each other by twos, in a circle, the
    last one perhaps one that isn't stored."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    leaf, index = F.floor(F.col("page_id") / 10), F.floor(F.col("page_id") / 50)
    loc = lambda url: F.concat(F.lit("<loc>"), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    address = lambda kind, n: F.concat(F.lit(f"https://maps.example.com/{kind}-"), n.cast("string"))
    leaves = p.groupBy(leaf.alias("n")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url>"), loc(F.col("url")), F.lit("</url>")))).alias("body"))
    leaves = leaves.select(address("leaf", F.col("n")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    other = F.col("n") + F.when(F.col("n") % 2 == 0, 1).otherwise(-1)
    children = p.select(index.alias("n"), F.concat(F.lit("/leaf-"), leaf.cast("string")).alias("child")).distinct().groupBy("n").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<sitemap>"), loc(F.col("child")), F.lit("</sitemap>")))).alias("body"))
    back = F.concat(F.lit("<sitemap>"), loc(address("index", other)), F.lit("</sitemap>"))
    return leaves.unionAll(children.select(address("index", F.col("n")), F.concat(F.lit("<sitemapindex>"), "body", back, F.lit("</sitemapindex>"))))


@query(f"""WITH RECURSIVE {_SITEMAPS}, walk(sitemap, depth) AS (SELECT sitemap, 0 FROM there WHERE sitemap LIKE '/index-%' AND split_part(sitemap, '-', 2)::INT % 2 = 0 UNION SELECT child, depth + 1 FROM walk JOIN pairs ON parent = sitemap WHERE depth < 5),
best AS (SELECT sitemap, min(depth) AS depth FROM walk GROUP BY sitemap)
SELECT DISTINCT 'https://maps.example.com' || sitemap AS sitemap, depth, url FROM best JOIN pages ON sitemap = '/leaf-' || (page_id // 10)""")
def sitemap_index_urls(spark, sf_dir):
    """The pages that every second index leads to, through indexes that list each other."""
    stored = _stored_sitemaps(spark, sf_dir)
    even = stored.where("url LIKE '%/index-%' AND cast(split_part(url, '-', 2) AS int) % 2 = 0")
    return discovery.resolve_sitemaps(stored, even.select("url")).select("sitemap", "depth", "url")


_AS_PAGE = "regexp_extract({0}, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN rtrim(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/') END"
_SITE_PAGES = rf"""p AS (SELECT page_id, url, regexp_extract(url, '://[^/?#]*\.([^./?#]+\.[^./?#]+)([/?#]|$)', 1) AS site, {_AS_PAGE.format('url')} AS page,
  [regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h FOR h IN regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)] AS own FROM pages),
linked AS (SELECT p.page_id, p.site, p.page, p.url, list_transform(p.own || [x FOR x IN [a.url, b.url, c.url] IF x IS NOT NULL], lambda x: {_AS_PAGE.format('x')}) AS outs
  FROM p LEFT JOIN p a ON a.page_id = 2 * p.page_id + 1 LEFT JOIN p b ON b.page_id = 2 * p.page_id + 2 LEFT JOIN p c ON c.page_id = p.page_id + 1),
stored AS (SELECT page, arg_min(outs, url) AS outs FROM linked GROUP BY page),
links AS (SELECT page, unnest(outs) AS link, unnest(range(len(outs))) AS pos FROM stored),
starts AS (SELECT site, arg_min(page, page_id) AS start FROM p GROUP BY site),
seeds AS (SELECT DISTINCT site, page AS url FROM (SELECT * FROM p WHERE page_id % 7 = 3 QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id, page) <= 5))"""


def _site_pages(spark, sf_dir):
    """Pages with links to three other pages by number, and sites by the last two labels of their hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", S.base_domain(S.netloc(F.col("url"))).alias("site"))
    linked = p
    for i, n in enumerate((2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2, F.col("page_id") + 1)):
        other = p.select(F.col("page_id").alias("__n"), F.concat(F.lit('<a href="'), "url", F.lit('">x</a>')).alias(f"a{i}"))
        linked = linked.join(other, n == F.col("__n"), "left").drop("__n")
    return linked.select("page_id", "url", "site", F.concat_ws("", "html", "a0", "a1", "a2").alias("html"))


def site_map_parts(spark, sf_dir):
    pages = _site_pages(spark, sf_dir)
    starts = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    return pages.select("url", "html"), starts, pages.where("page_id % 7 = 3").select("site", "url", F.col("page_id").alias("place"))


@query(rf"""WITH RECURSIVE {_SITE_PAGES}, q(site, start, found, queue, depths, done, round) AS (
  SELECT site, start, coalesce((SELECT list(url) FROM seeds WHERE seeds.site = starts.site), []) AS found, [start], [0], 0, 0 FROM starts
  UNION ALL SELECT q.site, q.start, found || coalesce(urls, []), queue || coalesce(goes, []), depths || coalesce(deep, []), least(q.done + 10, len(queue)), round + 1
  FROM q LEFT JOIN (
    SELECT site, round AS r, list(link ORDER BY rank, pos) AS urls, list(link ORDER BY rank, pos) FILTER (depth < 3 AND link <> start) AS goes, list(depth + 1 ORDER BY rank, pos) FILTER (depth < 3 AND link <> start) AS deep FROM (
      SELECT x.site, x.round, x.start, l.link, min(x.rank) AS rank, arg_min(l.pos, (x.rank, l.pos)) AS pos, arg_min(x.depth, (x.rank, l.pos)) AS depth
      FROM (SELECT site, round, start, found, unnest(queue[done + 1 : done + 10]) AS page, unnest(range(done, least(done + 10, len(queue)))) AS rank, unnest(depths[done + 1 : done + 10]) AS depth FROM q WHERE len(found) < 60) x
      JOIN links l ON l.page = x.page WHERE regexp_extract(l.link, '://[^/?#]*\.([^./?#]+\.[^./?#]+)([/?#]|$)', 1) = x.site AND NOT list_contains(x.found, l.link) GROUP BY x.site, x.round, x.start, l.link) GROUP BY site, round) n ON n.site = q.site AND n.r = q.round
  WHERE len(found) < 60 AND len(queue) > q.done)
SELECT site, unnest(found) AS url FROM q QUALIFY row_number() OVER (PARTITION BY site ORDER BY round DESC) = 1""")
def site_maps(spark, sf_dir):
    """A map of every site: at most five sitemap urls that aren't expanded, links on the site's hosts, no further pages
    once 60 urls are found."""
    pages, starts, seeds = site_map_parts(spark, sf_dir)
    return discovery.site_maps(pages, starts, seeds, max_urls=60, max_seeds=5, subdomains=True).select("site", "url")


def _rule_table(spark):
    """The engine's rules, written as a table and read from it."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rules-{uuid.uuid4().hex}"
    spark.createDataFrame(patterns.default_rules(), patterns.SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@query(SQL["problem_classify"])
def problem_classify_by_table(spark, sf_dir):
    """The rules of a table, in one pass over each page."""
    hits = patterns.rule_hits(spark, _rule_table(spark), ["problem"])
    html, error, status = F.coalesce("html", F.lit("")), F.coalesce("error", F.lit("")), F.col("status")
    text = F.concat_ws(" ", F.lower(html), F.coalesce(status, F.lit(200)).cast("string"), F.lower(F.coalesce("headers", F.lit(""))), F.lower(error))
    rows = rule_pages(spark, sf_dir).withColumn("hits", hits(text))
    other = F.when(status >= 400, "http_error").when(error != "", "request_error").when((F.length(html) < 500) & F.lower(html).contains("<html"), "minimal_content")
    rows = rows.withColumn("problem_type", F.coalesce(patterns.first_hit(F.col("hits"), "problem"), other))
    named = lambda pairs: F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), F.col("problem_type"))
    kind = F.col("problem_type")
    level = F.when(kind == "http_error", F.when(status < 500, "high").otherwise("medium")).when(kind.isNotNull(), named([(n, s) for n, s, _ in R.PROBLEM_PATTERNS] + [("request_error", "medium"), ("minimal_content", "low")]))
    said = F.when(kind == "http_error", F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" error"))).when(kind == "request_error", F.left("error", F.lit(200))).when(kind.isNotNull(), named(list(R.DESCRIPTIONS.items())))
    return rows.select("id", "problem_type", level.alias("severity"), said.alias("description"))


@query(SQL["page_flags"])
def page_flags_by_table(spark, sf_dir):
    hits = patterns.rule_hits(spark, _rule_table(spark), ["quick", "captcha", "blocked", "challenged", "js"])
    html = F.coalesce("html", F.lit(""))
    rows, h = rule_pages(spark, sf_dir).select("id", (html == "").alias("empty"), hits(F.lower(html)).alias("hits")), F.col("hits")
    return rows.select(
        "id", F.coalesce(patterns.first_hit(h, "quick"), F.lit("unknown")).alias("quick"), F.coalesce(patterns.first_hit(h, "captcha"), F.lit("none")).alias("captcha"), patterns.any_hit(h, "blocked").alias("blocked"),
        (F.col("empty") | patterns.any_hit(h, "challenged")).alias("challenged"), patterns.any_hit(h, "js").alias("js"),
    )


@query(SQL["url_filters"])
def url_filters_by_table(spark, sf_dir):
    hits = patterns.rule_hits(spark, _rule_table(spark), ["excluded", "blocked_link", "ad", "tracker", "browser"])
    urls = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame([(x,) for x in _EXTRA], "url string"))
    rows, h = urls.groupBy("url").agg(F.count("*").alias("n")).select("url", "n", hits(F.lower("url")).alias("hits")), F.col("hits")
    flag = lambda name, *sets: patterns.any_hit(h, *sets).alias(name)
    return rows.select("url", flag("excluded", "excluded"), flag("blocked", "blocked_link"), flag("ad", "ad"), flag("tracker", "ad", "tracker"), flag("browser", "browser"), "n")
