"""HTML extraction over pages, with a fixture page that has what the synthetic ones lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import rules
from loomfield.operators import extract as X
from loomfield.operators.html_tree import parse, xpath
from loomfield.operators import records, relocation
from loomfield.plans.registry import query
from loomfield.plans.views import table
from loomfield.sources import documents, readers

FIXTURE = """<html><head><title>Shop</title><meta property="og:title" content="Shop"><meta property="og:image" content="/a.png"><meta property="og:image" content="/b.png">
<meta name="twitter:card" content="summary"><script type="application/ld+json">{"@type": ["Thing", "Product"], "name": "Lamp"}</script></head><body>
<div class="product"><h2>Lamp</h2><span class="price">$1,299.00</span><a href="lamp?id=1">see the lamp here</a><img src="lamp.png" alt="A very bright lamp" width="40"></div>
<div class="product"><h2>Desk</h2><a href="/desk.pdf">data sheet</a></div><div class="ad-slot"><script src="https://x.doubleclick.net/a.js"></script></div>
<video src="v.mp4"><source src="w.webm"></video><ul><li>one<li>two</ul></body></html>"""


#: The text pieces of HTML without its tags, as SQL: trimmed, none of them empty.
_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_PIECES = "list_filter(list_transform(regexp_split_to_array({}, '<[^>]*>'), lambda x: " + _UNESCAPED.format("trim(x, ' ' || chr(9) || chr(10) || chr(13))") + "), lambda x: x <> '')"
_PARAGRAPHS = "SELECT page_id, unnest(range(1, len(parts) + 1)) AS k, split_part(unnest(parts), '</p>', 1) AS s FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS parts FROM pages)"


def _pages(spark, sf_dir):
    fixture = spark.createDataFrame([(-1, "https://shop.example.com/p/", FIXTURE)], "page_id long, url string, html string")
    return fixture.unionByName(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=')) FROM pages) GROUP BY page_id UNION ALL SELECT -1, 2""")
def parsed_links(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), X.links, X.LINK_FIELDS).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT -1::BIGINT AS page_id, 'https://shop.example.com/p/lamp.png' AS url, 'A very bright lamp' AS alt, 40 AS width")
def parsed_images(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), X.images, X.IMAGE_FIELDS).select("page_id", "url", "alt", "width")


@query("SELECT -1::BIGINT AS page_id, 'https://shop.example.com/p/v.mp4' AS url, 'w.webm' AS sources")
def parsed_videos(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), X.videos, X.VIDEO_FIELDS).select("page_id", "url", F.array_join("sources", ",").alias("sources"))


@query("SELECT -1::BIGINT AS page_id, 'https://shop.example.com/desk.pdf' AS url, 'desk.pdf' AS filename, 'pdf' AS extension")
def parsed_files(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), X.files, X.FILE_FIELDS).select("page_id", "url", "filename", "extension")


@query("""SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages""")
def article_titles(spark, sf_dir):
    """The declared article spec against the regular expression that the synthetic pages allow."""
    return X.extract_pages(table(spark, sf_dir, "pages"), X.SPECS["article"]).select("page_id", "title")


@query("""SELECT -1::BIGINT AS page_id, 'Lamp' AS name, '$1,299.00' AS price, 'https://shop.example.com/p/lamp?id=1' AS url UNION ALL SELECT -1, 'Desk', NULL, 'https://shop.example.com/desk.pdf'""")
def product_records(spark, sf_dir):
    spec = X.ExtractionSpec({"name": "h2", "price": ".price", "url": "a[href]"}, container=".product")
    return X.extract_pages(_pages(spark, sf_dir), spec)


@query(f"""WITH p AS ({_PARAGRAPHS}), m AS (SELECT page_id, k, array_to_string({_PIECES.format("replace(s, '<br>', '<x>' || chr(1) || '<x>')")}, ' ') || chr(10) AS t FROM p),
b AS (SELECT page_id, string_agg(replace(t, chr(1), chr(10)), ' ' ORDER BY k) AS body FROM m WHERE t <> chr(10) GROUP BY page_id),
w AS (SELECT page_id, array_to_string({_PIECES.format("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}, ' ') || ' # ' || array_to_string({_PIECES.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, ' ') || ' ' || coalesce(body, '') AS t FROM pages LEFT JOIN b USING (page_id))
SELECT page_id, trim(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10)) AS markdown FROM w""")
def markdown_pages(spark, sf_dir):
    return X.flat_map(table(spark, sf_dir, "pages").select("page_id", "url", "html"), lambda h, u: [(X.markdown(h),)], "markdown string")


@query("""SELECT page_id, NULL::VARCHAR AS og_title, '' AS og_images, 0 AS n_ld FROM pages UNION ALL SELECT -1, 'Shop', '/a.png,/b.png', 1""")
def opengraph_pages(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), X.metadata, X.META_FIELDS).select("page_id", "og_title", F.array_join("og_images", ",").alias("og_images"), F.size("json_ld").alias("n_ld"))


@query("SELECT -1::BIGINT AS page_id, 'Thing,Product' AS type, '{\"@type\": [\"Thing\", \"Product\"], \"name\": \"Lamp\"}' AS json")
def json_ld_products(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), lambda h, u: X.json_ld(h, "Product"), "type string, json string")


@query("""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1')) FROM pages) GROUP BY page_id UNION ALL SELECT -1, 2""")
def xpath_headings(spark, sf_dir):
    rows = X.flat_map(_pages(spark, sf_dir), lambda h, u: [(t,) for t in X.select_xpath(h, "//h1 | //h2")], "text string")
    return rows.groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({_PARAGRAPHS}), e AS (SELECT page_id, 'p' AS tag, s FROM p UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages UNION ALL SELECT page_id, 'a', unnest(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1)) FROM pages),
t AS (SELECT page_id, tag, array_to_string({_PIECES.format("s")}, ' ') AS text FROM e) SELECT page_id, tag, left(text, 200) AS text FROM t WHERE length(text) > 10""")
def page_text_rows(spark, sf_dir):
    return X.flat_map(table(spark, sf_dir, "pages").select("page_id", "url", "html"), lambda h, u: X.text_rows(h), "tag string, text string")


@query("SELECT tag, count(*) AS n, count(*) AS n_css, count(*) AS n_xpaths FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def element_paths(spark, sf_dir):
    """Every element of a page has a selector and an XPath of its own."""
    rows = X.flat_map(table(spark, sf_dir, "pages").select("page_id", "url", "html"), lambda h, u: X.element_paths(h), "tag string, css string, xpath string")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("page_id", "css").alias("n_css"), F.count_distinct("page_id", "xpath").alias("n_xpaths"))


@query("""SELECT page_id, 0 AS removed, len(regexp_extract_all(html, '<a '))::INT AS n_links FROM pages UNION ALL SELECT -1, 2, 2""")
def pages_without_ads(spark, sf_dir):
    rows = X.flat_map(_pages(spark, sf_dir), lambda h, u: [X.without_ads(h)], "clean string, removed int")
    return rows.select("page_id", "removed", F.size(F.regexp_extract_all("clean", F.lit("<a "), F.lit(0))).alias("n_links"))


@query("SELECT -1::BIGINT AS page_id, 'script' AS kind, 'https://x.doubleclick.net/a.js' AS url")
def blocked_resources(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), lambda h, u: X.blocked_resources(h), "kind string, url string")


@query("SELECT page_id, 'selector' AS strategy FROM pages")
def relocated_headings(spark, sf_dir):
    """Each page's own heading, tracked and found again."""

    def run(h, u):
        t = X.track(h, "h1")
        return [(X.relocate(h, t)[0],)] if t else []

    return X.flat_map(_pages(spark, sf_dir), run, "strategy string")


_OLD = "'<article><h1>', '<article class=\"story lead\"><h1>'"
#: What changes in every fifth page: nothing, the tag, also the place, also the class above, also the text.
_CHANGES = (
    (),
    (("<h1>", "<h2>"), ("</h1>", "</h2>")),
    (("<h1>", "<i>new</i><h2>"), ("</h1>", "</h2>")),
    (("<h1>", "<i>new</i><h2>"), ("</h1>", "</h2>"), ("story lead", "tale")),
    (("<h1>", "<i>new</i><h2>changed "), ("</h1>", "</h2>"), ("story lead", "tale")),
)


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'selector' WHEN 1 THEN 'position' WHEN 2 THEN 'parent' WHEN 3 THEN 'text'
  ELSE CASE WHEN trim(lower(regexp_extract(html, '<title>([^<]*)</title>', 1))) = trim(lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1))) THEN 'text' END END AS strategy FROM pages WHERE contains(html, '<h1>')""")
def relocated_elements(spark, sf_dir):
    """Headings tracked in an old version of the pages and found again in a new one, where each fifth of the pages has
    changed further; a changed heading may still be the page's title."""
    pages = table(spark, sf_dir, "pages")
    old = pages.withColumn("html", F.expr(f"replace(html, {_OLD})"))
    html, new = F.col("html"), None
    for i, changes in enumerate(_CHANGES):
        changed = html
        for before, after in changes:
            changed = F.replace(changed, F.lit(before), F.lit(after))
        new = F.when(F.pmod("page_id", F.lit(5)) == i, changed) if new is None else new.when(F.pmod("page_id", F.lit(5)) == i, changed)
    found = relocation.relocate_elements(relocation.track_elements(old, "article.story h1"), old.withColumn("html", new))
    return found.select("page_id", "strategy")


@query("SELECT -1::BIGINT AS page_id, 'Lamp' AS title, '$1,299.00' AS price UNION ALL SELECT -1, 'Desk', NULL")
def zipped_selectors(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir), lambda h, u: X.zip_selectors(h, {"title": "h2", "price": ".price"}), "title string, price string")


@query("SELECT page_id, url, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS lastmod, (page_id % 10) / 10.0::DOUBLE AS priority, CASE WHEN page_id % 3 > 0 THEN 'daily' END AS changefreq FROM pages")
def sitemap_entries(spark, sf_dir):
    """A sitemap of each page, fields left out of every third one."""
    xml = """concat('<urlset><url><loc> ', replace(url, '&', '&amp;'), '\n</loc><lastmod>2024-01-', lpad(page_id % 28 + 1, 2, '0'), 'T10:00:00Z</lastmod><priority>0.', page_id % 10, '</priority>', if(page_id % 3 > 0, '<changefreq>daily</changefreq>', ''), '</url></urlset>')"""
    rows = readers.sitemap_rows(table(spark, sf_dir, "pages").select("page_id", F.expr(xml).alias("xml")), "xml", ("page_id",))
    return rows.select("page_id", "url", F.date_format("lastmod_date", "yyyy-MM-dd").alias("lastmod"), "priority", "changefreq")


def _suppliers_files(spark, sf_dir, make, name: str):
    """A file for each supplier; make(row) gives its bytes."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string").alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    return records.map_rows(rows, lambda r: {"path": name.format(r["s_suppkey"]), "content": make(r)}, "path string, content binary")


@query("SELECT s_suppkey::VARCHAR || '.docx' AS path, unnest(['heading', 'paragraph', 'paragraph', 'table']) AS kind, unnest([s_name, 'balance ' || round(s_acctbal, 2)::DECIMAL(12, 2), 'nation ' || s_nationkey, NULL]) AS text FROM supplier")
def docx_elements(spark, sf_dir):
    """The elements of a DOCX file for each supplier; of tables the kind alone."""
    make = lambda r: documents.make_docx([("Heading1", r["s_name"]), (None, f"balance {r['balance']}"), (None, f"nation {r['nation']}")], [[["a", "b"], ["c", r["s_name"]]]])
    rows = documents.docx_rows(_suppliers_files(spark, sf_dir, make, "{}.docx"))
    return rows.select("path", "kind", F.when(F.col("kind") != "table", F.col("text")).alias("text"))


@query("SELECT s_suppkey::VARCHAR || '.xlsx' AS path, unnest(['first', 'first', 'second']) AS sheet, unnest([0, 1, 0])::INT AS row, unnest(['name,balance', s_name || ',' || round(s_acctbal, 2)::DECIMAL(12, 2), 'nation ' || s_nationkey]) AS cells FROM supplier")
def xlsx_rows(spark, sf_dir):
    make = lambda r: documents.make_xlsx({"first": [["name", "balance"], [r["s_name"], r["balance"]]], "second": [[f"nation {r['nation']}"]]})
    rows = documents.xlsx_rows(_suppliers_files(spark, sf_dir, make, "{}.xlsx"))
    return rows.select("path", "sheet", "row", F.array_join("cells", ",").alias("cells"))


@query("SELECT s_suppkey::VARCHAR || '.docx' AS path, unnest(['title', 'creator']) AS name, unnest([s_name, 'nation ' || s_nationkey]) AS value FROM supplier")
def document_properties(spark, sf_dir):
    make = lambda r: documents.make_docx([(None, "x")], properties={"title": r["s_name"], "creator": f"nation {r['nation']}", "odd": "y"})
    return documents.docx_properties(_suppliers_files(spark, sf_dir, make, "{}.docx"))


@query("""SELECT 'f/' || s_suppkey || ['.docx', '.XLSX', '.odt', '', '.docx'][(s_suppkey % 5 + 1)::INT] AS path, ['docx', 'xlsx', 'odt', '', 'docx'][(s_suppkey % 5 + 1)::INT] AS kind, CASE WHEN s_suppkey % 5 < 2 THEN s_name END AS text, [NULL, NULL, 'unsupported format', 'unsupported format', 'BadZipFile'][(s_suppkey % 5 + 1)::INT] AS error FROM supplier""")
def document_kinds(spark, sf_dir):
    """Files of each supplier routed by extension; what can't be read is a row with an error."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def make(r):
        kind = r["s_suppkey"] % 5
        data = documents.make_docx([(None, r["s_name"])]) if kind == 0 else documents.make_xlsx({"s": [[r["s_name"]]]}) if kind == 1 else b"broken"
        return {"path": f"f/{r['s_suppkey']}" + (".docx", ".XLSX", ".odt", "", ".docx")[kind], "content": data}

    got = documents.document_texts(records.map_rows(rows, make, "path string, content binary"))
    return got.withColumn("error", F.substring_index("error", ":", 1))


@query("SELECT page_id, tag, count(*) AS n FROM (VALUES (-1::BIGINT, 'div'), (-1, 'script')) t(page_id, tag) GROUP BY ALL")
def blocked_elements(spark, sf_dir):
    """Elements that an ad blocker's simple rules hit, as one expression over all elements of all pages."""
    rows = X.flat_map(_pages(spark, sf_dir), X.elements, "tag string, class string, id string, src string")
    return rows.where(rules.is_blocked_element(F.col("class"), F.col("id"), F.col("src"))).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, len(string_split(html, '<div class=\"ad\"')) - 1 AS n_css, len(string_split(html, '<div class=\"ad\"')) - 1 AS n_xpath FROM pages")
def built_selectors(spark, sf_dir):
    """Elements like a given one, found in every page by both of its selectors."""
    like = X.alike("<div class='selected ad' id='first'>x</div>")
    css, path = like.css(), like.xpath()
    found = X.flat_map(table(spark, sf_dir, "pages").select("page_id", "url", "html"), lambda h, u: [(len((root := parse(h)).select(css)), len(xpath(root, path)))], "n_css long, n_xpath long")
    return found
