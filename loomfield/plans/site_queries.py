"""Records of known sites over a few fixture pages together with all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.operators import extract as X
from loomfield.operators import sites, wrappers
from loomfield.plans.registry import query
from loomfield.plans.views import table

SERP = """<div class="g"><a href="https://a.com/1"><h3>First</h3></a><cite>a.com</cite><div class="VwiC3b">About one</div><span aria-label="rating">Rated 4.5</span></div>
<div class="g"><a href="/relative"><h3>No link</h3></a></div><div class="related-question"><div class="related-question-pair__Question">Why so?</div><div class="related-question-pair__Snippet">Because.</div></div>
<div id="knowledge-panel"><div class="kno-ecr-pt">Lamp</div><div class="kno-rdesc">Gives light</div></div>"""
SHOP = """<span id="productTitle"> Desk  lamp </span><span class="a-price"><span class="a-offscreen">$1,299.50</span></span><span class="a-text-price"><span class="a-offscreen">$1,500</span></span>
<i class="a-icon-star"><span class="a-icon-alt">4.6 out of 5 stars</span></i><span id="acrCustomerReviewText">1,234 ratings</span><div id="availability"><span>In Stock.</span></div><a id="bylineInfoFeature">Brand: Lux</a>
<div id="feature-bullets"><ul><li>Bright</li><li>{x}</li><li>Cheap</li></ul></div><div id="altImages"><img src="/a.png"><img src="/sprite.png"></div><ul class="a-breadcrumb"><li>Home</li><li>Lamps</li></ul>"""
RESULTS = """<div data-component-type="s-search-result"><h2><a href="/x/dp/B000000001/r">Bulb</a></h2><span class="a-price-whole">12</span><span class="a-price-fraction">50</span><i class="a-icon-star"><span class="a-icon-alt">3.9 out of 5</span></i></div>
<div data-component-type="s-search-result"><h2><a href="/none">Ad</a></h2></div>"""
AUCTION = """<li class="s-item"><div class="s-item__title">Old lamp</div><span class="s-item__price">$20.00</span><a class="s-item__link" href="https://e.com/1">x</a></li><li class="s-item"><div class="s-item__title">No price</div></li>"""
FORUM = """<div class="thing" data-id="t1" data-subreddit="lamps" data-author="ann" data-timestamp="99"><a class="title" href="https://b.com/x">Look</a><div class="score">1,024</div><a class="comments" href="/r/lamps/1">17 comments</a></div>
<div class="thing" data-id="t2" data-subreddit="lamps" data-author="bob"><a class="title" href="/r/lamps/2">Ask</a><div class="score">•</div><span class="score">3</span><div class="usertext-body">Body text</div></div>
<div class="entry"><a class="author">cy</a><div class="md">Nice</div><span class="score">5</span></div><div class="entry"><a class="author">di</a></div>"""
POSTS = """<article><div data-testid="tweetText">Hello lamp</div><span>1,200 likes</span><span>35 reposts</span></article><article><span>4 likes</span></article>"""
AGENCIES = """<div><div class="provider__main-info"><h3><a href="/profile/x">Xco</a></h3></div><a href="https://clutch.co/q">q</a><a href="https://x.com">site</a><span class="provider-location">Oslo</span></div>"""
COMPANY = """<h1>Luxco</h1><dl><dt>Industry</dt><dd>Light</dd><dt>Company size</dt><dd>51-200</dd></dl>"""


def _pages(spark, sf_dir, html, url="https://www.amazon.com/dp/B00ABCDEF1"):
    fixture = spark.createDataFrame([(-1, url, html)], "page_id long, url string, html string")
    return fixture.unionByName(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("""SELECT * FROM (VALUES (-1::BIGINT, 'search_result', 'First', 'https://a.com/1', 'a.com', 'About one', 4.5::DOUBLE, NULL, NULL, NULL), (-1, 'people_also_ask', NULL, NULL, NULL, NULL, NULL, 'Why so?', 'Because.', NULL), (-1, 'knowledge_graph', 'Lamp', NULL, NULL, NULL, NULL, NULL, NULL, 'Gives light'))
t(page_id, type, title, url, displayed_url, snippet, rating, question, answer, description)""")
def search_result_pages(spark, sf_dir):
    return sites.search_page(_pages(spark, sf_dir, SERP))


@query("""SELECT -1::BIGINT AS page_id, 'B00ABCDEF1' AS sku, 'Desk lamp' AS name, 1299.5::DOUBLE AS price, 1500.0::DOUBLE AS original_price, 'USD' AS currency, 'Bright | Cheap' AS description, 'Home > Lamps' AS category, 'Lux' AS brand, 'in_stock' AS availability, 4.6::DOUBLE AS rating, 1234::BIGINT AS review_count, '/a.png' AS images""")
def shop_product_pages(spark, sf_dir):
    got = sites.records(_pages(spark, sf_dir, SHOP), sites.SITES["amazon_product"]).where("name <> ''").withColumn("images", F.array_join("images", ","))
    return got.select("page_id", "sku", "name", "price", "original_price", "currency", "description", "category", "brand", "availability", "rating", "review_count", "images")


@query("""SELECT * FROM (VALUES (-1::BIGINT, 'amazon', 'Bulb', 12.5::DOUBLE, 'https://www.amazon.com/dp/B000000001'), (-1, 'ebay', 'Old lamp', 20.0, 'https://e.com/1')) t(page_id, source, name, price, url)""")
def shop_search_pages(spark, sf_dir):
    pages, columns = _pages(spark, sf_dir, RESULTS + AUCTION), ("page_id", "source", "name", "price", "url")
    return sites.records(pages, sites.SITES["amazon_search"]).select(*columns).unionByName(sites.records(pages, sites.SITES["ebay_search"]).select(*columns))


@query("""SELECT * FROM (VALUES (-1::BIGINT, 't1', 'Look', 'ann', 1024::BIGINT, 17::BIGINT, 'https://old.reddit.com/r/lamps/1', false, ''), (-1, 't2', 'Ask', 'bob', 3, 0, '', true, 'Body text')) t(page_id, id, title, author, score, num_comments, permalink, is_self, selftext)""")
def forum_posts(spark, sf_dir):
    got = sites.records(_pages(spark, sf_dir, FORUM), sites.SITES["forum_post"])
    return got.select("page_id", "id", "title", "author", "score", "num_comments", "permalink", "is_self", "selftext")


@query("SELECT -1::BIGINT AS page_id, 'cy' AS author, 'Nice' AS body, 5::BIGINT AS score")
def forum_comments(spark, sf_dir):
    return sites.comments(_pages(spark, sf_dir, FORUM))


@query("SELECT -1::BIGINT AS page_id, 'Hello lamp' AS text, 1200::BIGINT AS likes, 35::BIGINT AS retweets")
def social_posts(spark, sf_dir):
    return sites.records(_pages(spark, sf_dir, POSTS), sites.SITES["short_post"])


@query("SELECT -1::BIGINT AS page_id, 'Xco' AS name, 'https://clutch.co/profile/x' AS profile_url, 'https://x.com' AS website, 'Oslo' AS location, NULL::VARCHAR AS min_project_size")
def agency_pages(spark, sf_dir):
    return sites.records(_pages(spark, sf_dir, AGENCIES), sites.SITES["agency"])


@query("""SELECT -1::BIGINT AS page_id, 'Luxco' AS name, 'Light' AS industry, '51-200' AS size UNION ALL SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '', '' FROM pages""")
def company_pages(spark, sf_dir):
    return X.flat_map(_pages(spark, sf_dir, COMPANY), sites.company, "name string, industry string, size string")


@query("""SELECT page_id, NULL::VARCHAR AS title, NULL::VARCHAR AS image FROM pages UNION ALL SELECT -1, 'Card title', '/og.png'""")
def social_previews(spark, sf_dir):
    html = """<meta property="og:title" content=""><meta name="twitter:title" content="Card title"><meta property="og:image" content="/og.png"><meta name="twitter:image" content="/tw.png">"""
    meta = X.flat_map(_pages(spark, sf_dir, html), X.metadata, X.META_FIELDS.replace(", title string,", ", page_title string,"))
    return X.social_preview(meta.withColumnRenamed("page_title", "title")).select("page_id", "title", "image")


@query("""SELECT -1::BIGINT AS page_id, '#lamp' AS topic, 'https://s.com/hashtag/lamp' AS topic_url""")
def trending_topics(spark, sf_dir):
    pages = _pages(spark, sf_dir, "<a href='/hashtag/lamp'>#lamp</a><a href='/x'>x</a>", "https://s.com/")
    return X.flat_map(pages, lambda h, u: X.trending(h, u), "topic string, topic_url string")


@query("""SELECT page_id, 'h1' AS title, CASE WHEN regexp_matches(html, '<p[ >]') THEN 'p' END AS description, CASE WHEN regexp_matches(html, '<a\\s[^>]*href') THEN 'a[href]' END AS url FROM pages""")
def guessed_selectors(spark, sf_dir):
    def run(h, u):
        got = X.detect_selectors(h)
        return [(got.get("title"), got.get("description"), got.get("url"))]

    return X.flat_map(table(spark, sf_dir, "pages").select("page_id", "url", "html"), run, "title string, description string, url string")


@query()
def host_selectors(spark, sf_dir):
    """Containers and fields of every host's pages by the tree of their paths; tests compare with a plain version."""
    return wrappers.host_selectors(table(spark, sf_dir, "pages"))
