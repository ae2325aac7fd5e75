import random

from loomfield.operators import discovery


def crawl(pages, start, seeds, max_urls, max_depth, batch, max_seeds):
    """One site, one page after the other: found urls, and the number of links looked at."""
    found, order = set(seeds[:max_seeds]), [(u, "sitemap", None) for u in dict.fromkeys(seeds[:max_seeds])]
    queue, visited, looked = [(start, 0)], set(), 0
    while queue and len(found) < max_urls:
        due = []
        while queue and len(due) < batch:
            url, depth = queue.pop(0)
            if url not in visited:
                visited.add(url)
                if depth <= max_depth:
                    due.append((url, depth))
        for url, depth in due:
            for link in pages.get(url, []):
                looked += 1
                if link.split("/")[2] == start.split("/")[2] and link not in found:
                    found.add(link)
                    order.append((link, "link", depth))
                    queue.append((link, depth + 1))
    return order, looked


def site(rnd, host, n):
    urls = [f"http://{host}/p{i}" for i in range(n)]
    return {u: [rnd.choice([*urls, "http://other.org/x"]) for _ in range(rnd.randint(0, 5))] for u in urls}


def tables(spark, sites, seeds):
    rows = [(u, "".join(f'<a href="{x}">t</a>' for x in outs) + '<a href="#top">t</a><a href="">t</a><a href="mailto:a@b.c">t</a>') for pages in sites.values() for u, outs in pages.items()]
    pages = spark.createDataFrame([*rows, (None, "<a href='http://a.com/n'>"), ("http://b.com/none", None)], "url string, html string").selectExpr("*", "1 as site", "2 as rank")
    starts = spark.createDataFrame([(h, f"http://{h}/p0") for h in sites] + [("bad", "nonsense")], "site string, url string")
    listed = spark.createDataFrame([(h, u, i) for h, us in seeds.items() for i, u in enumerate(us)] or [("bad", "x", 1)], "site string, url string, place int")
    return pages, starts, listed


def test_site_maps_against_a_crawl_page_by_page(spark):
    rnd = random.Random(5)
    sites = {h: site(rnd, h, n) for h, n in (("a.com", 40), ("b.com", 20), ("c.com", 1))}
    seeds = {"a.com": [f"http://a.com/p{i}" for i in (7, 7, 9, 33)] + ["http://elsewhere.org/z"], "c.com": ["http://c.com/s"]}
    args = tables(spark, sites, seeds)
    for max_urls, max_depth, batch in ((20, 3, 5), (1000, 3, 12)):
        got = discovery.site_maps(*args, max_urls=max_urls, max_depth=max_depth, batch=batch, max_seeds=4)
        want = {(h, *x) for h, pages in sites.items() for x in crawl(pages, f"http://{h}/p0", seeds.get(h, []), max_urls, max_depth, batch, 4)[0]}
        rows = [tuple(r) for r in got.select("site", "url", "kind", "depth").collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_a_bound_spares_links(spark, monkeypatch):
    """Pages beyond the bound aren't looked at: the links that are read fall with it."""
    rnd = random.Random(6)
    sites = {"a.com": site(rnd, "a.com", 150)}
    args = tables(spark, sites, {})
    read = {}
    real = discovery.F.posexplode
    for bound in (10, 60, 1000):
        acc = spark.sparkContext.accumulator(0)
        udf = discovery.F.udf(lambda outs: acc.add(len(outs)) or outs, "array<string>")
        monkeypatch.setattr(discovery.F, "posexplode", lambda c: real(udf(c)))
        discovery.site_maps(*args, max_urls=bound, max_depth=20, batch=25).collect()
        read[bound] = acc.value
    assert 0 < read[10] < read[60] < read[1000]


def test_sitemaps_in_a_circle(spark):
    index = lambda *c: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in c) + "</sitemapindex>"
    stored = [("http://a/1", index("http://a/2", "/3", "http://a/lost")), ("http://a/2", index("http://a/1", "http://a/3")), ("http://a/3", "<urlset><url><loc>/x</loc><priority>0.5</priority></url><url><loc>http://a/y</loc></url></urlset>"), ("http://a/4", "<urlset><url><loc>http://a/never</loc></url></urlset>"), ("http://a/5", "no xml"), (None, None)]
    df = spark.createDataFrame(stored * 2, "url string, xml string")
    got = lambda *roots, **kw: {(r.sitemap, r.depth, r.url) for r in discovery.resolve_sitemaps(df, spark.createDataFrame([(x,) for x in roots], "url string"), **kw).collect()}
    assert got("http://a/1", "http://a/5", None) == {("http://a/3", 1, "http://a/x"), ("http://a/3", 1, "http://a/y")}
    assert got("http://a/2", max_depth=0) == set() and got("http://a/3", max_depth=0) == {("http://a/3", 0, "http://a/x"), ("http://a/3", 0, "http://a/y")}
    assert got() == set()
