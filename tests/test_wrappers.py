from collections import defaultdict

import pandas as pd

from loomfield.operators import wrappers as W
from loomfield.operators.html_tree import Node, parse


def plain(pages, support=0.5, share=0.5, least=2):
    """One host after the other, page by page."""
    out, hosts = [], defaultdict(list)
    for url, html in pages:
        host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0] if url and "://" in url else ""
        if host and html is not None:
            hosts[host].append(html)

    def steps(n):
        trail = []
        while n.parent is not None:
            trail.append(W._step(n))
            n = n.parent
        return tuple(reversed(trail))

    for host, htmls in hosts.items():
        have, repeat, text, texts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
        for html in htmls:
            here, runs, spoken = set(), set(), set()
            nodes = [n for n in parse(html).walk() if not any(a.tag in W._IGNORED for a in [n, *up(n)])]
            for n in nodes:
                p = steps(n)
                here.add(p)
                kin = [c for c in n.parent.children if isinstance(c, Node) and c.tag not in W._IGNORED]
                at = next(i for i, c in enumerate(kin) if c is n)
                if at and W._step(kin[at - 1]) == W._step(n):
                    runs.add(p)
                own = " ".join(t for c in n.children if isinstance(c, str) and (t := c.strip()))
                if own:
                    spoken.add(p)
                    texts[p].add(own)
            for s, d in ((here, have), (runs, repeat), (spoken, text)):
                for p in s:
                    d[p] += 1
        if len(htmls) < least:
            continue
        kept = [p for p in have if have[p] >= support * len(htmls)]
        containers = {p for p in kept if repeat[p] >= share * have[p]}
        for p in kept:
            box = next((p[:i] for i in range(1, len(p) + 1) if p[:i] in containers), None)
            field = text[p] >= share * have[p] and len(texts[p]) > 1
            if box == p:
                out.append((host, "container", None, " > ".join(p), field, have[p], len(htmls)))
            elif field:
                out.append((host, "field", " > ".join(box) if box else None, " > ".join(p[len(box or ()) :]), True, have[p], len(htmls)))
    return sorted(out, key=repr)


def up(n):
    while n.parent is not None:
        n = n.parent
        yield n


def shop(i):
    items = "".join(f'<li class="item"><b>Lamp {i}{k}</b><span class="x price">{k} USD</span></li>' for k in range(i + 1))
    return f"<html><head><title>t</title></head><body><h1>Page {i}</h1><p class='note'>same</p><ul>{items}</ul><div><div><i>{i}</i></div><div><i>z</i></div></div></body></html>"


def test_selectors_of_a_shop(spark):
    pages = [(f"http://shop.com/{i}", shop(i)) for i in range(4)] + [("http://one.com/", shop(3)), (None, "<p>x</p>"), ("http://shop.com/none", None), ("nohost", "<p>x</p>")]
    df = spark.createDataFrame(pages, "url string, html string").selectExpr("*", "1 as host", "'p' as path")
    rows = [tuple(r) for r in W.host_selectors(df).collect()]
    assert sorted(rows, key=repr) == plain(pages)
    assert ("shop.com", "container", None, "html > body > ul > li.item", False, 4, 4) in rows
    assert ("shop.com", "field", "html > body > ul > li.item", "span.price.x", True, 4, 4) in rows and ("shop.com", "field", None, "html > body > h1", True, 4, 4) in rows
    assert not any("note" in r[3] for r in rows) and {r[0] for r in rows} == {"shop.com"}


def test_selectors_of_the_given_pages(spark):
    sf = "/root/testdata/sf0.001/pages.parquet"
    pages = pd.read_parquet(sf)
    got = W.host_selectors(spark.read.parquet(sf)).collect()
    assert got and sorted(map(tuple, got), key=repr) == plain(list(zip(pages.url, pages.html)))
    by = {r.host: r for r in got if r.role == "field" and r.container is None}
    hits = 0
    for url, html in zip(pages.url, pages.html):
        r = by.get(url.split("://")[1].split("/")[0].split("?")[0].split("#")[0])
        hits += bool(r and parse(html).select(r.selector))
    assert hits >= len(by) / 2  # selectors select


def test_no_pages(spark):
    assert W.host_selectors(spark.createDataFrame([], "url string, html string")).collect() == []
