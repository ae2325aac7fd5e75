"""Records of known sites: search results, shops, forums, social networks and directories.

A site is a container selector and named fields; a field says which element holds it and which part of that
element is its value.  One Arrow pass gives raw strings, and the values (prices, ratings, counts) are then
normalised by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators.extract import flat_map
from loomfield.operators.html_tree import Node, parse


@dataclass(frozen=True)
class Field:
    """What of the first element that ``css`` finds is the value: its stripped text, or an attribute.  Without
    ``css`` it's the container's own.  many: of all elements, joined by ``many``; where: which values count."""

    css: str = ""
    attr: str | None = None
    many: str | None = None
    where: Callable[[str], bool] | None = None
    parent: bool = False


@dataclass(frozen=True)
class Site:
    """needs: fields without which a container gives no record; keep: which records count, by their fields; most:
    containers that are looked at; finish: column -> expression over the raw fields, in the order of the
    result's columns."""

    container: str | None
    fields: Mapping[str, Field]
    needs: tuple[str, ...] = ()
    keep: Callable[[Mapping[str, str | None]], bool] | None = None
    most: int | None = None
    finish: Mapping[str, Column | Callable[[], Column]] = field(default_factory=dict)


def _values(n: Node, f: Field) -> list[str]:
    top = n.parent if f.parent and n.parent is not None else n
    found = top.select(f.css) if f.css else [n]
    values = [x.get(f.attr) if f.attr else x.text() for x in found if f.attr is None or f.attr in x.attrs]
    return [v for v in values if f.where is None or f.where(v)]


def read(html: str, url: str, site: Site) -> list[tuple]:
    """A tuple per record: the fields in order, null where nothing is found."""
    root, out = parse(html), []
    for n in (root.select(site.container) if site.container else [root])[: site.most]:
        row = {}
        for name, f in site.fields.items():
            got = _values(n, f)
            row[name] = (f.many.join(got) if f.many is not None else got[0]) if got else None
        if all(row[k] is not None for k in site.needs) and (site.keep is None or site.keep(row)):
            out.append(tuple(row.values()))
    return out


def records(pages: DataFrame, site: Site) -> DataFrame:
    """page_id and the site's finished columns, or its raw fields where it has none to finish.  pages: page_id,
    url, html."""
    raw = flat_map(pages, lambda h, u: [(u, *r) for r in read(h, u, site)], "page_url string, " + ", ".join(f"`{f}` string" for f in site.fields))
    if not site.finish:
        return raw.drop("page_url")
    return raw.select("page_id", *[(c() if callable(c) else c).alias(k) for k, c in site.finish.items()])


# ---- expressions over raw fields


def _text(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name), F.lit(""))


def _amount(name: str) -> Callable[[], Column]:
    return lambda: S.price(F.coalesce(F.col(name), F.lit("")))["amount"]


def _currency(name: str) -> Callable[[], Column]:
    return lambda: S.price(F.coalesce(F.col(name), F.lit("")))["currency"]


def _number(name: str, pattern: str = r"([0-9]+)") -> Callable[[], Column]:
    return lambda: F.coalesce(F.regexp_extract(F.regexp_replace(F.col(name), ",", ""), pattern, 1).try_cast("long"), F.lit(0).cast("long"))


def _found(name: str, pattern: str) -> Callable[[], Column]:
    return lambda: F.regexp_extract(F.coalesce(F.col(name), F.lit("")), pattern, 1)


ASIN = r"/dp/([A-Z0-9]{10})"
#: Text that only a country's name makes a location.
COUNTRIES = ("usa", "uk", "india", "canada")


def _price_of_parts() -> Column:
    whole = F.concat(F.lit("$"), F.col("whole"), F.lit("."), F.coalesce(F.col("cents"), F.lit("00")))
    return S.price(F.when(F.col("whole").isNotNull(), whole).otherwise(""))["amount"]


def _absolute(root: str, name: str) -> Callable[[], Column]:
    return lambda: F.when(F.col(name).isNotNull(), F.concat(F.lit(root), F.col(name))).otherwise("")


SITES: dict[str, Site] = {
    # selectors are fixed values
    "search_result": Site(
        ".g, [data-ved], .yuRUbf",
        {"title": Field("h3, [role='heading']"), "url": Field("a[href]", "href"), "displayed_url": Field(".tjvcx, .CSkcDe, cite"), "snippet": Field(".VwiC3b, .IsZvec, [data-sncf], .st"), "rating": Field(".lzcfc, [aria-label*='rating']")},
        ("title", "url"),
        lambda r: r["url"].startswith("http"),
        finish={
            "title": _text("title"), "url": _text("url"), "displayed_url": _text("displayed_url"), "snippet": _text("snippet"),
            "rating": lambda: F.regexp_extract(F.coalesce(F.col("rating"), F.lit("")), r"([0-9]+\.?[0-9]*)", 1).try_cast("double"),
        },
    ),
    "people_also_ask": Site(".wQiwMc, [data-q], .related-question", {"question": Field(".related-question-pair__Question, .wQiwMc"), "answer": Field(".related-question-pair__Snippet")}, ("question",), finish={"question": _text("question"), "answer": _text("answer")}),
    "knowledge_graph": Site("[data-kboxid], .kp-wholepage, #knowledge-panel", {"title": Field("[data-ved], .kno-ecr-pt, .SPZz6b"), "description": Field(".kno-rdesc, .aCOpRe")}, most=1, finish={"title": _text("title"), "description": _text("description")}),
    "amazon_product": Site(
        None,
        {
            "name": Field("#productTitle"), "price": Field(".a-price .a-offscreen, #priceblock_ourprice, #priceblock_dealprice"), "list_price": Field(".a-text-price .a-offscreen, #listPrice"),
            "rating": Field(".a-icon-star .a-icon-alt"), "reviews": Field("#acrCustomerReviewText"), "availability": Field("#availability span"), "brand": Field("#bylineInfoFeature"), "description": Field("#productDescription p"),
            "features": Field("#feature-bullets li", many=" | ", where=lambda t: bool(t) and "{" not in t), "images": Field("#altImages img, #imgTagWrapperId img", "src", many="\n", where=lambda t: bool(t) and "sprite" not in t),
            "category": Field(".a-breadcrumb li", many=" > "),
        },
        finish={
            "sku": _found("page_url", ASIN), "name": lambda: S.clean_text(F.col("name")), "price": _amount("price"), "original_price": _amount("list_price"), "currency": _currency("price"),
            "description": lambda: F.coalesce(F.col("features"), S.clean_text(F.col("description"))), "category": _text("category"), "brand": lambda: F.replace(F.coalesce(F.col("brand"), F.lit("")), F.lit("Brand: "), F.lit("")),
            "availability": lambda: F.when(F.col("availability").isNotNull(), S.availability(F.col("availability"))).otherwise(""), "rating": lambda: S.rating(F.col("rating")), "review_count": lambda: S.review_count(F.coalesce(F.col("reviews"), F.lit(""))),
            "images": lambda: F.coalesce(F.split("images", "\n"), F.array().cast("array<string>")), "url": lambda: F.col("page_url"), "source": lambda: F.lit("amazon"),
        },
    ),
    "amazon_search": Site(
        "[data-component-type='s-search-result']",
        {
            "href": Field("h2 a", "href"), "name": Field("h2 a"), "whole": Field(".a-price-whole"), "cents": Field(".a-price-fraction"), "rating": Field(".a-icon-star .a-icon-alt"), "reviews": Field("span.a-size-small .a-size-base"),
            "image": Field(".s-image", "src"), "availability": Field("[aria-label]", "aria-label"),
        },
        ("href",),
        lambda r: re.search(ASIN, r["href"]) is not None,
        finish={
            "sku": _found("href", ASIN), "name": _text("name"), "price": _price_of_parts, "rating": lambda: S.rating(F.col("rating")), "review_count": lambda: S.review_count(F.coalesce(F.col("reviews"), F.lit(""))), "image": _text("image"),
            "availability": lambda: F.when(F.col("availability").isNotNull(), S.availability(F.col("availability"))).otherwise(""), "url": lambda: F.concat(F.lit("https://www.amazon.com/dp/"), F.regexp_extract("href", ASIN, 1)), "source": lambda: F.lit("amazon"),
        },
    ),
    "ebay_product": Site(None, {"name": Field(".x-item-title__mainTitle span"), "price": Field(".x-price-primary span")}, finish={"name": lambda: S.clean_text(F.col("name")), "price": _amount("price"), "currency": _currency("price"), "url": lambda: F.col("page_url"), "source": lambda: F.lit("ebay")}),
    "ebay_search": Site(".s-item", {"name": Field(".s-item__title"), "price": Field(".s-item__price"), "url": Field(".s-item__link", "href")}, ("name", "price"), finish={"name": _text("name"), "price": _amount("price"), "currency": _currency("price"), "url": _text("url"), "source": lambda: F.lit("ebay")}),
    "forum_post": Site(
        "div.thing",
        {
            "id": Field(attr="data-id"), "subreddit": Field(attr="data-subreddit"), "author": Field(attr="data-author"), "created_utc": Field(attr="data-timestamp"), "title": Field("a.title"), "url": Field("a.title", "href"), "score": Field("div.score"),
            "second_score": Field("span.score"), "comments": Field("a.comments"), "permalink": Field("a.comments", "href"), "selftext": Field("div.usertext-body"),
        },
        finish={
            **{k: _text(k) for k in ("id", "subreddit", "title", "author")}, "score": lambda: F.coalesce(F.regexp_replace(F.when(F.col("score") == "•", F.col("second_score")).otherwise(F.col("score")), ",", "").try_cast("long"), F.lit(0).cast("long")),
            "num_comments": _number("comments"), "url": _text("url"), "permalink": _absolute("https://old.reddit.com", "permalink"), "is_self": lambda: ~F.coalesce(F.col("url"), F.lit("")).startswith("http"),
            "selftext": lambda: F.when(F.coalesce(F.col("url"), F.lit("")).startswith("http"), "").otherwise(F.coalesce("selftext", F.lit(""))), "created_utc": _text("created_utc"),
        },
    ),
    "forum_comment": Site(
        "div.entry", {"author": Field("a.author"), "body": Field("div.md"), "score": Field("span.score")}, ("body",), lambda r: r["body"] != "",
        finish={"author": _text("author"), "body": _text("body"), "score": lambda: F.coalesce(F.regexp_replace("score", ",", "").try_cast("long"), F.lit(0).cast("long"))},
    ),
    "short_post": Site(
        "article", {"text": Field("div[data-testid='tweetText']"), "likes": Field("span", where=lambda t: t.endswith("likes")), "reposts": Field("span", where=lambda t: t.endswith("reposts"))}, ("text",), lambda r: r["text"] != "",
        finish={"text": _text("text"), "likes": _number("likes"), "retweets": _number("reposts")},
    ),
    "short_profile": Site(None, {"data": Field("script", many="\n", where=lambda t: "User" in t and "following" in t)}, finish={"followers": _number("data", r'"followersCount":([0-9]+)'), "following": _number("data", r'"followingCount":([0-9]+)')}),
    "work_profile": Site(
        None, {"name": Field("h1"), "headline": Field("div.text-body-medium"), "location": Field("span[class*='tvm__text']", where=lambda t: any(c in t.lower() for c in COUNTRIES))},
        finish={"name": _text("name"), "headline": _text("headline"), "location": _text("location")},
    ),
    "work_experience": Site("section#experience li", {"title": Field("h3"), "company": Field("p")}, ("title",), lambda r: r["title"] != "", finish={"title": _text("title"), "company": _text("company")}),
    "work_job": Site(
        "div.job-card-container", {"title": Field("h3"), "href": Field("a.job-card-container__link", "href"), "location": Field("span", where=lambda t: "," in t and len(t) < 50)}, ("title",), lambda r: r["title"] != "",
        finish={"title": _text("title"), "location": _text("location"), "url": _absolute("https://linkedin.com", "href")},
    ),
    "agency": Site(
        ".provider__main-info",
        {"name": Field("h3 a"), "href": Field("h3 a", "href"), "website": Field("a", "href", where=lambda t: "clutch" not in t and t.startswith("http"), parent=True), "location": Field("[class*='location']", parent=True), "min_project_size": Field("[class*='min-project']", parent=True)},
        ("name",),
        lambda r: r["name"] != "",
        finish={"name": _text("name"), "profile_url": lambda: F.when(F.col("href").startswith("/"), F.concat(F.lit("https://clutch.co"), "href")).otherwise(F.coalesce("href", F.lit(""))), "website": lambda: F.col("website"), "location": lambda: F.col("location"), "min_project_size": lambda: F.col("min_project_size")},
    ),
    "tool": Site(
        "article, .item, [class*='product'], [class*='tool']", {"name": Field("h1, h2, h3, h4, .title, [class*='title']"), "description": Field("p, .description, [class*='desc']"), "href": Field("a[href]", "href")}, ("name",), lambda r: r["name"] != "",
        finish={"name": _text("name"), "description": _text("description"), "website": lambda: F.when(F.col("href").startswith("http"), F.col("href")).otherwise("")},
    ),
}
#: Comments of a page that count.
COMMENTS = 50


def knowledge_attributes(html: str, url: str = "") -> list[tuple]:
    """(label, value) pairs of a page's knowledge panel; the last value of a label counts."""
    out = {}
    for panel in parse(html).select("[data-kboxid], .kp-wholepage, #knowledge-panel")[:1]:
        for n in panel.select(".w8qArf, .kyLfmc"):
            label, value = n.find(".w8qArf, .kyLfmc"), n.find(".rVSkhe")
            if label and value:
                out[label.text()] = value.text()
    return list(out.items())


def company(html: str, url: str = "") -> list[tuple]:
    """(name, industry, size) of a company page, from its heading and the terms of its lists."""
    root, held = parse(html), {}
    for term in root.select("dt"):
        siblings = [c for c in term.parent.children if isinstance(c, Node)]
        after = siblings[next(i for i, c in enumerate(siblings) if c is term) + 1 :]
        value = next((c.text() for c in after if c.tag == "dd"), None)
        for key, word in (("industry", "industry"), ("size", "company size")):
            if value is not None and word in term.text().lower():
                held[key] = value
    name = root.find("h1")
    return [(name.text() if name else "", held.get("industry", ""), held.get("size", ""))]


def search_page(pages: DataFrame) -> DataFrame:
    """Results, questions and knowledge panels of search pages as one table with a type column."""
    parts = [records(pages, SITES[k]).withColumn("type", F.lit(k)) for k in ("search_result", "people_also_ask", "knowledge_graph")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def comments(pages: DataFrame, most: int = COMMENTS) -> DataFrame:
    """The first ``most`` comments of each page."""
    site = SITES["forum_comment"]
    raw = flat_map(pages, lambda h, u: read(h, u, site)[:most], ", ".join(f"`{f}` string" for f in site.fields))
    return raw.select("page_id", *[c().alias(k) for k, c in site.finish.items()])
