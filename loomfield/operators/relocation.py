"""Tracked elements found again in another version of a table of pages, by joins over an index of elements.

The index has a row for each element of the new version: its number in the page, the hash of its text and the classes
above it.  Tracked elements meet it on page and text hash; the ways to find one are ranked, and the best way of each
is a partially aggregated minimum.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.extract import _ancestor_classes, flat_map, text_hash
from loomfield.operators.html_tree import parse

STRATEGIES = ("selector", "position", "parent", "text")
_TRACKED = "selector string, digest string, place int, classes array<string>"


def track_elements(pages: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """(key, selector, digest, place, classes) of each page's first element for the selector: the hash of its text, its
    number in the page, the classes of its ancestors from the nearest on."""

    def run(html, url):
        root = parse(html)
        n = root.find(selector)
        if n is None:
            return []
        place = next(i for i, x in enumerate(root.walk()) if x is n)
        return [(selector, text_hash(n.text(strip=False)), place, _ancestor_classes(n))]

    return flat_map(pages, run, _TRACKED, keep=key)


def element_index(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, place, digest, above) of every element: number, text hash, and all its ancestors' classes, each once."""

    def run(html, url):
        root, out, above = parse(html), [], {}
        above[id(root)] = ()
        for i, n in enumerate(root.walk()):
            inherited = above[id(n.parent)]
            above[id(n)] = tuple(dict.fromkeys((*inherited, *n.classes)))
            out.append((i, text_hash(n.text(strip=False)), list(inherited)))
        return out

    return flat_map(pages, run, "place int, digest string, above array<string>", keep=key)


def relocate_elements(tracked: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, selector, strategy, place) of every tracked element: how it was found in the page's new version and its
    number there, nulls if it wasn't.

    By its selector; by its number in the page, if the text agrees; below an element with one of its ancestors'
    classes (the nearest class first) by its text; by its text alone; the first in the page of equal ones.  A page
    that isn't in the new version has nothing.  pages: key, url, html; tracked: track_elements() of the old one."""
    tracked = tracked.select(key, *[c.split()[0] for c in _TRACKED.split(", ")])
    named = pages.join(tracked.groupBy(key).agg(F.to_json(F.collect_set("selector")).alias("__selectors")), key)

    def by_selector(html, selectors):
        root, out = parse(html), []
        numbers = {id(n): i for i, n in enumerate(root.walk())}
        for s in json.loads(selectors):
            n = root.find(s)
            if n is not None:
                out.append((s, numbers[id(n)]))
        return out

    first = flat_map(named.select(key, "html", F.col("__selectors").alias("url")), by_selector, "selector string, found int", keep=key)
    none = F.lit(0)
    ways = tracked.join(first, [key, "selector"]).select(key, "selector", F.struct(none.alias("way"), none.alias("nth"), F.col("found").alias("place")).alias("at"))
    index = element_index(pages.join(tracked.select(key).distinct(), key, "left_semi"), key).select(key, "digest", F.col("place").alias("found"), "above")
    hits = tracked.join(index, [key, "digest"])
    nth = F.array_min(F.transform(F.filter("classes", lambda c: F.array_contains("above", c)), lambda c: F.array_position("classes", c).cast("int")))
    way = F.when(F.col("found") == F.col("place"), 1).when(nth.isNotNull(), 2).otherwise(3)
    rank = F.when(way == 2, nth).otherwise(0)
    ways = ways.unionAll(hits.select(key, "selector", F.struct(way.alias("way"), rank.alias("nth"), F.col("found").alias("place")).alias("at")))
    best = ways.groupBy(key, "selector").agg(F.min("at").alias("at"))
    found = tracked.select(key, "selector").join(best, [key, "selector"], "left")
    name = F.coalesce(*[F.when(F.col("at.way") == i, s) for i, s in enumerate(STRATEGIES)])
    return found.select(key, "selector", name.alias("strategy"), F.col("at.place").alias("place"))
