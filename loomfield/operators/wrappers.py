"""Selectors learned from the structure of a site's pages.

A site's pages share a template: the tree of paths of tags and classes that most of them have.  Each page gives its
different paths once, with how often and how closely they repeat and which texts they hold; counted by host and path
they are the branches of that tree.  Paths that few pages have are pruned, paths whose elements stand in runs of
siblings are containers of records, and paths with texts that differ are fields, of a container or of the page.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators.extract import flat_map
from loomfield.operators.html_tree import Node, parse

#: Parts of a host's pages that must have a path, and of the pages with a path that must repeat it or have text there.
SUPPORT, SHARE = 0.5, 0.5
STEP = " > "
_IGNORED = frozenset("head script style noscript template".split())


def _step(n: Node) -> str:
    return n.tag + "".join(f".{c}" for c in sorted(set(n.classes)) if c.replace("-", "").replace("_", "").isalnum() and not c[0].isdigit())


def page_paths(html: str, url: str = "") -> list[tuple]:
    """(path, elements, longest run of siblings, elements with text of their own, least and greatest digest of those
    texts) of each different path of a page."""
    found: dict[str, list] = {}
    work = [(parse(html), "")]
    while work:
        parent, above = work.pop()
        before, run = None, 0
        for n in (c for c in parent.children if isinstance(c, Node)):
            if n.tag in _IGNORED:
                continue
            step = _step(n)
            path = above + STEP + step if above else step
            run = run + 1 if step == before else 1
            before = step
            at = found.setdefault(path, [0, 0, 0, None, None])
            at[0], at[1] = at[0] + 1, max(at[1], run)
            text = " ".join(t for c in n.children if isinstance(c, str) and (t := c.strip()))
            if text:
                digest = hashlib.md5(text.encode("utf-8", "replace")).hexdigest()
                at[2] += 1
                at[3], at[4] = min(at[3] or digest, digest), max(at[4] or digest, digest)
            work.append((n, path))
    return [(path, *at) for path, at in found.items()]


def path_tree(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages, n_repeating, n_with_text, varies, site_pages) of pages (url, html).  Pages without a host
    or text belong to no site.  Counts are combined before the shuffle, so a host with a third of all pages is a row a
    path and task."""
    own = pages.select("url", "html", S.netloc(F.col("url")).alias("host")).where("host <> '' AND html IS NOT NULL")
    paths = flat_map(own, page_paths, "path string, n int, run int, n_text int, low string, high string", keep="host")
    tree = paths.groupBy("host", "path").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("run") > 1).alias("n_repeating"), F.count_if(F.col("n_text") > 0).alias("n_with_text"), (F.min("low") != F.max("high")).alias("varies")
    )
    return tree.join(own.groupBy("host").agg(F.count("*").alias("site_pages")), "host")


def host_selectors(pages: DataFrame, support: float = SUPPORT, share: float = SHARE, least_pages: int = 2) -> DataFrame:
    """(host, role, container, selector, n_pages, site_pages): one set of selectors for each host with ``least_pages``.

    Role container: the outermost paths that repeat as siblings in ``share`` of the pages that have them; role field:
    paths whose own texts differ, in ``share`` of their pages.  A field's selector is one below its container, from
    the page's top if it has none.  Paths are in ``support`` of the host's pages at least; a path's pages have all
    paths above it, so that nothing is kept below what is pruned."""
    tree = path_tree(pages).where((F.col("site_pages") >= least_pages) & (F.col("n_pages") >= support * F.col("site_pages")))
    parts = F.split("path", STEP)
    tree = tree.withColumn("above", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), STEP)))
    repeats = tree.where(F.col("n_repeating") >= share * F.col("n_pages")).select("host", F.col("path").alias("container"))
    # of the repeating paths on the way to a path, itself included, the first is its container
    held = tree.select("host", "path", F.posexplode("above").alias("depth", "container")).join(repeats, ["host", "container"])
    held = held.groupBy("host", "path").agg(F.min_by("container", "depth").alias("container"))
    rows = tree.join(held, ["host", "path"], "left")
    role = F.when(F.col("container") == F.col("path"), "container").when((F.col("n_with_text") >= share * F.col("n_pages")) & F.col("varies"), "field")
    text = F.col("n_with_text") >= share * F.col("n_pages")
    out = rows.withColumn("role", role).where("role IS NOT NULL").withColumn("text", text & F.coalesce("varies", F.lit(False)))
    below = F.when(F.col("container").isNull() | (F.col("role") == "container"), F.col("path")).otherwise(F.substring("path", F.length("container") + F.lit(len(STEP) + 1), F.length("path")))
    return out.select("host", "role", F.when(F.col("role") == "field", F.col("container")).alias("container"), below.alias("selector"), "text", "n_pages", "site_pages")
