"""Discovery of a site's urls: sitemap indexes followed to their end, and site maps of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import scalar as S
from loomfield.operators.graph import HREF
from loomfield.session import ensure_checkpoint_dir
from loomfield.sources.readers import sitemap_rows


def resolve_sitemaps(stored: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(sitemap, depth, url, lastmod, lastmod_date, changefreq, priority): the page entries of every sitemap that the
    roots reach through sitemap indexes, with the fewest steps from a root.

    stored: url, xml.  roots: url.  Relative entries are resolved against their sitemap.  Indexes may list each other
    in circles, a sitemap is read once; children that aren't stored, and sitemaps that can't be parsed, have no
    entries; rows of one url are read as one sitemap.  Rounds are as many as the indexes are deep."""
    ensure_checkpoint_dir(stored.sparkSession)
    rows = sitemap_rows(stored.select(F.col("url").alias("sitemap"), "xml"), "xml", ("sitemap",))
    rows = rows.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(S.absolute_url(F.col("sitemap"), F.col("url")))).distinct().checkpoint()
    children = rows.where("type = 'sitemap'").select("sitemap", F.col("url").alias("child"))
    seen = frontier = roots.select(F.col("url").alias("sitemap")).where("sitemap IS NOT NULL").distinct().withColumn("depth", F.lit(0)).checkpoint()
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(children, "sitemap").select(F.col("child").alias("sitemap")).distinct()
        frontier = step.join(seen.select("sitemap"), "sitemap", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        seen = seen.unionAll(frontier)
    return seen.join(rows.where("type = 'url'").drop("type"), "sitemap").select("sitemap", "depth", "url", "lastmod", "lastmod_date", "changefreq", "priority")


def page_outs(pages: DataFrame) -> DataFrame:
    """(page, outs) of pages (url, html): normalised url, and normalised targets of its anchors in order."""
    found = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda h: (h != "") & ~h.startswith("#"))
    outs = F.array_compact(F.transform(found, lambda h: S.normalize_page_url(S.absolute_url(F.col("url"), h))))
    rows = pages.where("url IS NOT NULL").select(S.normalize_page_url(F.col("url")).alias("page"), "url", outs.alias("outs")).where("page IS NOT NULL")
    # of stored urls that normalise to the same page the first counts
    return rows.groupBy("page").agg(F.min_by("outs", "url").alias("outs"))


def site_maps(
    pages: DataFrame, starts: DataFrame, seeds: DataFrame | None = None, max_urls: int = 1000, max_depth: int = 3, batch: int = 10, max_seeds: int = 100, subdomains: bool = False
) -> DataFrame:
    """(site, url, kind, depth) of the urls found for each site: ``max_seeds`` of its sitemap's urls (kind sitemap,
    depth null), which are found and not expanded, and the links of expanded pages (kind link, depth of the page).

    pages: url, html.  starts: site, url, one a site.  seeds: site, url, place (order in the sitemap).  Each site's
    queue begins with its start, which itself is found only if it's linked.  A round expands every site's next
    ``batch`` pages, in the order they were found, down to ``max_depth``; a site whose found urls have reached
    ``max_urls`` expands no further, so later pages are never looked at.  Links count on the start's host, or with
    ``subdomains`` on hosts of its last two labels.

    Sites are expanded side by side; a round joins the few pages due with the pages' links, and what is written is
    the found urls alone.  Pages of other hosts are left out before."""
    ensure_checkpoint_dir(pages.sparkSession)
    area = S.base_domain if subdomains else (lambda host: host)
    starts = starts.select("site", S.normalize_page_url(F.col("url")).alias("start")).where("start IS NOT NULL").withColumn("area", area(S.netloc(F.col("start")))).checkpoint()
    own = pages.withColumn("area", area(S.netloc(F.col("url")))).join(starts.select("area").distinct(), "area", "left_semi")
    outs = page_outs(own.select("url", "html")).checkpoint()

    found = starts.select("site", F.col("start").alias("url"), F.lit("start").alias("kind"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank"))
    if seeds is not None:
        first = seeds.select("site", S.normalize_page_url(F.col("url")).alias("url"), "place").where("url IS NOT NULL")
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))).where(F.col("nth") <= max_seeds)
        first = first.join(starts.select("site"), "site", "left_semi").select("site", "url", F.lit("sitemap").alias("kind"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("rank")).distinct()
        found = found.unionAll(first)
    found = found.checkpoint()  # rank: place in the site's queue, null for what isn't expanded
    width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    progress = starts.select("site", F.lit(0).cast("long").alias("done"))
    while True:
        sites = found.groupBy("site").agg(F.count_if(F.col("kind") != "start").alias("n"), F.max("rank").alias("queued")).join(progress, "site")
        active = sites.where((F.col("n") < max_urls) & (F.col("queued") > F.col("done"))).select("site", "queued", "done", F.least(F.col("done") + batch, "queued").alias("until")).checkpoint()
        if active.isEmpty():
            break
        due = found.join(active, "site").where((F.col("rank") > F.col("done")) & (F.col("rank") <= F.col("until"))).select("site", "url", "depth", "rank", "queued")
        links = due.join(outs, due["url"] == outs["page"]).select("site", "depth", "rank", "queued", F.posexplode("outs").alias("pos", "link"))
        links = links.join(starts, "site").where(area(S.netloc(F.col("link"))) == F.col("area"))
        new = links.groupBy("site", F.col("link").alias("url")).agg(F.min(F.struct("rank", "pos", "depth", "queued", "start")).alias("at"))
        new = new.join(found.where("kind <> 'start'").select("site", "url"), ["site", "url"], "left_anti")
        new = new.select("site", "url", F.lit("link").alias("kind"), "at.*")
        # the start is found like others when it's linked, and not expanded again
        goes_on = (F.col("depth") < max_depth) & (F.col("url") != F.col("start"))
        place = F.row_number().over(Window.partitionBy("site", goes_on).orderBy("rank", "pos"))
        new = new.withColumn("place", F.when(goes_on, F.col("queued") + place))
        found = found.unionAll(new.select("site", "url", "kind", (F.col("depth") + 1).alias("depth"), F.col("place").alias("rank"))).coalesce(width).checkpoint()
        progress = active.select("site", F.col("until").alias("done"))
    return found.where("kind <> 'start'").select("site", "url", "kind", F.when(F.col("kind") == "link", F.col("depth") - 1).alias("depth"))
