"""Link graphs: edges, degrees, and breadth-first reach with depth and page bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import ensure_checkpoint_dir

HREF = r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of all anchors, by one expression; for pages whose anchors are plain tags."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of edges src, dst."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the fewest steps from any start node, up to max_depth; start nodes have depth 0.

    The frontier holds nodes not seen before only; its lineage is cut every round, so a deep search
    doesn't recompute its past."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst").checkpoint()  # read in every round
    seen = start.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def crawl(edges: DataFrame, start: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """(node, depth) of the first max_pages nodes by depth, then name."""
    return reach(edges, start, max_depth).orderBy("depth", "node").limit(max_pages)


def crawl_in_steps(edges: DataFrame, start: DataFrame, path: str, max_depth: int, max_pages: int, steps: int | None = None) -> tuple[DataFrame, bool]:
    """(node, depth) reached so far, and whether the crawl has ended; ``steps`` levels at most are added by this
    call, all if None.  Each level is a table under ``path``, in a folder that all executors share, so that a
    crawl which was paused, or whose driver was lost, goes on with the next call where it stopped."""
    spark = edges.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda depth: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/level={depth}/_SUCCESS"))
    schema = "node " + dict(start.dtypes)["node"] + ", depth int"
    level = lambda depth: spark.read.schema(schema).parquet(f"{path}/level={depth}")
    if not there(0):
        start.select("node", F.lit(0).alias("depth")).distinct().write.mode("overwrite").parquet(f"{path}/level=0")
    depth = 0
    while there(depth + 1):
        depth += 1
    seen = level(0)
    for d in range(1, depth + 1):
        seen = seen.unionAll(level(d))
    added = 0
    while depth < max_depth and (steps is None or added < steps):
        if level(depth).isEmpty() or seen.limit(max_pages).count() >= max_pages:
            return seen.orderBy("depth", "node").limit(max_pages), True
        step = level(depth).select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        depth, added = depth + 1, added + 1
        step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")).write.mode("overwrite").parquet(f"{path}/level={depth}")
        seen = seen.unionAll(level(depth))
    ended = depth >= max_depth or level(depth).isEmpty() or seen.limit(max_pages).count() >= max_pages
    return seen.orderBy("depth", "node").limit(max_pages), ended
