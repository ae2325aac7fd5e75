"""URL filter: given rules, then a tree of path templates per host.

Every path becomes a template: segments that are variable by their form (numbers, hex, dates, ids) turn
into wildcards.  Templates are counted per host with their labelled and bad pages, and everything after
works on these counts, not on pages.  From the leaves up, at every level where a node of the tree branches,
a node with very many literal children has its rare ones generalised to ``*``; sibling branches with equal
sub-trees, as generalised below, whose bad shares don't differ significantly are merged into ``~``.  A
template whose smoothed share of bad labels reaches ``min_bad`` is rejected.  All of it is built-in
expressions, aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, small_or_shuffled

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_FORMS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"),
    (r"^[0-9a-f]*[0-9][0-9a-f]*$", "{hex}"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or
    the end.  Both are empty for null and for urls without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: -len(r[0])):
        where, _, rest = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def _form(segment: Column) -> Column:
    """A segment's wildcard, with its extension, or the segment itself."""
    stem, ext = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    low = F.lower(stem)
    out = None
    for pattern, name in _FORMS:
        hit = low.rlike(pattern) & ((F.length(stem) >= 6) if name == "{hex}" else F.lit(True))
        out = F.when(hit, F.concat(F.lit(name), ext)) if out is None else out.when(hit, F.concat(F.lit(name), ext))
    return out.otherwise(segment)


def template(path: Column) -> Column:
    """The array of a path's segments by form; slashes without a segment between them count once."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _form)


def _prefix(level: int) -> Column:
    return F.array_join(F.slice("t", 1, level), "/")


def _set(level: int, value: Column) -> Column:
    return F.transform("t", lambda s, i: F.when(i == level, value).otherwise(s))


def branching_levels(tree: DataFrame) -> list[int]:
    """The levels at which any node has two children or more, deepest first.  There is nothing to generalise
    between them, so that a path of thousands of segments costs no more rounds than others."""
    prefix = F.transform("t", lambda _, i: F.xxhash64(F.slice("t", F.lit(1), i)))
    steps = tree.select("host", F.posexplode(F.arrays_zip(prefix.alias("prefix"), F.col("t").alias("seg"))).alias("level", "s"))
    nodes = steps.groupBy("host", "level", "s.prefix").agg(F.min("s.seg").alias("low"), F.max("s.seg").alias("high"))
    return sorted((r.level for r in nodes.where("low < high").select("level").distinct().collect()), reverse=True)


def generalise(counts: DataFrame, ws: Workspace, max_children: int = 32, rare: float = 0.05, z: float = 1.96) -> DataFrame:
    """(host, t0, t): each template t0 of a host and what it has become in the tree.

    counts: host, t0 (array), n, labelled, bad.
    """
    tree = ws.save(counts.withColumn("t", F.col("t0")))
    for level in branching_levels(tree):
        here = tree.where(F.size("t") > level).withColumn("prefix", _prefix(level)).withColumn("seg", F.element_at("t", level + 1))
        rest = F.xxhash64(F.slice("t", F.lit(level + 2), F.size("t")))
        # different remainders per branch, then one order-free mark of their set
        parts = here.groupBy("host", "prefix", "seg", rest.alias("rest")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        children = parts.groupBy("host", "prefix", "seg").agg(F.bit_xor("rest").alias("below"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        children = ws.save(children)
        nodes = children.groupBy("host", "prefix").agg(F.count("*").alias("branches"), F.sum("n").alias("all_n"))
        wide = children.join(nodes, ["host", "prefix"]).withColumn("wild", (F.col("branches") > max_children) & (F.col("n") < rare * F.col("all_n")))
        pooled = children.groupBy("host", "prefix", "below").agg(F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
        # branches are compared with those on their side of the pooled share, or one bad branch would part all others
        wide = wide.join(pooled, ["host", "prefix", "below"]).withColumn("worse", F.col("bad") * F.col("pool_labelled") > F.col("pool_bad") * F.col("labelled"))
        alike = wide.groupBy("host", "prefix", "below", "worse").agg(F.count("*").alias("like"), F.sum("labelled").alias("like_labelled"), F.sum("bad").alias("like_bad"))
        p = F.when(F.col("like_labelled") > 0, F.col("like_bad") / F.col("like_labelled")).otherwise(0.0)
        far = F.abs(F.col("bad") - F.col("labelled") * p) > z * F.sqrt(F.col("labelled") * p * (1 - p)) + 0.5
        named = wide.join(alike, ["host", "prefix", "below", "worse"]).select(
            "host", "prefix", "seg",
            F.when(F.col("wild"), F.lit("*")).when((F.col("like") > 1) & ~far & ~F.col("seg").startswith("{"), F.lit("~")).otherwise(F.col("seg")).alias("to"),
        ).where("to <> seg")
        tree_here = tree.withColumn("prefix", _prefix(level)).withColumn("seg", F.get("t", F.lit(level)))
        old = tree
        tree = ws.save(tree_here.join(named, ["host", "prefix", "seg"], "left").withColumn("t", F.when(F.col("to").isNotNull(), _set(level, F.col("to"))).otherwise(F.col("t"))).select(*old.columns))
        ws.drop(old, children)
    return tree


def judge(
    pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, min_bad: float = 0.7, weight: float = 4.0, prior: float | None = None,
    label_by_rules: bool | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of pages.

    labels: (page_id, bad 0/1); a page labelled more than once is bad if any label says so, nulls don't
    count.  Without labels the rules give them: a page that one fits is bad if it's blocked, and good if it's
    allowed, so that the templates of a host's other pages are judged by those that they are merged with;
    with ``label_by_rules`` they give them beside given labels, and a rule's word stands over a label's.  A
    template's share of bad pages is smoothed by ``weight`` pages of the share ``prior``: the overall one where
    None, with given labels, and an even one with those of rules alone, which are no sample of the pages.  Urls
    that are null or have no :// have an empty host and path and form templates of that host; repeated
    rows count each time; a null page_id has no label.  Empty tables give empty results or no labels.
    """
    ws = Workspace(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("said", verdict).withColumn("t0", template(F.col("path")))
    parsed = ws.save(parsed)
    by_rules = labels is None if label_by_rules is None else label_by_rules
    ruled = (F.col("said") == "block").cast("int")
    if labels is None:
        marked = parsed.where("said IS NOT NULL" if by_rules else "false").withColumn("bad", ruled)
    else:
        known = labels.select(labels["page_id"].cast("long").alias("page_id"), labels["bad"].cast("int").alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
        marked = parsed.join(known, "page_id", "left" if by_rules else "inner")
        if by_rules:
            marked = marked.withColumn("bad", F.coalesce(ruled, "bad")).where("bad IS NOT NULL")
    # one row per host and template before anything else is dealt by host
    marked = marked.groupBy("host", "t0").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
    seen = parsed.groupBy("host", "t0").agg(F.count("*").alias("n"))
    counts = seen.join(marked, ["host", "t0"], "left").select("host", "t0", "n", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    tree = generalise(counts, ws)
    total = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    share = total["bad"] / total["labelled"] if total["labelled"] else 0.0
    share = prior if prior is not None else 0.5 if labels is None else share
    nodes = tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    nodes = nodes.select("host", "t", ((F.col("bad") + weight * share) / (F.col("labelled") + weight) >= min_bad).alias("rejected"))
    verdicts = tree.select("host", "t0", "t").join(small_or_shuffled(ws.save(nodes)), ["host", "t"]).select("host", "t0", F.concat(F.lit("/"), F.array_join("t", "/")).alias("template"), "rejected")
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    # beyond the size for a broadcast, adaptive execution splits a template with very many pages
    return parsed.join(small_or_shuffled(ws.save(verdicts)), ["host", "t0"]).select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template")
