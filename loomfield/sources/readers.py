"""Readers: records, sitemaps, robots files and object listings, by Spark's own sources."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions.rules import is_excluded


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents: objects or arrays of objects."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """One object per line, blank lines skipped; a bad line ends the read if strict, else is kept as text in
    _corrupt_record where the schema has that column."""
    r = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """The rows of a document that writers.write_document() wrote in parts, and the document without its rows.  Parts
    are read side by side, an object a line."""
    frame = json.loads(spark.read.option("wholetext", True).text(f"{path}/document.json").first().value)
    lines = spark.read.option("pathGlobFilter", "part-*").text(path).where(~F.col("value").isin(frame["head"], frame["tail"], frame["head"] + frame["tail"]))
    return lines.select(F.from_json(F.ltrim("value", F.lit(",")), schema).alias("row")).select("row.*"), frame["head"] + frame["tail"]


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """All strings under a header; the named columns are cast, values that don't cast become null.  Booleans are
    true, 1 and yes."""
    df = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.lower(c).isin("true", "1", "yes") if t == "boolean" else F.trim(c).try_cast(t))
    return df


def read_objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, content) of all objects below a path, on any store Spark reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """The same without contents, which aren't read then."""
    df = read_objects(spark, path).select("path", "size", "modified")
    return df.where(F.element_at(F.split("path", "/"), -1).startswith(prefix)) if prefix else df


def read_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))


_SITEMAP = "STRUCT<url: ARRAY<STRUCT<loc: STRING, lastmod: STRING, changefreq: STRING, priority: STRING>>, sitemap: ARRAY<STRUCT<loc: STRING, lastmod: STRING>>>"


def sitemap_rows(df: DataFrame, xml: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, lastmod, lastmod_date, changefreq, priority, type of each entry of sitemaps and sitemap indexes."""
    one = df.select(*keep, F.from_xml(F.col(xml), _SITEMAP).alias("s"))
    none = F.lit(None).cast("string")
    urls = one.select(*keep, F.explode("s.url").alias("e")).select(*keep, "e.loc", "e.lastmod", "e.changefreq", "e.priority", F.lit("url").alias("type"))
    maps = one.select(*keep, F.explode("s.sitemap").alias("e")).select(*keep, "e.loc", "e.lastmod", none.alias("changefreq"), none.alias("priority"), F.lit("sitemap").alias("type"))
    rows = urls.unionAll(maps).where(F.trim("loc") != "")
    day = F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd")
    return rows.select(*keep, F.trim("loc").alias("url"), "lastmod", day.alias("lastmod_date"), "changefreq", F.coalesce(F.col("priority").try_cast("double"), F.lit(0.0)).alias("priority"), "type")


def filter_sitemap(rows: DataFrame, min_priority: float | None = None, changefreq: str | None = None, days: int | None = None, as_of: Column | None = None) -> DataFrame:
    if min_priority is not None:
        rows = rows.where(F.col("priority") >= min_priority)
    if changefreq is not None:
        rows = rows.where(F.col("changefreq") == changefreq)
    if days is not None:
        rows = rows.where(F.col("lastmod_date") >= F.date_sub(as_of if as_of is not None else F.current_date(), days))
    return rows


def sitemap_urls(xml: Column) -> Column:
    """The loc texts of a sitemap of any form, without excluded urls."""
    found = F.regexp_extract_all(xml, F.lit(r"(?i)<loc[^>]*>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: ~is_excluded(u))


def robots_sitemaps(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sitemap urls of robots.txt lines, with their case kept."""
    found = F.regexp_extract(F.trim(column), r"(?i)^sitemap:\s*(\S+)", 1)
    return lines.select(found.alias("url")).where("url <> ''").distinct()


def sitemap_pages(pages: DataFrame, sitemaps: DataFrame, xml: str) -> DataFrame:
    """The pages whose urls a sitemap of any form lists, without excluded urls.  pages: url and others; each url
    is looked up once, however often it is listed."""
    listed = sitemaps.select(F.explode(sitemap_urls(F.col(xml))).alias("url")).distinct()
    return pages.join(listed, "url", "left_semi")


def parse_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a stored text as a value: parsed if ``name`` ends in .json and the text is JSON, else as it is."""
    parsed = F.when(F.col(name).endswith(".json"), F.try_parse_json(column))
    return df.withColumn(f"{column}_json", parsed)


#: What a run starts from where no file says otherwise.
DEFAULT_CONFIG = {"requests": {"timeout": 30, "max_retries": 3}, "output": {"formats": ["json", "csv", "xlsx"]}}


def load_config(spark: SparkSession, path: str | None = None) -> dict:
    """A YAML file from any store Spark reads, over DEFAULT_CONFIG; JSON is YAML, and the only form where no YAML
    parser is installed."""
    if path is None:
        return dict(DEFAULT_CONFIG)
    text = spark.read.text(path, wholetext=True).first()
    try:
        import yaml

        held = yaml.safe_load(text.value if text else "")
    except ImportError:
        held = json.loads(text.value) if text else None
    if held is not None and not isinstance(held, dict):
        raise ValueError(f"{path} isn't a mapping")
    return DEFAULT_CONFIG | (held or {})
