"""Joins of two tables where a text of one holds a needle of the other, over posting lists of grams.

A text that holds a needle holds each of its grams (three characters in a row; shorter needles are their own gram).
So each needle is looked up under its rarest gram alone, rarity being the number of texts that hold it, and the few
texts of that list are searched for the whole needle.  A needle with a gram that no text has is looked up nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.session import ensure_checkpoint_dir

GRAM = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, as LIKE compares them in databases that fold ASCII alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text, in one pass over its characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: i <= F.length(text) - n + 1)
    # one element, so that the characters are split once for all runs
    runs = F.transform(F.array(chars), lambda cs: F.transform(starts, lambda i: F.array_join(F.slice(cs, i, n), "")))
    return F.array_distinct(F.flatten(runs))


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle), each once, of the values of the first column of ``texts`` and of ``needles`` where the text holds
    the needle.  Null values and empty needles hold nothing and are held by nothing.

    Posting lists have a text's digest, not the text, and only grams that some needle has; a gram that many texts hold
    is met by those needles alone whose other grams are no rarer."""
    ensure_checkpoint_dir(texts.sparkSession)
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text")).where("text IS NOT NULL").distinct().withColumn("digest", F.md5("text"))
    needles = needles.select(F.col(needles.columns[0]).cast("string").alias("needle")).where("needle <> ''").distinct()
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))
    asked = needles.select("needle", F.explode(own).alias("gram")).checkpoint()
    sizes = [r.n for r in asked.select(F.length("gram").alias("n")).distinct().collect()]  # 1 to GRAM
    if not sizes:
        return texts.select("text", F.lit("").alias("needle")).limit(0)
    every = F.concat(*[grams(F.col("text"), n) for n in sizes])
    posted = texts.select("digest", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi").checkpoint()
    held = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(held, "gram", "left").groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("best"), F.count_if(F.col("n").isNull()).alias("missing"))
    rarest = rarest.where("missing = 0").select("needle", "best.gram")
    found = posted.join(rarest, "gram").select("digest", "needle")
    return found.join(texts, "digest").where(F.contains("text", F.col("needle"))).select("text", "needle")


def matches(rows: DataFrame, key: str, columns: Sequence[str], needles: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(key, needle), each once, of rows of which any of the columns holds a value of the first column of ``needles``."""
    same = ascii_lower if ignore_case else (lambda c: c)
    asked = needles.select(F.col(needles.columns[0]).cast("string").alias("__own")).where("__own <> ''").distinct().withColumn("needle", same(F.col("__own")))
    texts = rows.select(F.col(key), F.explode(F.array_distinct(F.array(*[same(F.col(c).cast("string")) for c in columns]))).alias("text")).where("text IS NOT NULL")
    pairs = holding(texts.select("text"), asked.select("needle"))
    out = texts.join(pairs, "text").select(key, "needle").distinct()
    return out.join(asked, "needle").select(key, F.col("__own").alias("needle"))
