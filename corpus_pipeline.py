"""A training corpus from documents: quality rules, line deduplication, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import lines, mixing, packing, quality, simhash
from loomfield.llm.queries import tokenizer_path
from loomfield.llm.shared import Workspace

#: Not SQL: fingerprints, raking and tokenizers aren't expressible; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules, null and empty texts among them, and those of rejected sources."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match earlier ones, and documents of which no word is left; n_chars follows the text.
    Rows without a doc_id lose their own repeats only; null texts stay."""
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: pairs within few SimHash bits, and pairs by min-hashes that
    SimHash can't tell (see the README), both verified on exact shingle sets.  Texts without words are copies of each other; rows
    without a doc_id stay, and of rows that repeat one one stays."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=(4, 5))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities; rows that repeat a doc_id are taken together, those without
    one by their texts, and null margins are values of their own."""
    return mixing.keep_mixed(docs, tokenizer_path())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every document, empty and null texts too, into pieces of binary lengths; a repeated row is packed again."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixture),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir))
        if hasattr(before, "_workspace_path"):
            ws.drop(before)
    return docs
