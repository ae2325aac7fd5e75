"""Quality rules with host verdicts.

Every document is measured once.  A host's rule failures are counted, its failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts (method of moments), and a host whose shrunk
rate is above ``max_rate`` is rejected.  Its verdict joins back to its documents: a document is kept if it
passes the base rules and its host isn't rejected.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, fresh, small_or_shuffled

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MAX_RATE = 0.5
#: Bounds of the fitted prior's weight, in documents.
WEIGHT = (1.0, 10_000.0)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words which occur twice or more."""
    grams = list(zip(*(islice(words, i, None) for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """FEATURES of a text; null has none of anything.  Words are runs of other than ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_features(docs: DataFrame, columns: dict[str, str], text: str = "text") -> DataFrame:
    """The named columns and the features of every row, under the names of ``columns`` (feature -> name)."""
    kept = [c for c in docs.columns if c not in columns.values()]
    place = kept.index(text)
    schema = docs.select(*kept).schema
    for f in FEATURES:
        schema = schema.add(columns[f], "long")

    def run(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(place)]
            new = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *columns.values()])

    return docs.select(*kept).mapInArrow(run, schema)


def base_failed(c: dict[str, str]):
    return (F.col(c["n_words"]) < 10) | (100 * F.col(c["n_repeat_words"]) > 20 * F.col(c["n_words"]))


def any_failed(c: dict[str, str]):
    """A document fails for its host by a base rule, by many symbols or repeated lines, or by odd word lengths."""
    n = F.col(c["n_words"])
    return (
        base_failed(c)
        | (10 * F.col(c["n_symbols"]) > n)
        | (5 * F.col(c["n_dup_lines"]) > n)
        | (F.col(c["word_chars"]) < 2 * n)
        | (F.col(c["word_chars"]) > 15 * n)
    )


def host_verdicts(measured: DataFrame, host: str, columns: dict[str, str], max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) per host.  Counts are combined before the shuffle, so a
    host with a third of all rows is no heavier than others; the prior comes from two moments over hosts."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if(any_failed(columns)).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"), F.avg(raw * (1 - raw) / F.col("n_docs")).alias("noise")).first()
    alpha, beta = prior(m["mean"], m["var"], m["noise"])
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def prior(mean: float | None, var: float | None, noise: float | None) -> tuple[float, float]:
    """Beta parameters by moments; sampling noise is taken off the variance, the weight is bounded."""
    if mean is None:
        return 0.5, 0.5
    spread = max((var or 0.0) - (noise or 0.0), 0.0)
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else WEIGHT[1]
    weight = min(max(weight, WEIGHT[0]), WEIGHT[1])
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the five features, base_failed, kept, host_docs, host_failed for every row.

    Null and empty texts have no words and fail; a null source belongs to no host, such rows are judged
    by the base rules alone (host_docs and host_failed null); repeated rows count each time.  An empty
    table gives an empty result; other columns are not read.
    """
    own = {f: f for f in FEATURES}
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("host"))
    ws = Workspace(docs.sparkSession)
    measured = ws.save(with_features(rows, own).drop("text"))
    hosts = ws.save(host_verdicts(measured, "host", own, max_rate))
    joined = measured.join(small_or_shuffled(hosts), "host", "left")
    failed = base_failed(own)
    return joined.select(
        "doc_id", *FEATURES, failed.alias("base_failed"), (~failed & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
        F.col("n_docs").alias("host_docs"), F.col("n_failed").alias("host_failed"),
    )


def keep_good(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Null and empty texts have no words and go; rows with a null source are judged alone; null doc_ids and
    repeated rows are rows like others.  An empty table gives an empty result.
    Documents are measured twice, for their hosts and for themselves: texts are neither written between
    nor shuffled by host."""
    names = {f: fresh(docs, f"quality_{f}") for f in FEATURES}
    ws = Workspace(docs.sparkSession)
    measured = ws.save(with_features(docs.select("source", "text"), names).drop("text"))
    bad = ws.save(host_verdicts(measured, "source", names, max_rate).where("rejected").select(F.col("host").alias(fresh(docs, "quality_host"))))
    ws.drop(measured)
    good = with_features(docs, names).where(~base_failed(names))
    if not bad.isEmpty():
        good = good.join(small_or_shuffled(bad), good["source"] == bad[bad.columns[0]], "left_anti")
    return good.select(*docs.columns)
