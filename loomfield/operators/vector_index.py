"""An inverted-file index of vectors: coarse centres, a list of rows for each, searched a few lists at a time.

Centres are fitted on a bounded sample; every row is put on the list of its nearest centre, and the lists are written
side by side.  A query looks through the lists of its nearest centres, as many as an own sample of rows needed to have
the wanted part of their true neighbours there; what it finds is scored exactly.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators.records import top_per_group

#: Most rows that centres are fitted on, and queries among them that the number of lists to search is fitted on.
SAMPLE, TRIALS = 20_000, 400
#: Most centres, and rows of a list and queries that meet in one task.
CENTRES, ROWS, QUERIES = 4096, 20_000, 1000


@dataclass
class Index:
    """A written index: its folder, the centres by vector length, and how many lists a query looks through."""

    path: str
    centres: dict[int, np.ndarray]
    probes: dict[int, int]
    #: Part of the sample's true neighbours found, and part of its rows looked at, at that number.
    recall: dict[int, float]
    share: dict[int, float]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows that lie far from each other."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], c)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> tuple[int, float, float]:
    """The fewest lists in which a sample's rows have the part ``recall`` of their k nearest, that part, and the part of
    the rows that those lists hold."""
    lists = (x @ c.T).argmax(1)
    q = np.random.default_rng(8).choice(len(x), min(TRIALS, len(x)), replace=False)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[q] @ c.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None, :].repeat(len(q), 0), 1)
    at = np.take_along_axis(rank, lists[near], 1)
    every = np.take_along_axis(rank, np.broadcast_to(lists, (len(q), len(x))), 1)
    for p in range(1, len(c) + 1):
        if (got := float((at < p).mean())) >= recall or p == len(c):
            return p, got, float((every < p).mean())


def _nearest_lists(batch_v: list, centres: dict[int, np.ndarray], n: dict[int, int] | None) -> list[list[int]]:
    out = []
    for v in batch_v:
        c = centres.get(len(v))
        if c is None:
            out.append([])
            continue
        s = c @ _unit(np.array([v]))[0]
        out.append(np.argsort(-s)[: 1 if n is None else n[len(v)]].tolist())
    return out


def build_index(table: DataFrame, path: str, key: str, vector: str, k: int = 10, recall: float = 0.95, sample: int = SAMPLE) -> Index:
    """Writes an index of table's rows to path.  Null, zero and non-finite vectors, and rows without a key, take no part;
    each vector length has centres of its own, about the root of its number of rows and CENTRES at most."""
    spark = table.sparkSession
    rows = _usable(table, key, vector)
    sizes = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    centres, probes, found, share = {}, {}, {}, {}
    parts = 1 << 30
    for d, n in sizes.items():
        place = F.pmod(F.xxhash64(F.lit("index"), "id"), F.lit(parts))
        some = rows.where((F.size("v") == d) & (place < int(parts * min(1.0, sample / n)))).orderBy("id").limit(2 * sample)
        x = np.array([r.v for r in some.select("v").collect()])
        if not len(x):  # a few rows, none of them in the sample
            x = np.array([r.v for r in rows.where(F.size("v") == d).limit(100).collect()])
        x = _unit(x)
        centres[d] = _centres(x, max(1, min(CENTRES, round(math.sqrt(n)), len(x))))
        probes[d], found[d], share[d] = _probes(x, centres[d], k, recall) if len(x) > 1 else (1, 1.0, 1.0)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            vs = b.column(1).to_pylist()
            lists = [x[0] for x in _nearest_lists(vs, sent.value, None)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(v) for v in vs], pa.int32()), pa.array(lists, pa.int32())], ["id", "v", "d", "list"])

    lists = rows.mapInArrow(assign, "id long, v array<double>, d int, list int")
    # rebalancing splits a list that holds very many rows over several tasks
    lists.hint("rebalance", "d", "list").write.mode("overwrite").partitionBy("d", "list").parquet(f"{path}/lists")
    spark.createDataFrame([(d, json.dumps(centres[d].tolist()), probes[d], found[d], share[d]) for d in sizes] or [], "d int, centres string, probes int, recall double, share double").write.mode("overwrite").parquet(f"{path}/centres")
    return Index(path, centres, probes, found, share)


def open_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centres").collect()
    return Index(path, {r.d: np.array(json.loads(r.centres)) for r in rows}, {r.d: r.probes for r in rows}, {r.d: r.recall for r in rows}, {r.d: r.share for r in rows})


def search_index(index: Index, asked: DataFrame, key: str, vector: str, k: int = 10, digits: int = 9, probes: int | None = None) -> DataFrame:
    """query_id, vec_id, score: for each row of ``asked`` the k rows of the index with another key of the greatest
    cosine similarity among the lists it looks through, rounded; ties to the smaller key.

    Lists and the queries that look through them meet in parts of bounded size, each of which gives k rows a query;
    no part holds a whole list that is large, and only lists that some query looks through are read."""
    spark = asked.sparkSession
    n = {d: min(probes or index.probes[d], len(index.centres[d])) for d in index.centres}
    sent = spark.sparkContext.broadcast((index.centres, n))

    def routed(batches):
        for b in batches:
            vs = b.column(1).to_pylist()
            lists = _nearest_lists(vs, *sent.value)
            at = np.repeat(np.arange(len(vs)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([len(vs[i]) for i in at], pa.int32()), pa.array([x for y in lists for x in y], pa.int32())], ["id", "v", "d", "list"])

    queries = _usable(asked, key, vector).mapInArrow(routed, "id long, v array<double>, d int, list int")
    if not index.centres:
        return queries.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = spark.read.schema("id long, v array<double>, d int, list int").parquet(f"{index.path}/lists")
    counts = rows.groupBy("d", "list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("row_parts"))
    counts = counts.join(queries.groupBy("d", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_parts")), ["d", "list"])
    counts = F.broadcast(counts)  # CENTRES rows a vector length at most
    one = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = queries.join(counts, ["d", "list"]).select("d", "list", each("row_parts").alias("r"), one("query_parts").alias("q"), "id", "v")
    right = rows.join(counts, ["d", "list"]).select("d", "list", one("row_parts").alias("r"), each("query_parts").alias("q"), "id", "v")

    def best(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        q, x, own = _unit(np.stack(asked.v)), _unit(np.stack(held.v)), held.id.to_numpy()
        score = np.round(q @ x.T, digits)
        score[asked.id.to_numpy()[:, None] == own[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
        top = np.take_along_axis(score, order, 1)
        at, nth = np.nonzero(np.isfinite(top))
        return pd.DataFrame({"query_id": asked.id.to_numpy()[at], "vec_id": own[order[at, nth]], "score": top[at, nth]})

    keys = ["d", "list", "r", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    # a key with several equal vectors is one neighbour
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_per_group(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score")
