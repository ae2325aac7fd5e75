"""Exact vector retrieval: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.records import top_per_group

#: Queries that a scan takes at once; more are taken in further scans.
BLOCK = 2048


def cosine_topk(table: DataFrame, asked: DataFrame, key: str, vector: str, k: int = 10, digits: int = 9) -> DataFrame:
    """query_id, vec_id, score: for each row of ``asked`` the k rows of ``table`` with another key of the greatest
    cosine similarity, rounded; ties to the smaller key.

    Each task keeps its k best for each query of a block, so that what meets afterwards is k rows a query and
    task; blocks of queries bound what a scan holds.  Null and zero vectors take no part."""
    usable = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    rows, out = usable(table), None
    queries, block = usable(asked).orderBy("id").toLocalIterator(), []

    def scan(block: list) -> DataFrame:
        ids = np.array([r.id for r in block])
        q = np.array([r.v for r in block])
        held = table.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1)[:, None]))

        def run(batches):
            ids, q = held.value
            best: list[tuple] | None = None
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy()
                x = np.array(b.column(1).to_pylist())
                score = np.round(q @ (x / np.linalg.norm(x, axis=1)[:, None]).T, digits)
                score[ids[:, None] == own[None, :]] = -np.inf
                if best is not None:
                    own, score = np.concatenate((best[0], np.broadcast_to(own, score.shape)), axis=1), np.concatenate((best[1], score), axis=1)
                else:
                    own = np.broadcast_to(own, score.shape)
                order = np.lexsort((own, -score), axis=1)[:, :k]
                best = np.take_along_axis(own, order, 1), np.take_along_axis(score, order, 1)
            if best is not None:
                good = np.isfinite(best[1])
                at = np.nonzero(good)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best[0][good]), pa.array(best[1][good])], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, "query_id long, vec_id long, score double")

    for r in queries:
        block.append(r)
        if len(block) == BLOCK:
            out, block = scan(block) if out is None else out.unionAll(scan(block)), []
    if block or out is None:
        if not block:
            return rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
        out = scan(block) if out is None else out.unionAll(scan(block))
    return top_per_group(out, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "vec_id", "score")
