"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node's hyperplane is drawn through two random sample points and
put at the median of their projections.  Every vector is indexed: it goes down each tree to one leaf.  A
query keeps one priority queue over all trees, ordered by the largest margin on the way to a node, and
pops leaves until none is left that can hold a nearer vector than the k best of the sample, as a margin is
less than any distance over it, or until the sample vectors in the leaves reach ``fraction`` of the sample.
Leaves are grouped in tree order; vectors and queries meet in their leaves' groups, where distances of leaf
candidates are computed exactly.  Large groups are split in parts, on both sides, each of which sends the k
best of each of its queries.

Equal vectors are one row of the index with their k + 1 smallest ids, more of which can't be needed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace

SAMPLE = 20_000
TREES = 4
LEAF = 64
GROUP_LEAVES = 32
#: Rows of a part of a group.
PART = 20_000
#: Queries of a part of a group.
QUERY_PART = 2_000
#: Part of the sample that popped leaves must hold, over all trees together, so TREES is all of everything.
#: Vectors without structure need this much: their tenth neighbour is hardly nearer than the thousandth.
FRACTION = 1.4


class Forest:
    """Trees as flat arrays; child values below zero are leaves, -1 the first of a tree."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.total, self.sample = len(sample), sample
        # in units of the largest component, so that squares neither overflow nor vanish
        self.unit = float(np.abs(sample).max(initial=0.0)) or 1.0
        self.trees = [self._grow(sample / self.unit, leaf, np.random.default_rng([seed, t])) for t in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, cuts, kids, sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    n = np.linalg.norm(a - b)
                    if n > 0:
                        w = (a - b) / n
                        at = x[rows] @ w
                        cut = float(np.median(at))
                        low = at <= cut
                        if 0 < low.sum() < len(rows):
                            k = len(kids)
                            normals.append(w), cuts.append(cut), kids.append(None)
                            kids[k] = (grow(rows[low]), grow(rows[~low]))
                            return k
            sizes.append(len(rows))
            return -len(sizes)

        root = grow(np.arange(len(x)))
        return np.array(normals), np.array(cuts), kids, np.array(sizes), root

    def leaves(self, t: int, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in tree t."""
        normals, cuts, kids, _, root = self.trees[t]
        x = x / self.unit
        out = np.empty(len(x), np.int64)
        work = [(root, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -node - 1
            else:
                low = x[rows] @ normals[node] <= cuts[node]
                work += [(kids[node][0], rows[low]), (kids[node][1], rows[~low])]
        return out

    def bound(self, q: np.ndarray, k: int) -> float:
        """No less than the distance of q's k-th nearest other vector, as the sample has k of them so near."""
        d = distances(self.sample, q)
        return float(np.partition(d, k)[k]) if len(d) > k else float("inf")

    def search(self, q: np.ndarray, fraction: float, bound: float = float("inf")) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue shared by all trees, down to the margin ``bound``."""
        q, most = q / self.unit, bound / self.unit * (1 + 1e-9)
        queue = [(0.0, t, self.trees[t][4]) for t in range(len(self.trees))]
        heapq.heapify(queue)
        found, seen, need = [], 0, fraction * self.total
        while queue and seen < need:
            margin, t, node = heapq.heappop(queue)
            if margin > most:
                break
            normals, cuts, kids, sizes, _ = self.trees[t]
            while node >= 0:
                d = float(q @ normals[node] - cuts[node])
                near, far = kids[node] if d <= 0 else kids[node][::-1]
                heapq.heappush(queue, (max(margin, abs(d)), t, far))
                node = near
            found.append((t, -node - 1))
            seen += sizes[-node - 1]
        return found


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part: an id, and a vector that isn't null, zero or
    empty and holds no null or non-finite component."""
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _fixed(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from v.  Where squares overflow or vanish, they are taken in units of
    the largest difference."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = np.sqrt(((x - v) ** 2).sum(1))
        odd = ~np.isfinite(d) | (d < 1e-140)
        if odd.any():
            apart = x[odd] / 4 - v / 4
            most = np.abs(apart).max(1)
            unit = np.where(most > 0, most, 1.0)
            d[odd] = np.sqrt(((apart / unit[:, None]) ** 2).sum(1)) * unit * 4
    return d


def nearest(table: DataFrame, every: int = 100, k: int = 10, fraction: float = FRACTION, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each row whose vec_id is divisible by ``every`` its k
    nearest other rows found, by Euclidean distance in double precision, ties to the smaller vec_id.

    Rows which usable() leaves out are neither queries nor candidates.  Vectors of different lengths have no
    distance: each length is searched on its own.  Repeated ids with equal vectors count once;
    a repeated id with different vectors is a candidate by its nearest one and a query by each.  An empty
    table gives an empty result.  ``sample`` bounds the rows that trees are fitted on.
    """
    spark = table.sparkSession
    ws = Workspace(spark)
    rows = ws.save(usable(table))
    lengths = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())
    out = None
    for d in lengths:
        one = _nearest(rows.where(F.size("v") == d) if len(lengths) > 1 else rows, ws, every, k, fraction, trees, sample, leaf)
        out = one if out is None else out.unionAll(one)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int").select("query_id", "rank", "vec_id", "score")
    # a query id with vectors of several lengths has one list
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_group(numbers: dict[tuple[int, int], int]) -> Column:
    """The number of the row's tree and group, of which there are as many as the sample allows; null without one."""
    if not numbers:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*[F.lit(x) for (t, g), n in sorted(numbers.items()) for x in (f"{t}/{g}", n)]), F.concat_ws("/", "tree", "grp"))


def _nearest(rows: DataFrame, ws: Workspace, every: int, k: int, fraction: float, trees: int, sample: int, leaf: int) -> DataFrame:
    """(query_id, vec_id, score) of some more than the k best of each query, among vectors of one length."""
    spark = rows.sparkSession
    # the k + 1 smallest ids of each vector: the group of a very common one is cut down before it meets
    parted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    index = parted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("ids", 1, k + 1)))), 1, k + 1).alias("ids"))
    index = ws.save(index)
    asked = ws.save(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct())

    drawn = index.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()
    forest = Forest(np.array(drawn["v"].tolist()), trees, leaf)
    held = spark.sparkContext.broadcast(forest)

    def places(batches):
        f = held.value
        for b in batches:
            x = _fixed(b.column(0), b.num_rows)
            for t in range(len(f.trees)):
                at = f.leaves(t, x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((at // GROUP_LEAVES).astype(np.int32)), pa.array(at), b.column(0), b.column(1)], ["tree", "grp", "leaf", "v", "ids"])

    indexed = index.mapInArrow(places, "tree int, grp int, leaf long, v array<double>, ids array<long>")
    sizes = indexed.groupBy("tree", "grp").count().collect()  # as many as the forest has groups
    parts = {(r.tree, r.grp): -(-r["count"] // PART) for r in sizes}
    n_parts = _by_group(parts)
    indexed = indexed.withColumn("part", F.pmod(F.xxhash64("v"), n_parts).cast("int"))

    def visits(batches):
        f = held.value
        for b in batches:
            x, out = _fixed(b.column(1), b.num_rows), []
            for i, (d, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                by: dict[tuple[int, int], list[int]] = {}
                for t, leaf_ in f.search(x[i], fraction, f.bound(x[i], k)):
                    by.setdefault((t, leaf_ // GROUP_LEAVES), []).append(leaf_)
                out += [(t, g, d, v, ls) for (t, g), ls in by.items() if (t, g) in parts]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["tree", "grp", "query_id", "v", "leaves"])

    queries = ws.save(asked.mapInArrow(visits, "tree int, grp int, query_id long, v array<double>, leaves array<long>"))
    sizes = queries.groupBy("tree", "grp").count().collect()
    n_asked = _by_group({(r.tree, r.grp): -(-r["count"] // QUERY_PART) for r in sizes})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(0)) - 1))
    queries = queries.withColumn("asked", F.pmod(F.xxhash64("query_id"), n_asked).cast("int")).select("*", each(n_parts).alias("part"))
    # groups that no query looks into go no further
    indexed = indexed.where(n_asked.isNotNull()).select("*", each(n_asked).alias("asked"))
    keys = ["tree", "grp", "part", "asked"]

    def best(key, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(ask):
            x, at = np.array(data["v"].tolist()), data["leaf"].to_numpy()
            ids = data["ids"].tolist()
            slots = np.zeros(int(at.max()) + 1, bool)
            for qid, v, ls in zip(ask["query_id"], ask["v"], ask["leaves"]):
                slots[:] = False
                ls = np.asarray(ls)
                slots[ls[ls < len(slots)]] = True
                rows_ = np.flatnonzero(slots[at])
                if not len(rows_):
                    continue
                d = distances(x[rows_], np.asarray(v))
                if len(d) > k + 1:
                    near = d <= np.partition(d, k)[k]
                    rows_, d = rows_[near], d[near]
                got = sorted((s, i) for s, r in zip(d.tolist(), rows_.tolist()) for i in ids[r] if i != qid)[:k]
                out += [(qid, i, s) for s, i in got]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = indexed.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    return near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
