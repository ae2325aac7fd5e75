"""Near copies for the SimHash operator: links between all texts whose sets of word shingles reach a Jaccard similarity.

1. A text's shingles are those of its SimHash, each as a 64-bit hash.  Equal sets are one node, under their
   smallest doc_id.
2. Its SimHash fingerprint gives the cells of the operator's sub-grids of segment counts; sets that share one
   are candidates if the Manhattan bound and the Hamming distance allow ``bits`` differing bits.
3. Fingerprints of pairs at 0.8 differ in more bits than any grid can bear, so 120 minima under random multiplications form 24 bands of five.  Two sets of similarity s share a band
   with probability 1 - (1 - s^5)^24: 0.99993 at 0.8, more above.
   Sets that share a band are candidates if their sizes allow the similarity.
4. Candidates of both kinds are verified on their exact sets, taken from the texts once more.
5. Large groups fill a grid's or a band's cells with thousands of sets.  Each set is compared with its cell's first one
   and the one before it, verified links are contracted, and only cells which still hold two components
   are joined, across components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, components, only, small_or_shuffled
from loomfield.llm.simhash import SEED, grid_cells, groups_for, majority, shingle_hashes, within

THRESHOLD = (4, 5)  # similarity 0.8 as a fraction, so that bounds are exact
BANDS, ROWS = 24, 5
_BLOCK = 1 << 12
_RNG = np.random.Generator(np.random.PCG64(20240307))
_TIMES = _RNG.integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The different 64-bit hashes of a text's word shingles, in order; none for null and wordless texts."""
    return np.unique(shingle_hashes(text, width))


def mark(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A set's band hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), _BLOCK):
        low = np.minimum(low, (_TIMES * hashes[i : i + _BLOCK]).min(1))
    low ^= low >> np.uint64(29)
    out = (low.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, n, fp, bands) of every row; one Arrow pass, no shuffle."""

    def run(batches):
        for batch in batches:
            marks, sizes, prints, cells = [], [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), width)
                prints.append(majority(h))
                h = np.unique(h)
                marks.append(mark(h))
                sizes.append(len(h))
                cells.append(bands(h))
            at = np.cumsum([0, *map(len, cells)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *cells])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), lists], ["doc_id", "mark", "n", "fp", "bands"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, mark long, n long, fp long, bands array<long>")


def _exact(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(mark, hashes) of the documents with the wanted ids."""

    def run(batches):
        for batch in batches:
            for t in batch.column(0):
                h = shingles(t.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array([mark(h)], pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], ["mark", "hashes"])

    rows = only(docs, doc_id="long", text="string").join(small_or_shuffled(wanted), "doc_id", "left_semi")
    return rows.select("text").mapInArrow(run, "mark long, hashes array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, ws: Workspace, width: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (mark_a, id_a, mark_b, id_b) whose sets really match."""
    wanted = ws.save(pairs.select(F.col("id_a").alias("doc_id")).unionAll(pairs.select("id_b")).distinct())
    exact = ws.save(_exact(docs, wanted, width))
    p, q = threshold
    common, total = F.size(F.array_intersect("hashes_a", "hashes_b")), F.size("hashes_a") + F.size("hashes_b")
    both = pairs.join(exact.toDF("mark_a", "hashes_a"), "mark_a").join(exact.toDF("mark_b", "hashes_b"), "mark_b")
    out = ws.save(both.where(q * common >= p * (total - common)).select(*pairs.columns).distinct())
    ws.drop(wanted, exact)
    return out


def _may_match(a: str, b: str, threshold: tuple[int, int]):
    p, q = threshold
    return (q * F.col(a) >= p * F.col(b)) & (q * F.col(b) >= p * F.col(a))


def _candidates(a: str, b: str, threshold: tuple[int, int], bits: int):
    """Whether two rows of a cell are to be verified: by size, and in the cells of a grid by their fingerprints."""
    return _may_match(f"{a}n", f"{b}n", threshold) & ((F.col("band") < BANDS) | within(F.col(f"{a}fp"), F.col(f"{b}fp"), bits))


def classes(sets: DataFrame, docs: DataFrame, ws: Workspace, width: int, threshold: tuple[int, int] = THRESHOLD, bits: int = 4) -> DataFrame:
    """(mark, component_id) of every different set with a doc_id; component_id is the smallest doc_id
    reachable over links of at least that similarity.  Empty sets are equal to each other.

    Bands from BANDS on are the sub-grids of fingerprints."""
    # equal sets may have different fingerprints, as these count repeats; the smallest doc_id's one goes on
    first_row = F.min_by(F.struct("n", "fp", "bands"), F.struct("doc_id", "fp"))
    reps = ws.save(sets.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"), first_row.alias("r")).select("mark", "id", "r.*"))
    w = Window.partitionBy("band", "cell").orderBy("id", "mark")
    row = F.struct("mark", "id", "n", "fp")
    grid = F.when(F.col("n") > 0, grid_cells(F.col("fp"), bits, groups_for(reps.count(), bits))).otherwise(F.array().cast("array<long>"))
    cells = reps.select("mark", "id", "n", "fp", F.posexplode(F.concat(F.when(F.col("n") > 0, F.col("bands")).otherwise(F.array().cast("array<long>")), grid)).alias("band", "cell"))
    crowded = ws.save(cells.select("*", F.lag(row).over(w).alias("prior"), F.first(row).over(w).alias("head"), F.lead("id").over(w).alias("next")).where("prior is not null or next is not null").drop("next"))
    near = crowded.where("prior is not null").select("band", "mark", "id", "n", "fp", F.explode(F.array("prior", "head")).alias("a")).where(_candidates("a.", "", threshold, bits))
    near = ws.save(near.select(F.col("a.mark").alias("mark_a"), F.col("a.id").alias("id_a"), F.col("mark").alias("mark_b"), F.col("id").alias("id_b")).distinct())
    links = _verified(near, docs, ws, width, threshold)
    first = ws.save(components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), ws))

    members = crowded.select("band", "cell", "mark", "id", "n", "fp").join(first.withColumnRenamed("node", "id"), "id", "left")
    members = ws.save(members.withColumn("component", F.coalesce("component", "id")))
    ws.drop(crowded)
    mixed = members.groupBy("band", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "cell")
    mixed = ws.save(members.join(mixed, ["band", "cell"]))
    ws.drop(members)
    a, b = mixed.alias("a"), mixed.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") < F.col("b.component"))
    alike = _may_match("a.n", "b.n", threshold) & ((F.col("a.band") < BANDS) | within(F.col("a.fp"), F.col("b.fp"), bits))
    pairs = a.join(b, same & alike).select(*[F.col(f"{e}.{c}").alias(f"{c}_{e}") for e in "ab" for c in ("mark", "id")], F.col("a.component").alias("left"), F.col("b.component").alias("right")).distinct()
    tried = near.unionAll(near.select("mark_b", "id_b", "mark_a", "id_a")).select("mark_a", "mark_b")
    pairs = ws.save(pairs.join(tried, ["mark_a", "mark_b"], "left_anti").select("mark_a", "id_a", "mark_b", "id_b", "left", "right"))
    ws.drop(mixed)
    links = _verified(pairs, docs, ws, width, threshold)
    second = ws.save(components(links.select(F.col("left").alias("a"), F.col("right").alias("b")), ws))
    to = reps.select("mark", "id").join(first.withColumnRenamed("node", "id"), "id", "left").select("mark", F.coalesce("component", "id").alias("c"))
    return to.join(second.withColumnRenamed("node", "c"), "c", "left").select("mark", F.coalesce("component", "c").alias("component_id"))


def members(docs: DataFrame, ws: Workspace, width: int, threshold: tuple[int, int] = THRESHOLD, bits: int = 4) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is null where no row reachable has a doc_id."""
    sets = ws.save(_sets(docs, width))
    return sets.join(ws.save(classes(sets, docs, ws, width, threshold, bits)), "mark", "left").select("doc_id", "component_id")
