"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; a fingerprint becomes the vector of its
segments' bit counts.  One differing bit moves that vector by one under the Manhattan distance, so that
distance is a lower bound of the Hamming distance.  The vector's 32 coordinates form g groups; at most k
differing bits leave g - k groups alone, hence two fingerprints within k bits share a cell of at least one
of the C(g, k) sub-grids that keep g - k groups.  g grows with the number of fingerprints, so that cells
stay small.  The range join looks into equal cells only, filters by the Manhattan distance and verifies by
the exact Hamming distance.

Large groups of near copies fill cells with thousands of different fingerprints.  Their pairs are never
made: neighbours in a cell's sorted order are linked first, components are contracted, and only cells
which still hold two components are joined, across components.  Every link between components is found
there, so the components are those of the whole graph.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, components, fresh, only, small_or_shuffled

SEED = 42
SEGMENTS = 32
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles in order, repeats included; none for null and wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats counted; null and wordless texts give 0.

    Words are runs of characters other than ASCII space and 09-0D; A-Z are lower-cased.  Fewer words
    than ``width`` make one shingle.  A bit is set if it is set in over half of the hashes.
    """
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; one Arrow pass, no shuffle."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _segment_counts(fp: Column) -> Column:
    """32 two-bit counts, packed: of a pair of bits, the sum's low bit is their xor, its high bit their and."""
    odd, next_ = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(odd), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """The distance of two vectors of packed counts 00, 01 and 10: where they differ their xor is 01 or 11 for a
    difference of one, and 10 for one of two."""
    odd, x = F.lit(0x5555555555555555), a.bitwiseXOR(b)
    low = x.bitwiseAND(odd)
    return F.bit_count(low) + 2 * F.bit_count(F.shiftrightunsigned(x, 1).bitwiseAND(odd).bitwiseAND(F.bitwise_not(low)))


def groups_for(n: int, bits: int) -> int:
    """The number of groups of segments at which n fingerprints cost least: a row per sub-grid, and the pairs that
    meet in a cell by chance (a segment's count takes its three values with 1, 2 and 1 quarters, so two counts
    are equal with probability 3/8).  More groups make more and finer sub-grids; the links found are the same."""

    def cost(g: int) -> float:
        return comb(g, bits) * (n + 0.25 * n * n * 0.375 ** (SEGMENTS * (g - bits) / g))

    return min(range(bits + 1, min(bits + 13, SEGMENTS)), key=cost)


def _masks(bits: int, groups: int) -> list[int]:
    """The masks that keep groups - bits of the groups, which share the segments as evenly as can be."""
    edges = [SEGMENTS * g // groups for g in range(groups + 1)]
    whole = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    keep = [sum(c) for c in combinations(whole, groups - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in keep]


def grid_cells(fp: Column, bits: int, groups: int) -> Column:
    """The array of a fingerprint's cells, one for each sub-grid."""
    seg = _segment_counts(fp)
    return F.array(*[seg.bitwiseAND(F.lit(m)) for m in _masks(bits, groups)])


def within(a: Column, b: Column, bits: int) -> Column:
    """Whether two fingerprints link: the Manhattan bound over the segments' counts, then the exact Hamming distance."""
    return (_manhattan(_segment_counts(a), _segment_counts(b)) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def classes(prints: DataFrame, ws: Workspace, bits: int = 4, groups: int | None = None) -> DataFrame:
    """(fp, component_id) of every different fingerprint; component_id is the smallest doc_id reachable
    over links of at most ``bits`` (0 to 7) differing bits; ``groups``, else groups_for(), changes the cost only.

    Nodes are the fingerprints themselves, so that one all of whose rows lack a doc_id links others too; a
    component without any doc_id has a null component_id."""
    if not 0 <= bits <= 7:
        raise ValueError("bits must be between 0 and 7")
    reps = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    cells = reps.select("fp", F.posexplode(grid_cells(F.col("fp"), bits, groups or groups_for(reps.count(), bits))).alias("grid", "cell"))
    w = Window.partitionBy("grid", "cell").orderBy("fp")
    crowded = ws.save(cells.select("grid", "cell", "fp", F.lag("fp").over(w).alias("fp0"), F.lead("fp").over(w).alias("fp1")).where("fp0 is not null or fp1 is not null").drop("fp1"))
    near = crowded.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= bits)
    first = ws.save(components(near.select(F.col("fp").alias("a"), F.col("fp0").alias("b")), ws))

    members = crowded.select("grid", "cell", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left")
    members = ws.save(members.select("grid", "cell", "fp", F.coalesce("component", "fp").alias("component")))
    ws.drop(crowded)
    mixed = members.groupBy("grid", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("grid", "cell")
    mixed = ws.save(members.join(mixed, ["grid", "cell"]).withColumn("counts", _segment_counts(F.col("fp"))))
    ws.drop(members)
    a, b = mixed.alias("a"), mixed.alias("b")
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") < F.col("b.component"))
    link = (_manhattan(F.col("a.counts"), F.col("b.counts")) <= bits) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
    second = ws.save(components(a.join(b, same & link).select(F.col("a.component").alias("a"), F.col("b.component").alias("b")), ws))
    ws.drop(mixed)

    to = reps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("c"))
    to = ws.save(to.join(second.withColumnRenamed("node", "c"), "c", "left").select("fp", "id", F.coalesce("component", "c").alias("c")))
    names = to.groupBy("c").agg(F.min("id").alias("component_id"))
    return to.join(names, "c").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id for every row of docs.

    Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows
    share a component; a row without doc_id links others and gets the component of its fingerprint, which
    is null if no row reachable has an id.  An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    prints = ws.save(fingerprints(docs, width))
    named = ws.save(classes(prints, ws, bits))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, bits: int = 4, similarity: tuple[int, int] | None = None) -> DataFrame:
    """docs without all but the smallest doc_id of each component; columns and texts stay as they are.

    Links are fingerprints within ``bits``, or, if ``similarity`` is given as a fraction (p, q), all pairs of
    documents whose sets of shingles reach that Jaccard similarity: of the pairs within ``bits`` those that do, and
    those that few bits can't tell (copies.py).
    Null, empty and wordless texts are copies of each other.  A null doc_id names no document: such rows stay.
    Of rows which repeat a doc_id one stays.  An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    if similarity:
        from loomfield.llm import copies

        named = ws.save(copies.members(docs, ws, width, similarity, bits))
    else:
        prints = ws.save(fingerprints(docs, width))
        named = ws.save(prints.join(ws.save(classes(prints, ws, bits)), "fp").select("doc_id", "component_id"))
    # those that go are few beside those that stay, so texts needn't be shuffled to be told apart
    told = named.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    told = ws.save(told.where("not stays or n > 1"))
    key = fresh(docs, "gone_id")
    gone = small_or_shuffled(ws.save(told.where("not stays").select(F.col("doc_id").alias(key))))
    kept = docs.where(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == F.col(key), "left_anti")
    if not told.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionAll(docs.where(docs["doc_id"].isNull()))
