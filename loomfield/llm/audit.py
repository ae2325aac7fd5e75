"""How filters interact: what each of several filters removes in every order of application, and its Shapley sum.

Each text is measured once.  Copies are found by refining a partition of the rows: first by length in code points,
then by the hash of one block of the text after the other (each GROWTH times as long as the one before), where rows
that are alone in their class drop out of every further round.  The texts that are left are compared whole with that
of their class's smallest doc_id, so hashes decide nothing.  A document's failures are then one bit mask, and counts
by part and mask, of which a part has 2^filters at most, give every order's numbers without another look at the rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, only, small_or_shuffled

#: Failure conditions over the measures and ``copied`` (the text is that of a smaller doc_id).
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_chars",
    "D": "has_symbol",
    "E": "copied",
}
#: Code points of a text's first block, and how many times as long each next block is.
BLOCK, GROWTH = 64, 4
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_MEASURES = "doc_id long, part string, n_chars long, n_words long, n_distinct long, n_upper long, has_symbol boolean, blocks array<long>"


def block_hashes(text: str) -> list[int]:
    """XXH64 of each block; the last one is as long as the text has code points left."""
    out, start, size = [], 0, BLOCK
    while start < len(text):
        out.append(xxhash.xxh64_intdigest(text[start : start + size].encode("utf-8", "surrogatepass")))
        start, size = start + size, size * GROWTH
    return out


def measures(docs: DataFrame) -> DataFrame:
    """_MEASURES of every row; part is the source.  Words are maximal runs of other than ASCII white space."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for t in batch.column(1):
                text = t.as_py() or ""
                body = text.encode("utf-8", "surrogatepass")
                words = body.split()
                plain = len(body)
                hashes = np.array(block_hashes(text), np.uint64).view(np.int64)
                row = (len(text), len(words), len(set(words)), plain - len(body.translate(None, _UPPER)), len(body.translate(None, _SYMBOLS)) < plain, hashes)
                for c, v in zip(columns, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], ["doc_id", "part", "n_chars", "n_words", "n_distinct", "n_upper", "has_symbol", "blocks"])

    rows = only(docs, doc_id="long", text="string", source="string").withColumn("source", F.coalesce("source", F.lit("")))
    return rows.mapInArrow(run, _MEASURES)


def _class(blocks: Column | str = "blocks") -> Column:
    return F.xxhash64(F.col("n_chars"), F.col(blocks) if isinstance(blocks, str) else blocks)


def candidates(measured: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n_chars, class, low): rows that share length and all block hashes with another doc_id's, and the
    smallest doc_id of each class.  One round for the lengths and one for each block."""
    rows, done, k = measured.where("doc_id IS NOT NULL").select("doc_id", "n_chars", "blocks"), [], 0
    while True:
        named = rows.withColumn("class", _class(F.slice("blocks", 1, k)))
        shared = ws.save(named.groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"))
        kept = ws.save(named.join(small_or_shuffled(shared), "class").select("doc_id", "n_chars", "blocks", "class", "low"))
        done.append(kept.where(F.size("blocks") <= k).select("doc_id", "n_chars", "class", "low"))
        rows = kept.where(F.size("blocks") > k).select("doc_id", "n_chars", "blocks")
        k += 1
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, done).distinct()


def copied(docs: DataFrame, measured: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, class), each once, of rows whose whole text is that of a row with a smaller doc_id.

    Rows of a class whose text isn't its smallest doc_id's (equal hashes, other text) are a class of their own in
    the next round, so that the result is exact.  Of a group of copies only one text is a key on the smaller side."""
    found = ws.save(candidates(measured, ws))
    texts = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("n_chars", F.length("text").cast("long"))
    held = ws.save(texts.join(small_or_shuffled(found), ["doc_id", "n_chars"]).select("doc_id", "class", "low", "text"))
    marks = []
    while True:
        first = ws.save(held.where("doc_id = low").select("class", "text").distinct())
        first = small_or_shuffled(first).withColumn("same", F.lit(True))
        judged = held.where("doc_id > low").join(first, ["class", "text"], "left")
        judged = ws.save(judged.select("doc_id", "class", F.when(F.col("same").isNull(), F.col("text")).alias("text")))
        ws.drop(held)
        marks.append(judged.where("text IS NULL").select("doc_id", "class"))
        rest = judged.where("text IS NOT NULL")
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, marks).distinct()
        held = ws.save(rest.join(rest.groupBy("class").agg(F.min("doc_id").alias("low")), "class").select("doc_id", "class", "low", "text"))


def failures(docs: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """doc_id, part, the measures, copied, and mask: bit i is set if the row fails the i-th filter.

    A null text is an empty one, a null source the part ''.  A null doc_id is neither smaller nor larger than
    others: its row is no copy and makes none.  Rows that repeat a doc_id are rows of their own, and not copies of
    each other.  Texts of any length are measured whole, in one pass without a shuffle."""
    ws = Workspace(docs.sparkSession)
    measured = ws.save(measures(docs))
    marks = copied(docs, measured, ws).withColumn("copied", F.lit(True))
    rows = measured.withColumn("class", _class()).join(marks, ["doc_id", "class"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(filters.values())]
    return rows.withColumn("mask", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("class", "blocks")


def interactions(failed: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step; see audit().

    failed: doc_id, part and mask.  labels: doc_id, quality, toxic; a doc_id with several labels has each of their
    values, one without a label none.  Counts are combined before the shuffle, so a part with a third of all rows is
    no heavier than others; a part's numbers then follow from its 2^filters counts at most."""
    known = only(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    full = (1 << len(letters)) - 1
    total = lambda cells, of: F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c[of])
    left = lambda of: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: total(F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0), of))
    alone = lambda bit: total(F.filter("cells", lambda c: c["mask"] == bit), "n")
    lone = F.array(*[alone(1 << i) for i in range(len(letters))])
    parts = parts.select("part", left("n").alias("left_n"), left("good").alias("left_good"), left("toxic").alias("left_toxic"), lone.alias("lone"))
    parts = parts.withColumn("sums", F.array(*[_shapley(i, len(letters)) for i in range(len(letters))]))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = lambda i: f"locate(substr(filter_order, {i}, 1), '{letters}') - 1"
    steps = steps.withColumn("own", F.expr(place("step")))
    steps = steps.withColumn("before", F.expr(f"aggregate(slice(sequence(0, step - 1), 2, step - 1), 0, (m, i) -> m | shiftleft(1, {place('i')}))"))
    before, after = F.col("before") + 1, F.col("before").bitwiseOR(F.expr("shiftleft(1, own)")) + 1
    at = lambda array, i: F.element_at(array, i)
    gone = lambda of: at(f"left_{of}", before) - at(f"left_{of}", after)
    fails = at("left_n", F.lit(1)) - at("left_n", F.expr("shiftleft(1, own)") + 1)
    return steps.select(
        "part", "filter_order", "step", at("left_n", after).alias("kept"), gone("n").alias("removed"), (fails - gone("n")).alias("redundant"),
        at("lone", F.col("own") + 1).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("sums", F.col("own") + 1).alias("shapley"),
    )


def _shapley(i: int, n: int) -> Column:
    """What filter i removes, summed over all orders: each set of filters before it stands for as many orders as it
    and the rest can be arranged."""
    others, terms = [j for j in range(n) if j != i], []
    for size in range(n):
        for before in combinations(others, size):
            m = sum(1 << j for j in before)
            lost = F.element_at("left_n", m + 1) - F.element_at("left_n", (m | 1 << i) + 1)
            terms.append(lost * (math.factorial(size) * math.factorial(n - 1 - size)))
    return reduce(lambda a, b: a + b, terms)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, filter_order, step, and of the step's filter: kept (rows after it), removed, redundant (fail it but went
    before), unique_fails (fail it alone), good_lost, toxic_lost (removed rows with such a label), shapley (removed,
    summed over all orders).  Every part has a row for each order and step, zeros included.

    Nulls, repeated and empty rows as in failures(); an empty table gives an empty result, an empty table of labels
    no loss.  Columns of other names are not read."""
    return interactions(failures(docs, filters), labels, "".join(filters))
