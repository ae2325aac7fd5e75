"""Toxicity by logistic regression over hashed words, stems, word n-grams and skip-grams, fitted by FTRL-proximal.

Features are 64-bit hashes, each counted once a text, so that a long text is judged by what it holds and not by how
much it holds besides.  Each coordinate has a learning rate of its own, and the L1 term keeps the weight of all
features at zero whose gradients don't add up, which leaves a few thousand weights, a table small enough to go to
every task.

Labelled rows are learned from in shards of bounded size, one task each.  After each round the shards' states are
averaged by feature over the shards that have it, and the next round starts from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import Workspace, only, small_batches

#: About the most labelled rows that a model is fitted on, chosen by hash among all; and rows of a shard.
ROWS = 20_000
SHARD_ROWS = 2_500
#: Most weights of a model: the largest ones stay.
WEIGHTS = 1 << 18
ROUNDS = 3
PASSES = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.0
#: Words apart in n-grams: neighbours, and with one or two words skipped.
GAPS = (1, 2, 3)
#: Code points of a word's stems, which stand for its endings.
STEMS = (4, 6)
_PUNCTUATION = bytes(32 if (b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128) else b for b in range(256))
_CACHE = 200_000


def _odd(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(name) | 1)


_FACTORS = [(_odd(f"first {gap}"), _odd(f"second {gap}")) for gap in GAPS]


class _Words(dict):
    """Hashes of words and of their stems, each computed once while there is room."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        letters = word.decode("utf-8", "replace")
        self[word] = found = (xxhash.xxh64_intdigest(word), *[xxhash.xxh64_intdigest(letters[:n].encode(), n) for n in STEMS])
        return found


_known = _Words()


def features(text: str | None) -> np.ndarray:
    """Hashes (uint64, with repeats) of a text's words, stems, word pairs and skip pairs.  Case and ASCII punctuation
    don't count."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > _CACHE:
        _known.clear()
    own, *stems = np.array([_known[w] for w in words], np.uint64).T
    grams = [own[:-gap] * a ^ own[gap:] * b for gap, (a, b) in zip(GAPS, _FACTORS)]
    return np.concatenate([own, *stems, *grams])


@dataclass
class Model:
    """Weights by feature, in the order of keys, and the weight that every text has."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __post_init__(self):
        self.bits = 20
        self.flags = np.zeros(1 << self.bits, bool)
        self.flags[self.keys & np.uint64((1 << self.bits) - 1)] = True

    def score(self, text: str | None) -> float:
        x = features(text)
        x = np.unique(x[self.flags[x & np.uint64((1 << self.bits) - 1)]])
        at = np.minimum(np.searchsorted(self.keys, x), max(len(self.keys) - 1, 0))
        logit = self.bias + (float(self.weights[at[self.keys[at] == x]].sum()) if len(self.keys) else 0.0)
        return 1 / (1 + math.exp(-max(min(logit, 700.0), -700.0)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: Iterable[tuple[np.ndarray, int]], base: float, start: tuple[np.ndarray, np.ndarray, np.ndarray], passes: int = PASSES):
    """(keys, z, n) after ``passes`` over rows (features, label).  start: keys, z, n to go on from.  Key 0 is the
    bias, which has no L1 term and is added to ``base``.  Features of a single row are left out: alone they can't
    tell more than the row itself."""
    rows = [(np.unique(x), y) for x, y in rows]
    everything = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in rows]])
    keys, counts = np.unique(everything, return_counts=True)
    del everything
    keys = np.union1d(np.union1d(keys[counts > 1], start[0]), np.zeros(1, np.uint64))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    at = np.searchsorted(keys, start[0])
    z[at], n[at] = start[1], start[2]
    held = []
    for x, y in rows:
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        held.append((i[(keys[i] == x) & (i > 0)], y))
    for _ in range(passes):
        for i, y in held:
            w = _weights(z[i], n[i])
            bias = -z[0] / ((BETA + math.sqrt(n[0])) / ALPHA + L2)
            g = 1 / (1 + math.exp(-max(min(base + bias + w.sum(), 35.0), -35.0))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
            root = math.sqrt(n[0])
            n[0] += g * g
            z[0] += g - (math.sqrt(n[0]) - root) / ALPHA * bias
    return keys, z, n


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    """A model of ``labels.toxic``, from rows that held_out() doesn't hold out, about ``rows`` of them at most.

    Null ids and null labels teach nothing; a doc_id with several labels is toxic if one says so, one with several
    texts counts by the smallest.  Without labels every score is close to 0."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    known = only(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = ws.save(known.groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("y")))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = min(max(toxic / n if n else 0.0, 1e-6), 1 - 1e-6)
    base = math.log(rate / (1 - rate))
    if not n or toxic in (0, n):
        return Model(bias=base)
    parts, shards = 1 << 30, max(1, round(min(n, rows) / shard_rows))
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(parts))
    chosen = ws.save(known.where(place < int(parts * min(1.0, rows / n))))
    texts = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    texts = ws.save(texts)

    state = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    for _ in range(ROUNDS):
        begin = spark.sparkContext.broadcast(state)

        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("doc_id", key=lambda c: c.map(lambda d: xxhash.xxh64_intdigest(str(d))))
            keys, z, n = ftrl(((features(t), y) for t, y in zip(frame.text, frame.y)), base, begin.value)
            told = (np.abs(z) > L1) | (keys == 0)
            return pd.DataFrame({"key": keys[told].view(np.int64), "z": z[told], "n": n[told]})

        learned = texts.groupBy("shard").applyInPandas(learn, "key long, z double, n double")
        merged = ws.save(learned.groupBy("key").agg(F.avg("z").alias("z"), F.avg("n").alias("n")))
        most = merged.where("key <> 0").orderBy(F.abs("z").desc(), "key").limit(WEIGHTS).unionAll(merged.where("key = 0")).toPandas().sort_values("key", key=lambda k: k.astype("uint64"))
        state = (most.key.to_numpy(np.int64).view(np.uint64), most.z.to_numpy(), most.n.to_numpy())
        begin.unpersist()
    keys, z, n = state
    w = _weights(z, n)
    bias = base - float(z[0]) / ((BETA + math.sqrt(n[0])) / ALPHA + L2) if len(keys) and keys[0] == 0 else base
    w[keys == 0] = 0.0
    return Model(keys[w != 0], w[w != 0], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row, in one pass without a shuffle.

    Null and empty texts are scored by the bias alone; a null doc_id isn't held out; repeated rows are scored each.
    Texts of any length are read whole.  An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of docs by a model that is fitted on their labels."""
    return score(docs, fit(docs, labels))
