"""Mixing by iterative proportional fitting.

Documents form cells of source, language and topic.  Their token counts are raked: the cells' weights are
scaled to each marginal's target in turn, again and again, until every marginal is met.  A document is
then taken with probability min(1, rate * weight of its cell), with the rate set so that the expected
tokens meet the budget; a keyed hash of doc_id decides, so that a rerun takes the same documents.

Tokens are those of the tokenizer that packing uses.  Topics come from the data: token counts in hashed
dimensions, damped and weighted by rarity, are clustered by their directions, and every document goes to the
nearest centre.  Rarity, centres and the order of the topics are those of all documents; only the places where
the centres start are found on a bounded number of them.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfield.llm.packing import shared_encoder
from loomfield.llm.shared import Workspace, fresh, small_or_shuffled

#: Cells up to which raking runs in the driver, on three small index arrays; more are raked by Spark, to the
#: same tolerance in as many rounds.
DRIVER_CELLS = 200_000
TOLERANCE, RAKING_ROUNDS = 1e-8, 2000
MARGINS = ("source", "lang", "topic")
#: Number of topics, dimensions of the term vectors, documents that give the centres' starts at most, and rounds
#: over all documents, which end before if no centre moves.
TOPICS, DIMENSIONS, SAMPLE, TOPIC_ROUNDS = 8, 2048, 2000, 15
#: Sums of unit vectors are whole numbers of this fraction, so that they don't depend on the tasks' order.
_FINE = float(1 << 32)
_ROWS = 256


def term_counts(ids: bytes) -> np.ndarray:
    """A document's token ids counted in hashed dimensions."""
    return np.bincount(np.frombuffer(ids, "<u4") % DIMENSIONS, minlength=DIMENSIONS)


@dataclass
class Topics:
    """rarity: a weight for each dimension; centres: one row of unit length for each topic."""

    rarity: np.ndarray
    centres: np.ndarray

    def __post_init__(self):
        self.weights = self.centres * self.rarity

    def of(self, counts: np.ndarray) -> str:
        """The topic of one document's counts; a document without a token has none."""
        held = np.flatnonzero(counts)
        if not len(held) or not len(self.centres):
            return "none"
        return f"topic{int((self.weights[:, held] @ np.log1p(counts[held])).argmax())}"

    def of_all(self, terms: Terms) -> list[str]:
        """The topics of many documents."""
        out = ["none"] * terms.rows
        if len(self.centres) and len(terms.held):
            for i, k in zip(terms.held.tolist(), terms.scores(self.weights, np.log1p(terms.n)).argmax(0).tolist()):
                out[i] = f"topic{k}"
        return out


class Terms:
    """Documents' term counts, one document after the other: dimensions at (uint16) and counts n (uint32) of two binary
    columns.  held: the rows with terms; start: where theirs begin."""

    def __init__(self, at: pa.Array, n: pa.Array):
        ends = np.array([0, *np.cumsum(pc.binary_length(at).to_numpy(zero_copy_only=False))], np.int64) // 2
        self.rows, size = len(at), np.diff(ends)
        self.held = np.flatnonzero(size)
        self.start, self.size = ends[:-1][self.held], size[self.held]
        self.at = np.frombuffer(b"".join(at.to_pylist()), "<u2").astype(np.int64)
        self.n = np.frombuffer(b"".join(n.to_pylist()), "<u4")

    def scores(self, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The products of each row of weights with each held document's values."""
        return np.array([np.add.reduceat(w[self.at] * values, self.start) for w in weights])


def fit_topics(counts: np.ndarray, topics: int = TOPICS, rounds: int = 15, seed: int = 7) -> Topics:
    """Spherical k-means; the first centres are drawn by their distance from earlier ones.  Topics are numbered
    by size."""
    counts = counts[counts.sum(1) > 0]
    rarity = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1))
    x = np.log1p(counts) * rarity
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return Topics(rarity, np.empty((0, counts.shape[1])))
    rng, centres = np.random.default_rng(seed), [x[0]]
    while len(centres) < topics:
        far = np.clip(1 - (x @ np.array(centres).T).max(1), 0, None)
        if far.sum() < 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    centres = np.array(centres)
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (at == k).any():
                total = x[at == k].sum(0)
                centres[k] = total / max(np.linalg.norm(total), 1e-12)
    size = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    return Topics(rarity, centres[np.argsort(-size, kind="stable")])


def sampled_counts(docs: DataFrame, tokenizer_path: str, sample: int = SAMPLE) -> np.ndarray:
    """Term counts of ``sample`` documents at most, the first by a hash of id and text."""
    rows = docs.where(docs["text"].isNotNull()).select(F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("h"), docs["text"].cast("string").alias("text"))
    n = rows.count()
    bound = (1 << 63) - 1 if n <= 2 * sample else int((1 << 64) * (2 * sample / n)) - (1 << 63)

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            got = [term_counts(encoder.encode(t.as_py())) for t in batch.column(1)]
            held = [np.flatnonzero(c) for c in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64())), pa.array([c[h] for c, h in zip(got, held)], pa.list_(pa.int64()))], ["h", "at", "n"])

    drawn = rows.where(F.col("h") <= F.lit(bound)).orderBy("h", "text").limit(sample).mapInArrow(run, "h long, at array<long>, n array<long>").orderBy("h").collect()
    out = np.zeros((len(drawn), DIMENSIONS), np.int64)
    for row, r in zip(out, drawn):
        row[r["at"]] = r["n"]
    return out


def with_measures(docs: DataFrame, text: str, tokenizer_path: str, names: Sequence[str], keep_text: bool = True) -> DataFrame:
    """docs with their numbers of tokens and, if there are three names, their terms' dimensions and counts, under the names."""
    place, schema = docs.columns.index(text), StructType([f for f in docs.schema.fields if keep_text or f.name != text])
    for name, kind in zip(names, ("long", "binary", "binary")):
        schema = schema.add(name, kind)

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [encoder.encode(t.as_py() or "") for t in batch.column(place)]
                columns = [c for i, c in enumerate(batch.columns) if keep_text or i != place]
                columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                if len(names) > 1:
                    counts = [term_counts(x) for x in ids]
                    terms = [np.flatnonzero(c) for c in counts]
                    columns.append(pa.array([t.astype("<u2").tobytes() for t in terms], pa.binary()))
                    columns.append(pa.array([c[t].astype("<u4").tobytes() for c, t in zip(counts, terms)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def _start(rows: DataFrame, sample: int) -> Topics:
    """fit_topics() over the documents that sampled_counts() takes, whose terms are there already."""
    n = rows.where("h IS NOT NULL").count()
    bound = (1 << 63) - 1 if n <= 2 * sample else int((1 << 64) * (2 * sample / n)) - (1 << 63)
    drawn = rows.where(F.col("h") <= F.lit(bound)).orderBy("h").limit(sample).collect()
    counts = np.zeros((len(drawn), DIMENSIONS), np.int64)
    for row, r in zip(counts, drawn):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    return fit_topics(counts)


def fit_all(rows: DataFrame, sample: int = SAMPLE, rounds: int = TOPIC_ROUNDS) -> Topics:
    """Spherical k-means over all documents.  rows: h (a hash of id and text; null for null texts), at and n (terms).

    A round is a pass whose tasks give the sums of their unit vectors by centre; the driver holds the centres."""
    start = _start(rows, sample)
    if not len(start.centres):
        return start
    terms = rows.select("at", "n")

    def rare(batches):
        found, held = np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            t = Terms(b.column(0), b.column(1))
            found += np.bincount(t.at, minlength=DIMENSIONS)
            held += len(t.held)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int64()), pa.array([held, *found.tolist()], pa.int64())], ["place", "v"])

    def total(run, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for r in terms.mapInArrow(run, "place long, v long").groupBy("place").agg(F.sum("v").alias("v")).collect():
            out[r.place + 1] = r.v
        return out

    found = total(rare, DIMENSIONS + 1)
    rarity, centres = np.log((found[0] + 1) / (found[1:] + 1)), start.centres

    def sums(centres: np.ndarray):
        def run(batches):
            out = np.zeros((len(centres), DIMENSIONS + 1))
            for b in batches:
                t = Terms(b.column(0), b.column(1))
                if not len(t.held):
                    continue
                x = np.log1p(t.n) * rarity[t.at]
                norm = np.sqrt(np.add.reduceat(x * x, t.start))
                k = t.scores(centres, x).argmax(0)
                some = norm > 0
                out[:, 0] += np.bincount(k[some], minlength=len(centres))
                x = x / np.repeat(np.where(some, norm, 1.0), t.size)
                out[:, 1:] += np.bincount(np.repeat(k, t.size) * DIMENSIONS + t.at, x, len(centres) * DIMENSIONS).reshape(len(centres), -1)
            out[:, 1:] *= _FINE
            flat = np.rint(out.ravel()).astype(np.int64)
            place = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(place - 1), pa.array(flat[place])], ["place", "v"])

        return total(run, centres.size + len(centres)).reshape(len(centres), -1)

    for _ in range(rounds):
        got = sums(centres)
        new = got[:, 1:] / _FINE
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(got[:, :1] > 0, new / np.maximum(norm, 1e-12), centres)
        still = np.abs(new - centres).max() < 1e-9
        centres = new
        if still:
            break
    else:
        got = sums(centres)
    return Topics(rarity, centres[np.argsort(-got[:, 0], kind="stable")])


def topic_of(topics: Topics, at: Column, n: Column) -> Column:
    """The topic of each row's terms."""

    @F.arrow_udf("string")
    def run(at: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(topics.of_all(Terms(at, n)), pa.string())

    return run(at, n)


def tempered(tokens: np.ndarray, power: float) -> np.ndarray:
    """Shares of the cells in proportion to their tokens to a power below one: rare cells gain.  Margins are summed
    from these shares, so that targets never contradict each other, however margins depend on one another."""
    raised = np.where(tokens > 0, np.maximum(tokens, 1.0) ** power, 0.0)
    return raised / max(raised.sum(), 1.0)


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], tolerance: float = TOLERANCE, rounds: int = RAKING_ROUNDS) -> np.ndarray:
    """Weights per cell such that the weighted tokens' shares meet every marginal's targets."""
    w = np.ones(len(tokens))
    total = tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, w * tokens, len(target))
            scale = np.divide(target * total, have, out=np.ones_like(have), where=have > 0)
            worst = max(worst, float(np.abs(scale - 1)[have > 0].max(initial=0.0)))
            w *= scale[code]
        if worst <= tolerance:
            break
    else:
        _unmet(worst)
    return w


def _unmet(worst: float) -> None:
    """Targets that contradict each other, or cells that are missing, leave marginals apart from them."""
    if worst > 1e-6:
        warnings.warn(f"after {RAKING_ROUNDS} rounds a marginal is still off by a factor of {1 + worst:.6g}", stacklevel=3)


def rate_for(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """The rate r at which sum(tokens * min(1, r * weights)) is the budget, or all if it can't be met."""
    if budget >= tokens[weights > 0].sum():
        return float("inf")
    order = np.argsort(-weights)
    t, w = tokens[order], weights[order]
    full = np.concatenate(([0.0], np.cumsum(t)))
    part = np.concatenate((np.cumsum((t * w)[::-1])[::-1], [0.0]))
    for i in range(len(t)):  # the i heaviest cells are taken whole
        if part[i] > 0:
            r = (budget - full[i]) / part[i]
            if r * w[i] <= 1:
                return max(r, 0.0)
    return float("inf")


def plan(docs: DataFrame, ws: Workspace, share: float, power: float, targets: dict[str, dict] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """A table of the margins, tokens, documents, weight and probability of each cell.  docs: source, lang,
    topic, tokens.  Cells are summed before the shuffle, so a hot source is a few rows."""
    cells = ws.save(docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    if cells.limit(driver_cells + 1).count() > driver_cells:
        return _plan_by_spark(cells, ws, share, power, targets)
    held = [tuple(r) for r in cells.orderBy(*MARGINS).collect()]
    tokens = np.array([r[3] for r in held], float)
    codes, arrays, shares = [], [], tempered(tokens, power)
    for i, m in enumerate(MARGINS):
        values = {v: k for k, v in enumerate(dict.fromkeys(r[i] for r in held))}
        code = np.array([values[r[i]] for r in held], np.int64)
        have = dict(zip(values, np.bincount(code, tokens, len(values)).tolist() if held else []))
        own = dict(zip(values, np.bincount(code, shares, len(values)).tolist() if held else []))
        goal = _normal(targets[m] if targets and m in targets else own, have)
        codes.append(code)
        arrays.append(np.array([goal.get(v, 0.0) for v in values]))
    weights = rake(codes, tokens, arrays) if tokens.sum() else np.ones(len(held))
    rate = rate_for(tokens, weights, share * tokens.sum()) if held else 1.0
    taken = np.where(weights > 0, np.minimum(1.0, rate * np.where(weights > 0, weights, 1.0)), 0.0)
    # as an Arrow table: plain rows would start a second set of Python workers in every executor
    kinds = {"source": pa.string(), "lang": pa.string(), "topic": pa.string(), "tokens": pa.int64(), "n_docs": pa.int64(), "weight": pa.float64(), "probability": pa.float64()}
    columns = [*[[r[i] for r in held] for i in range(5)], weights, taken]
    return ws.save(docs.sparkSession.createDataFrame(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), columns)})))


def _normal(goal: dict, have: dict) -> dict:
    """Targets over the values that have tokens, adding up to one."""
    goal = {k: v for k, v in goal.items() if have.get(k, 0) > 0}
    s = sum(goal.values())
    return {k: v / s for k, v in goal.items()} if s else {}


def _plan_by_spark(cells: DataFrame, ws: Workspace, share: float, power: float, targets: dict[str, dict] | None, tolerance: float = TOLERANCE, rounds: int = RAKING_ROUNDS) -> DataFrame:
    """The same for more cells than the driver should hold: each scaling is an aggregate and a join."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {}
    for m in MARGINS:
        if targets and m in targets:
            goal = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], "value string, goal double")
        else:
            goal = cells.groupBy(F.col(m).alias("value")).agg(F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), power)).otherwise(0.0)).alias("goal"))
        known = cells.where("tokens > 0").select(F.col(m).alias("value")).distinct()
        goal = goal.join(known, goal["value"].eqNullSafe(known["value"]), "left_semi")
        s = goal.agg(F.sum("goal")).first()[0] or 1.0
        goals[m] = ws.save(goal.select("value", (F.col("goal") / s).alias("goal")))
    now = ws.save(cells.withColumn("weight", F.lit(1.0)))
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            have = now.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have")).where("have > 0")
            scale = ws.save(have.join(goals[m], have["value"].eqNullSafe(goals[m]["value"]), "left").select(have["value"], (F.coalesce("goal", F.lit(0.0)) * total / F.col("have")).alias("scale")))
            worst = max(worst, scale.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            old = now
            now = ws.save(now.join(scale, now[m].eqNullSafe(scale["value"]), "left").withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0))).select(*old.columns))
            ws.drop(old, scale)
        if worst <= tolerance:
            break
    else:
        _unmet(worst)
    low, high = 0.0, (now.agg(F.max(F.when(F.col("weight") > 0, 1 / F.col("weight")))).first()[0] or 1.0)
    for _ in range(60):  # bisection on one number
        mid = (low + high) / 2
        got = now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * mid))).first()[0] or 0.0
        low, high = (mid, high) if got < share * total else (low, mid)
    return ws.save(now.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * high)))


def unit(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) by doc_id, or by the text where there is none; 13 hex digits fit a double."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.sha2(text.cast("string"), 256), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _hash(docs: DataFrame) -> Column:
    return F.when(docs["text"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))


def _with_cells(rows: DataFrame, cells: DataFrame, names: dict[str, str], own: dict[str, str]) -> DataFrame:
    """rows joined with their cells' weight and probability; a margin's null is a value like others.  Beyond the
    size for a broadcast a cell with very many rows is split by adaptive execution."""
    cells = cells.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = None
    for m in MARGINS:
        c = F.col(own[m]).eqNullSafe(F.col(names[m]))
        same = c if same is None else same & c
    return rows.join(small_or_shuffled(cells), same)


def mix(
    docs: DataFrame, tokenizer_path: str, share: float = 0.8, power: float = 0.8, seed: int = 42, targets: dict[str, dict] | None = None, topic: str | None = None, driver_cells: int = DRIVER_CELLS
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, taken for every row of docs.

    share: the expected part of all tokens that is taken.  targets: margin -> {value: share}; a margin
    without targets gets the sums of its cells' tokens to the ``power``.  topic: a column of docs, else topics are
    fitted.  Null sources, languages and topics are values of their own; null and empty texts have no tokens
    and the topic none, and get their cell's probability; repeated rows are taken together, as doc_id
    decides, and rows without one by their texts.  Values without a target aren't taken.  An empty table
    gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), *([docs[topic].cast("string").alias("topic")] if topic else []),
        unit(docs["doc_id"].cast("long"), docs["text"], seed).alias("unit"), _hash(docs).alias("h"), docs["text"].cast("string").alias("text"),
    )
    rows = ws.save(with_measures(rows, "text", tokenizer_path, ("tokens",) if topic else ("tokens", "at", "n"), keep_text=False))
    if not topic:
        measured, rows = rows, ws.save(rows.withColumn("topic", topic_of(fit_all(rows), F.col("at"), F.col("n"))).drop("h", "at", "n"))
        ws.drop(measured)
    names = {m: f"cell_{m}" for m in MARGINS} | {"weight": "weight", "probability": "probability"}
    joined = _with_cells(rows, plan(rows, ws, share, power, targets, driver_cells), names, {m: m for m in MARGINS})
    return joined.select("doc_id", *MARGINS, "tokens", "weight", "probability", (F.col("unit") < F.col("probability")).alias("taken"))


def keep_mixed(docs: DataFrame, tokenizer_path: str, share: float = 0.8, power: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of docs that mix() takes, with all their columns, in no new order.  Documents are written once
    with their measures, so that none is tokenized twice; texts aren't shuffled while the cells are small."""
    ws = Workspace(docs.sparkSession)
    own = {m: fresh(docs, f"mix_{m}") for m in (*MARGINS, "tokens", "unit", "h", "at", "n")}
    rows = docs.select(
        *[docs[c] for c in docs.columns], docs["source"].cast("string").alias(own["source"]), docs["lang"].cast("string").alias(own["lang"]),
        unit(docs["doc_id"].cast("long"), docs["text"], seed).alias(own["unit"]), _hash(docs).alias(own["h"]),
    )
    rows = ws.save(with_measures(rows, "text", tokenizer_path, (own["tokens"], own["at"], own["n"])))
    topics = fit_all(rows.select(*[F.col(own[c]).alias(c) for c in ("h", "at", "n")]))
    rows = rows.withColumn(own["topic"], topic_of(topics, F.col(own["at"]), F.col(own["n"])))
    cells = plan(rows.select(*[F.col(own[m]).alias(m) for m in MARGINS], F.col(own["tokens"]).alias("tokens")), ws, share, power)
    names = {m: fresh(docs, f"cell_{m}") for m in MARGINS} | {"probability": fresh(docs, "cell_probability")}
    joined = _with_cells(rows, cells, names, own)
    return joined.where(F.col(own["unit"]) < F.col(names["probability"])).select(*[F.col(f"`{c}`") for c in docs.columns])
