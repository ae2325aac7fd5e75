"""Line deduplication by an exact set-similarity join.

A line's tokens are its different lower-cased words.  Two lines match if the Jaccard similarity of their
token sets reaches ``threshold``; a line that matches an earlier one (by doc_id, then place) is removed,
whether or not the earlier one stays.  Equal sets are told by 128-bit hashes of whole tokens, other
matches are verified on their token sets.

1. One pass gives every line's set hash, and counts all tokens in a fixed number of hashed counters.
   Of equal sets only the first line goes on, so a line which millions of documents share is one row.
2. Rarity: tokens are ordered by their counters.  Any total order makes the join exact, so collisions cost
   speed only, and the counters' size doesn't grow.  Every line gives its size, a 256-bit signature and
   its prefix: with the tokens in that order, matching lines share a token of their prefixes.
3. Postings are dealt by token.  Within a token's postings each line is compared with earlier ones under the
   length, positional and signature filters up to the first that passes, so that a group of near copies
   gives no pairs beyond a few for each line.  A token with more than HOT postings is dealt in chunks.
4. Candidates are verified on their token sets.  A line none of whose candidates matched, or one with a
   chunked token, is then joined with all earlier lines under the same filters.
5. Removed lines join back to their documents by place, and the texts are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfield.llm.shared import Workspace, fresh, only, small_or_shuffled

THRESHOLD = (4, 5)  # similarity 0.8 as a fraction, so that bounds are exact
MIN_TOKENS = 1
COUNTERS = 1 << 18
#: Postings of a token beyond which they are dealt in chunks.
HOT = 4096
_TEXT_BLOCK = 1 << 21
_POST_BLOCK = 1 << 17
#: A place is a line's number; rows that repeat a doc_id with another text add a multiple of this.
_ROW = 1 << 40
_SIGNS = ("s0", "s1", "s2", "s3")


def _lines(texts: list[str | None]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All lines of the texts in lower case, and the number of the first line of each text."""
    texts = [t or "" for t in texts]
    n = np.array([t.count("\n") + 1 for t in texts])
    lines = pc.split_pattern(pa.array(["\n".join(texts).lower()], pa.large_string()), "\n").flatten()
    return lines, np.concatenate(([0], np.cumsum(n)[:-1]))


class Tokens:
    """The tokens of lines, runs of other than ASCII white space: the line each is on, its number among the
    different ones, and those ones' 128-bit hashes as two halves."""

    def __init__(self, lines: pa.LargeStringArray):
        words = pc.ascii_split_whitespace(lines)
        coded = words.flatten().dictionary_encode()
        code, vocabulary = coded.indices.to_numpy(), coded.dictionary
        line = np.repeat(np.arange(len(lines)), np.diff(words.offsets.to_numpy()))
        at = np.frombuffer(vocabulary.buffers()[1], np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1].tolist() if len(vocabulary) else [0]
        data = vocabulary.buffers()[2].to_pybytes() if at[-1] else b""
        digest = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([digest(data[i:j]) for i, j in zip(at, at[1:])]), np.uint64).reshape(-1, 2)
        self.low, self.high = halves[:, 0].copy(), halves[:, 1].copy()
        held = (np.diff(at) > 0)[code] if len(code) else np.empty(0, bool)  # white space around a line gives empty words
        self.line, self.code = line[held], code[held].astype(np.int64)

    def sets(self, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines with tokens, the number of different tokens of each, and these, line by line in the
        order of rank, then hash."""
        by = np.argsort(self.low) if rank is None else np.lexsort((self.high, self.low, rank))
        order = np.empty(len(by), np.int64)
        order[by] = np.arange(len(by))
        bits = max(len(by).bit_length(), 1)
        key = np.sort((self.line << bits) | order[self.code])
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        line = key >> bits
        first = np.ones(len(line), bool)
        first[1:] = line[1:] != line[:-1]
        start = np.flatnonzero(first)
        return line[start], np.diff(np.append(start, len(line))), by[key & ((1 << bits) - 1)]


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)


def _marks(tokens: Tokens, n: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's hash."""
    start = _starts(n)
    return np.add.reduceat(tokens.low[token], start).view(np.int64), np.add.reduceat(tokens.high[token], start).view(np.int64)


def _blocks(text: pa.Array, *columns: pa.Array) -> Iterator[list[list]]:
    """Rows in runs of some megabytes of text, as lists; this bounds what one run holds."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + _TEXT_BLOCK, side="right")))
        yield [c.slice(at, end - at).to_pylist() for c in (text, *columns)]
        at = end


# ---- first pass: set hashes and token counts

_KEYS = "doc_id long, place long, k1 long, k2 long, more array<long>, slice long, task long, counts binary"
_KEY_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
_KEY_NAMES = [c.split()[0] for c in _KEYS.split(", ")]
_SLICE = 1 << 12


def _key_rows(texts: list, ids: list, bases: list, tokens: Tokens, first_line: np.ndarray, min_tokens: int) -> list | None:
    used, n, token = tokens.sets()
    if not len(used):
        return None
    k1, k2 = _marks(tokens, n, token)
    owner = np.searchsorted(first_line, used, side="right") - 1
    place = used - first_line[owner] + np.asarray(bases, np.int64)[owner]
    pick = np.lexsort((used, k2, k1, owner))
    pick = pick[n[pick] >= min_tokens]
    if not len(pick):
        return None
    head = np.ones(len(pick), bool)
    head[1:] = (k1[pick][1:] != k1[pick][:-1]) | (k2[pick][1:] != k2[pick][:-1]) | (owner[pick][1:] != owner[pick][:-1])
    again = np.diff(np.append(np.flatnonzero(head), len(pick))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(again))).astype(np.int32)), pa.array(place[pick[~head]]))
    pick = pick[head]
    return [pa.array(np.asarray(ids, np.int64)[owner[pick]]), *[pa.array(x[pick]) for x in (place, k1, k2)], more]


def read_keys(rows: DataFrame, min_tokens: int) -> DataFrame:
    """A row per document and set, doc_id, place, k1, k2, more (places where the set comes again); and each
    task's token counters, in slices."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for texts, ids, bases in _blocks(batch.column(2), batch.column(0), batch.column(1)):
                lines, first_line = _lines(texts)
                tokens = Tokens(lines)
                np.add.at(counts, (tokens.low & np.uint64(COUNTERS - 1)).astype(np.int64), np.bincount(tokens.code, minlength=len(tokens.low)))
                if (got := _key_rows(texts, ids, bases, tokens, first_line, min_tokens)) is not None:
                    yield pa.RecordBatch.from_arrays([*got, *[pa.nulls(len(got[0]), t) for t in _KEY_TYPES[5:]]], _KEY_NAMES)
        task = TaskContext.get().partitionId() // 256
        held = [s for s in range(0, COUNTERS, _SLICE) if counts[s : s + _SLICE].any()]
        if held:
            sums = [pa.array([s // _SLICE for s in held], pa.int64()), pa.array([task] * len(held), pa.int64()), pa.array([counts[s : s + _SLICE].tobytes() for s in held], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(held), t) for t in _KEY_TYPES[:5]], *sums], _KEY_NAMES)

    return rows.mapInArrow(run, _KEYS)


def token_counts(keys: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: 256 of them at most at first, then the sums."""

    def total(rows):
        import pandas as pd

        out = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"slice": rows["slice"][:1], "task": rows["task"][:1], "counts": [out.tobytes()]})

    schema = "slice long, task long, counts binary"
    out = np.zeros(COUNTERS, np.int64)
    sums = keys.where("counts is not null").select("slice", "task", "counts").groupBy("slice", "task").applyInPandas(total, schema)
    for r in sums.groupBy("slice").applyInPandas(total, schema).collect():
        out[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(r.counts, np.int64)
    return out


# ---- second pass: sets with their prefixes

_SETS = "first long, place long, n int, s0 long, s1 long, s2 long, s3 long, light int, prefix array<long>"


def _set_rows(texts: list, ids: list, bases: list, skips: list, counts: np.ndarray, threshold: tuple[int, int], least: int, hot: int = HOT) -> list | None:
    """Arrays of _SETS for the lines of the texts, without those at the places to skip.

    A signature has the parity of the tokens of each bit's class, so that different bits are never more
    than different tokens."""
    lines, first_line = _lines(texts)
    keep = np.ones(len(lines), bool)
    for at, base, skip in zip(first_line.tolist(), bases, skips):
        if skip is not None:
            keep[np.asarray(skip, np.int64) - base + at] = False
    number = np.flatnonzero(keep)
    tokens = Tokens(lines.filter(pa.array(keep)))
    seen = counts[(tokens.low & np.uint64(COUNTERS - 1)).astype(np.int64)]
    used, n, token = tokens.sets(seen)
    enough = n >= least
    if not enough.any():
        return None
    token, used, n = token[np.repeat(enough, n)], number[used[enough]], n[enough]
    start = _starts(n)
    owner = np.searchsorted(first_line, used, side="right") - 1
    place = used - first_line[owner] + np.asarray(bases, np.int64)[owner]
    bit, word = np.uint64(1) << (tokens.high & np.uint64(63)), (tokens.high >> np.uint64(6)) & np.uint64(3)
    signs = [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0))[token], start).view(np.int64) for w in range(4)]
    p, q = threshold
    prefix = n - (p * n + q - 1) // q + 1
    within = np.arange(len(token)) - np.repeat(start, n)
    chosen = within < np.repeat(prefix, n)
    offsets = np.concatenate(([0], np.cumsum(prefix)))
    light = np.add.reduceat((seen[token[chosen]] <= hot).astype(np.int64), offsets[:-1])
    return [
        pa.array(np.asarray(ids, np.int64)[owner]), pa.array(place), pa.array(n.astype(np.int32)), *[pa.array(s) for s in signs], pa.array(light.astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.low[token[chosen]].view(np.int64))),
    ]


def line_sets(rows: DataFrame, counts: np.ndarray, threshold: tuple[int, int], min_tokens: int, hot: int = HOT) -> DataFrame:
    """rows: doc_id, base, text, skip.  light is the number of prefix tokens that can't be hot; they come first.

    Sets too small to match any but equal ones have no row."""
    p, q = threshold
    least = max(min_tokens, -(-p // (q - p)))
    names = [c.split()[0] for c in _SETS.split(", ")]

    def run(batches):
        for batch in batches:
            for part in _blocks(*[batch.column(i) for i in (2, 0, 1, 3)]):
                if (got := _set_rows(*part, counts, threshold, least, hot)) is not None:
                    yield pa.RecordBatch.from_arrays(got, names)

    return rows.select("doc_id", "base", "text", "skip").mapInArrow(run, _SETS)


# ---- candidates

_POST = ("first", "place", "n", "pos", *_SIGNS)
_PAIR = "first_a long, place_a long, first_b long, place_b long"


def _posts(sets: DataFrame) -> DataFrame:
    """A row per prefix token; a set is told by its first place."""
    return sets.select(F.posexplode("prefix").alias("pos", "token"), "first", "place", "n", *_SIGNS)


def _passing(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether postings x and y of one token pass the length, positional and signature filters.

    The positional bound is that of the first common token, which both prefixes have if the sets match."""
    p, q = threshold
    nx, ny = c["n"][x], c["n"][y]
    need = (p * (nx + ny) + (p + q) - 1) // (p + q)  # common tokens at least
    ok = (q * nx >= p * ny) & (q * ny >= p * nx) & (np.minimum(nx - c["pos"][x], ny - c["pos"][y]) >= need)
    at = np.flatnonzero(ok)
    apart = np.zeros(len(at), np.int64)
    for s in _SIGNS:
        apart += np.bitwise_count((c[s][x[at]] ^ c[s][y[at]]).view(np.uint64))
    ok[at] = apart <= nx[at] + ny[at] - 2 * need[at]
    return ok


def _first_passing(c: dict[str, np.ndarray], threshold: tuple[int, int]) -> list[np.ndarray]:
    """For each posting the first earlier one of its list that passes, if any does."""
    new = np.ones(len(c["token"]), bool)
    new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["chunk"][1:] != c["chunk"][:-1])
    run = np.cumsum(new)
    order = np.lexsort((c["place"], c["first"], run))
    c = {k: v[order] for k, v in c.items()}
    start = np.flatnonzero(new)[run - 1]
    y, k, found = np.flatnonzero(~new), 0, []
    while len(y):
        x = start[y] + k
        ok = _passing(c, x, y, threshold)
        found.append((x[ok], y[ok]))
        y = y[~ok]
        k += 1
        y = y[start[y] + k < y]
    x, y = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    return [c["first"][x], c["place"][x], c["first"][y], c["place"][y]]


def _search(dealt: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Candidates among postings that are sorted by token and chunk; lists are held whole, and HOT bounds
    what a list can be."""
    names = ["token", "chunk", *_POST]

    def run(batches):
        def search(parts):
            c = {k: np.concatenate([b[i] for b in parts]) for i, k in enumerate(names)}
            rows = [pa.array(a) for a in _first_passing(c, threshold)]
            return pa.RecordBatch.from_arrays(rows, ["first_a", "place_a", "first_b", "place_b"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(len(names))]
            # up to where the batch's last list begins, all lists are complete
            token, chunk = columns[0], columns[1]
            edge = np.flatnonzero((token != token[-1]) | (chunk != chunk[-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0
            size += len(token)
            if size >= _POST_BLOCK and (cut or held and (held[-1][0][-1] != token[0] or held[-1][1][-1] != chunk[0])):
                yield search([*held, [c[:cut] for c in columns]])
                held, size = [[c[cut:] for c in columns]], len(token) - cut
            else:
                held.append(columns)
        if held:
            yield search(held)

    return dealt.select(*names).mapInArrow(run, _PAIR)


def _may_match(threshold: tuple[int, int]) -> Column:
    """_passing() as a condition on postings x and y."""
    p, q = threshold
    x, y = ({c: F.col(f"{e}.{c}") for c in _POST} for e in "xy")
    need = F.floor((p * (x["n"] + y["n"]) + (p + q) - 1) / (p + q))
    apart = sum((F.bit_count(x[s].bitwiseXOR(y[s])) for s in _SIGNS[1:]), F.bit_count(x["s0"].bitwiseXOR(y["s0"])))
    return (q * x["n"] >= p * y["n"]) & (q * y["n"] >= p * x["n"]) & (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= need) & (apart <= x["n"] + y["n"] - 2 * need)


def _all_earlier(sets: DataFrame, open_: DataFrame, ws: Workspace, threshold: tuple[int, int]) -> DataFrame:
    """Candidates of the open lines (first, place) among all earlier lines."""
    late = ws.save(_posts(sets.join(small_or_shuffled(open_), ["first", "place"], "left_semi")))
    x, y = _posts(sets).alias("x"), small_or_shuffled(late).alias("y")
    before = (F.col("x.first") < F.col("y.first")) | ((F.col("x.first") == F.col("y.first")) & (F.col("x.place") < F.col("y.place")))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & before & _may_match(threshold))
    return pairs.select(*[F.col(f"{e}.{c}").alias(f"{c}_{n}") for e, n in (("x", "a"), ("y", "b")) for c in ("first", "place")]).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, ws: Workspace, threshold: tuple[int, int]) -> DataFrame:
    """(first, place) of the later lines of those pairs whose token sets really match."""
    end = lambda e: pairs.select(F.col(f"first_{e}").alias("doc_id"), F.col(f"place_{e}").alias("place"))
    wanted = end("a").unionAll(end("b")).distinct().groupBy("doc_id", _base("place").alias("base")).agg(F.collect_list("place").alias("lines"))
    wanted = ws.save(wanted)
    exact = ws.save(_exact_sets(rows, wanted))
    p, q = threshold
    joined = pairs.join(exact.toDF("first_a", "place_a", "tokens_a"), ["first_a", "place_a"]).join(exact.toDF("first_b", "place_b", "tokens_b"), ["first_b", "place_b"])
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    hits = joined.where(q * common >= p * (F.size("tokens_a") + F.size("tokens_b") - common))
    out = ws.save(hits.select(F.col("first_b").alias("first"), F.col("place_b").alias("place")).distinct())
    ws.drop(wanted, exact)
    ws.free()
    return out


def _base(place: str) -> Column:
    return F.shiftright(place, 40) * F.lit(_ROW)


def _exact_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, place, tokens) of the lines at the wanted places; tokens go as 64 bits of their hashes."""
    found = rows.join(small_or_shuffled(wanted), ["doc_id", "base"])

    def run(batches):
        for batch in batches:
            for texts, ids, bases, places in _blocks(*[batch.column(i) for i in (2, 0, 1, 3)]):
                body = [t.split("\n") for t in texts]
                lines = [b[p - base] for b, base, ps in zip(body, bases, places) for p in ps]
                tokens = Tokens(pa.array([x.lower() for x in lines], pa.large_string()))
                used, n, token = tokens.sets()
                count = np.zeros(len(lines), np.int64)
                count[used] = n
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(tokens.low[token].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, ps in zip(ids, places) for _ in ps], pa.int64()), pa.array([p for ps in places for p in ps], pa.int64()), sets], ["doc_id", "place", "tokens"])

    return found.select("doc_id", "base", "text", "lines").mapInArrow(run, "doc_id long, place long, tokens array<long>")


# ---- what goes


def repeated_ids(rows: DataFrame, ws: Workspace) -> DataFrame | None:
    """(doc_id, digest, base) of rows that share a doc_id: a multiple of _ROW for each different text; None if
    no two rows do."""
    many = ws.save(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if many.isEmpty():
        return None
    texts = rows.join(small_or_shuffled(many), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    return ws.save(texts.select("doc_id", "digest", ((nth - 1).cast("long") * F.lit(_ROW)).alias("base")))


def removals(rows: DataFrame, ws: Workspace, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS, bases: DataFrame | None = None, most: int = HOT) -> DataFrame:
    """(doc_id, base, gone): the places of the lines that each document loses.  rows: doc_id, text; bases:
    repeated_ids()."""
    if bases is None:
        rows = rows.select("doc_id", F.lit(0).cast("long").alias("base"), "text")
    else:
        # rows that repeat both doc_id and text count once
        rows = rows.withColumn("digest", F.sha2("text", 256)).join(small_or_shuffled(bases), ["doc_id", "digest"], "left")
        rows = ws.save(rows.select("doc_id", F.coalesce("base", F.lit(0).cast("long")).alias("base"), "text").dropDuplicates(["doc_id", "base"]))
    keys = ws.save(read_keys(rows, min_tokens))
    counts = token_counts(keys)
    own = keys.where("counts is null").select("doc_id", "place", "k1", "k2", "more")
    # equal sets: all but the first place go
    first = F.min("doc_id").alias("first") if bases is None else F.min(F.struct("doc_id", _base("place"))).alias("first")
    shared = ws.save(own.groupBy("k1", "k2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"))
    here = F.col("doc_id") if bases is None else F.struct("doc_id", _base("place"))
    later = own.select("doc_id", "place", "k1", "k2").join(small_or_shuffled(shared), ["k1", "k2"]).where(here > F.col("first")).select("doc_id", "place")
    again = own.where("more is not null").select("doc_id", F.explode("more").alias("place"))
    equal = later.unionAll(again).groupBy("doc_id", _base("place").alias("base")).agg(F.collect_set("place").alias("skip"))
    equal = ws.save(equal)
    ws.drop(keys, shared)
    ws.free()
    once = rows.join(small_or_shuffled(equal), ["doc_id", "base"], "left")
    sets = ws.save(line_sets(once, counts, threshold, min_tokens, most))
    tail = sets.where("light < size(prefix)").select("first", "place", F.explode(F.slice("prefix", F.col("light") + 1, F.size("prefix"))).alias("token"))
    hot = ws.save(tail.groupBy("token").count().where(F.col("count") > most).select("token", F.ceil(F.col("count") / most).alias("chunks")))
    posts = _posts(sets)
    some = not hot.isEmpty()
    chunk = F.pmod(F.xxhash64("first", "place"), "chunks")
    posts = posts.join(small_or_shuffled(hot), "token", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0))) if some else posts.withColumn("chunk", F.lit(0).cast("long"))
    dealt = posts.repartition("token", "chunk").sortWithinPartitions("token", "chunk")
    pairs = ws.save(_search(dealt, threshold).distinct())
    ws.free()
    lost = _verified(pairs, rows, ws, threshold)
    # lines that may still match: those with false candidates, and those of chunked tokens
    open_ = pairs.select(F.col("first_b").alias("first"), F.col("place_b").alias("place"))
    if some:
        open_ = open_.unionAll(tail.join(small_or_shuffled(hot), "token", "left_semi").select("first", "place"))
    open_ = ws.save(open_.distinct().join(small_or_shuffled(lost), ["first", "place"], "left_anti"))
    if not open_.isEmpty():
        found = ws.save(_all_earlier(sets, open_, ws, threshold).join(small_or_shuffled(pairs), _PAIR.replace(" long", "").split(", "), "left_anti"))
        ws.free()
        if not found.isEmpty():
            lost = lost.unionAll(_verified(found, rows, ws, threshold))
    near = lost.distinct().groupBy(F.col("first").alias("doc_id"), _base("place").alias("base")).agg(F.collect_list("place").alias("skip"))
    out = ws.save(equal.unionByName(near).groupBy("doc_id", "base").agg(F.flatten(F.collect_list("skip")).alias("gone")))
    ws.drop(equal, sets, hot, pairs, open_)
    ws.free()
    return out


def own_repeats(text: str, min_tokens: int) -> list[int]:
    """The places of a text's lines that are equal as sets to earlier ones of that text."""
    tokens = Tokens(_lines([text])[0])
    used, n, token = tokens.sets()
    if not len(used):
        return []
    seen, out = set(), []
    for at, size, mark in zip(used.tolist(), n.tolist(), zip(*(k.tolist() for k in _marks(tokens, n, token)))):
        if size >= min_tokens:
            if mark in seen:
                out.append(at)
            seen.add(mark)
    return out


def dedup_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS, names: dict[str, str] | None = None, hot: int = HOT) -> DataFrame:
    """docs with their texts rewritten, and n_lines and n_removed, the lines before and those removed (or
    under ``names``).  Postings of a token are dealt in chunks of about ``hot``.

    Lines with fewer than ``min_tokens`` different tokens always stay, and lines without a token do.  Rows
    that share a doc_id and a text are one document; rows that share only a doc_id are ordered by their
    texts' digests.  Within a text, a line equal as a set to an earlier one of that text is removed as
    well.  A null text stays null and counts nothing; a row without doc_id loses only its own repeats.  A
    text all of whose lines go becomes empty.  Empty tables give empty results; columns that clash with
    the new ones are replaced by them.
    """
    names = names or {k: k for k in ("n_lines", "n_removed")}
    ws = Workspace(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in names.values()])
    key, digest, base, gone = (fresh(docs, f"line_{n}") for n in ("doc", "digest", "base", "gone"))
    rows = only(docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull()), doc_id="long", text="string")
    bases = repeated_ids(rows, ws)
    taken = removals(rows, ws, threshold, min_tokens, bases, hot).select(F.col("doc_id").alias(key), F.col("base").alias(base), F.col("gone").alias(gone))
    same = docs["doc_id"].cast("long") == F.col(key)
    if bases is None:
        joined = docs.join(small_or_shuffled(taken.drop(base)), same, "left").drop(key)
    else:
        which = small_or_shuffled(bases.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.col("base").alias(base)))
        marked = docs.join(which, same & (F.sha2(docs["text"].cast("string"), 256) == F.col(digest)), "left").drop(key, digest)
        taken = small_or_shuffled(taken.withColumnRenamed(base, digest))
        joined = marked.join(taken, (marked["doc_id"].cast("long") == F.col(key)) & (F.coalesce(base, F.lit(0).cast("long")) == F.col(digest)), "left").drop(key, base, digest)
    place, ids, schema = docs.columns.index("text"), docs.columns.index("doc_id"), StructType(list(docs.schema.fields))
    for n in names.values():
        schema = schema.add(n, "long")

    def run(batches):
        for batch in batches:
            cut, body = batch.column(len(batch.columns) - 1), batch.column(place).cast(pa.large_string())
            held = body.is_valid().to_numpy(zero_copy_only=False)
            n_lines = np.where(held, pc.fill_null(pc.count_substring(body, "\n"), 0).to_numpy(zero_copy_only=False) + 1, 0)
            removed = np.zeros(len(body), np.int64)
            # only texts that may lose lines become Python strings
            touched = np.asarray(pc.or_(cut.is_valid(), batch.column(ids).is_null()).to_numpy(zero_copy_only=False)) & held
            new = []
            for i in np.flatnonzero(touched).tolist():
                t, g = body[i].as_py(), cut[i].as_py()
                drop = {p % _ROW for p in g} if g else set(own_repeats(t, min_tokens))
                removed[i] = len(drop)
                new.append("\n".join([x for p, x in enumerate(t.split("\n")) if p not in drop]) if drop else t)
            columns = list(batch.columns)[:-1]
            if new:
                columns[place] = pc.replace_with_mask(body, pa.array(touched), pa.array(new, pa.large_string())).cast(columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in (n_lines, removed)]], schema.names)

    return joined.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed; a document of which no word is left goes, others stay, also those
    that had none before.  Null texts, null doc_ids, repeated rows and ties are as in dedup_lines(); columns
    stay as they are."""
    names = {k: fresh(docs, f"lines_{k}") for k in ("n_lines", "n_removed")}
    done = dedup_lines(docs, names=names)
    return done.where((F.col(names["n_removed"]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
