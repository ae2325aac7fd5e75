"""Prefix trie of conversations.

A node is a distinct sequence of first turns.  It is keyed by a 128-bit hash: the exclusive or of the hashes of its
turns, each hashed with its place, so that the keys of all prefixes are running values over a conversation's turns
in order.  Running values come from scan(): ranges of ordered rows are read one after the other, and what the ranges
before add to a conversation that spans several is joined on, so that a conversation with a third of all turns is
dealt over as many tasks as its turns fill.

The tries of the partitions are the partial aggregates by key (members, smallest member), and merging them sums by
key.  Lists of ended conversations merge in order of ids, in pieces of bounded length, of which each node's SHA-256
is taken as a stream.

For the roll-up, nodes with the same smallest member are a chain: they follow each other down the trie, and the next
chain begins where that member leaves.  Chain totals are summed up the tree of chains with doubled steps, so rounds
grow with the logarithm of its height, and running sums down to up within each chain give the subtrees of its nodes.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from loomfield.llm.shared import Workspace, only

#: Every so many conversations share a start, which is the first of them's.
FAMILY = 5
#: Most turns of a shared start.
SHARED = 8


def scan(rows: DataFrame, ws: Workspace, key: str, order: list[Column], adds: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """rows, written, with a running value under each name of ``adds`` (sums) and ``xors`` (exclusive or), the row's own
    included, over the rows of the same ``key`` in ``order``.  All named columns are long; key holds no null.

    Rows are dealt by ranges of (key, order); what goes through the driver is two keys a range and the totals of keys
    that span ranges, of which there are fewer than ranges."""
    names = [*adds, *xors]
    own = {c: f"{c}_own" for c in names}
    schema = StructType(rows.schema.fields)
    for c in [*own.values(), "range"]:
        schema = schema.add(c, LongType())

    def run(batches):
        part = TaskContext.get().partitionId()
        last, held = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in [key, *names]}
            keys = column[key].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]]))
            at = np.searchsorted(starts, np.arange(len(keys)), "right") - 1
            running = []
            for c in names:
                v = column[c].to_numpy(zero_copy_only=False)
                total = np.cumsum(v) if c in adds else np.bitwise_xor.accumulate(v)
                # what other keys had before in this batch is taken off again; rows at -1 go on with the last batch's key
                before = np.append(np.concatenate([[0], total[:-1]])[starts], -held[c] if c in adds else held[c])[at]
                out = total - before if c in adds else total ^ before
                held[c] = int(out[-1])
                running.append(out)
            last = keys[-1]
            arrays = [pa.array(running[names.index(f)]) if f in names else batch.column(i) for i, f in enumerate(batch.schema.names)]
            arrays += [column[c] for c in names] + [pa.array(np.full(len(keys), part, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    done = ws.save(dealt.mapInArrow(run, schema))
    edges = done.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    edges = sorted(edges, key=lambda r: r["range"])
    spanning = {b["low"] for a, b in zip(edges, edges[1:]) if a["high"] == b["low"]}
    if spanning:
        wide = ws.spark.createDataFrame([(k,) for k in sorted(spanning)], f"{key} long")
        totals = [F.sum(own[c]).alias(c) for c in adds] + [F.bit_xor(own[c]).alias(c) for c in xors]
        pieces = sorted(done.join(F.broadcast(wide), key).groupBy(key, "range").agg(*totals).collect(), key=lambda r: (r[key], r["range"]))
        carried, so_far = [], dict.fromkeys(names, 0)
        for before, r in zip([None, *pieces], pieces):
            if before is None or before[key] != r[key]:
                so_far = dict.fromkeys(names, 0)
            carried.append((r[key], r["range"], *[so_far[c] for c in names]))
            so_far = {c: so_far[c] + r[c] if c in adds else so_far[c] ^ r[c] for c in names}
        carry = ws.spark.createDataFrame(carried, f"{key} long, range long, " + ", ".join(f"{c}_carry long" for c in names))
        done = done.join(F.broadcast(carry), [key, "range"], "left")
        zero = lambda c: F.coalesce(f"{c}_carry", F.lit(0).cast("long"))
        done = done.withColumns({c: F.col(c) + zero(c) if c in adds else F.col(c).bitwiseXOR(zero(c)) for c in names})
    return done.select(*rows.columns, *own.values())


def turns(conversations: DataFrame, ws: Workspace) -> DataFrame:
    """(conv_id, place, digest, n_bytes), written: each turn's place from 1, the SHA-256 of its role and text, and
    the text's UTF-8 bytes.

    Turns are ordered by turn, null first, and those that tie by digest.  Null roles and texts are empty.  Rows
    without a conv_id belong to no conversation and are left out."""
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select("conv_id", "turn", F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("place"))
    return scan(rows, ws, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], adds=("place",)).select("conv_id", "place", "digest", "n_bytes")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation shares with the first of its family."""
    return F.crc32(conv.cast("string")) % (SHARED + 1)


def rebuilt(own: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv_id, length) of the rebuilt conversations: the first of the family's first turns, as
    many as are shared, then each one's own turns after as many; own is turns()' result."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = ws.save(own.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("family", family).withColumn("shared", shared_turns(F.col("conv_id"))))
    firsts = sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("there"))
    sizes = sizes.join(firsts, "family", "left").withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0).cast("long"))))
    sizes = ws.save(sizes.select("conv_id", "family", "shared", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("length")))
    start = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") <= SHARED)).withColumnRenamed("conv_id", "family")
    start = start.join(sizes, "family").where("place <= shared").select("conv_id", "place", "digest", "n_bytes", "length")
    rest = own.where(F.col("place") > shared_turns(F.col("conv_id"))).join(sizes, "conv_id")
    rest = rest.select("conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "digest", "n_bytes", "length")
    return start.unionAll(rest), sizes.select("conv_id", "length")


def ended(last: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ends_sha256: the SHA-256 of the comma-joined conv_ids of each key in ascending order.

    Ids are dealt by ranges of (keys, conv_id) and joined to pieces of a batch at most; then a key's pieces are
    hashed one after the other, so that no task holds a key's list."""
    head = ", ".join(f"{k} long" for k in keys)

    def table(rows, kinds, names):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def join(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, ids = [], batch.column(len(keys)).to_pylist()
            for key, run in groupby(enumerate(zip(*[batch.column(i).to_pylist() for i in range(len(keys))])), key=lambda x: x[1]):
                rows.append((*key, part, n, ",".join(str(ids[i]) for i, _ in run)))
                n += 1
            yield table(rows, [pa.int64()] * (len(keys) + 2) + [pa.string()], [*keys, "range", "nth", "ids"])

    def digest(batches):
        kinds, names = [pa.int64()] * len(keys) + [pa.string()], [*keys, "ends_sha256"]
        now, sha = None, None
        for batch in batches:
            rows = []
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 2)]):
                if key == now:
                    sha.update(f",{ids}".encode())
                    continue
                if sha:
                    rows.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            yield table(rows, kinds, names)
        if sha:
            yield table([(*now, sha.hexdigest())], kinds, names)

    pieces = last.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(join, f"{head}, range long, nth long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "range", "nth").mapInArrow(digest, f"{head}, ends_sha256 string")


def prefix_trie(path: DataFrame, lengths: DataFrame, ws: Workspace) -> DataFrame:
    """Nodes of the trie of sequences; see nodes().  path: conv_id, place (from 1, without gaps), digest, n_bytes,
    length; lengths: conv_id, length, each once, sequences without elements included."""
    hashed = path.withColumns({"a": F.xxhash64("place", "digest"), "b": F.xxhash64("digest", "place")})
    rows = scan(hashed, ws, "conv_id", [F.col("place")], xors=("a", "b"))
    zero, key = F.lit(0).cast("long"), ["depth", "a", "b"]
    tries = rows.groupBy(F.col("place").alias("depth"), "a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.min("digest").alias("digest"),
        F.min(F.col("a").bitwiseXOR(F.col("a_own"))).alias("up_a"), F.min(F.col("b").bitwiseXOR(F.col("b_own"))).alias("up_b"),
    )
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("n_bytes"))
    found = ws.save(tries.unionByName(root, allowMissingColumns=True))

    last = rows.where("place = length").select(F.col("place").alias("depth"), "a", "b", "conv_id")
    ends = ended(last.unionAll(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")), key)
    below = found.where("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    full = found.join(children, key, "left").join(ends, key, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    full = full.withColumns({
        "n_children": F.coalesce("n_children", zero),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())),
        "n_leaves": F.col("n_children").isNull().cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
    })
    full = ws.save(full.drop("a", "b", "up_a", "up_b"))
    sums = ("n_leaves", "saved_tokens")

    own = full.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("parent"), F.min("depth").alias("top"), *[F.sum(c).alias(c) for c in sums])
    chains = ws.save(own.withColumn("up", F.col("parent")))
    while not chains.where("up IS NOT NULL").isEmpty():
        gain = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        jump = chains.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        more = chains.join(gain, "conv_id", "left").join(jump, "up", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in sums})
        before, chains = chains, ws.save(more.select("conv_id", "parent", "top", *sums, F.col("next").alias("up")))
        ws.drop(before)
    hung = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
    full = full.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in sums})
    full = full.drop(*[f"more_{c}" for c in sums])
    return scan(full, ws, "conv_id", [F.col("depth").desc()], adds=sums)


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    digest (SHA-256 of the last turn's role and text, see turns()) of each node of the rebuilt conversations' trie.

    Turns that tie, repeated rows among them, are turns of their own in the order of their digests; null roles and
    texts are empty, null turns come first, rows without a conv_id are left out.  A conversation may have no turn
    left: it is a member of the root, and ends there.  Texts of any length are hashed where they are read and not
    shuffled.  An empty table has no node; other columns are not read."""
    ws = Workspace(conversations.sparkSession)
    path, lengths = rebuilt(turns(conversations, ws), ws)
    out = prefix_trie(path, lengths, ws)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.lower(F.hex("digest")).alias("digest"))
