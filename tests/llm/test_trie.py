import hashlib
import random
import zlib

import pytest

from loomfield.llm import trie
from loomfield.llm.shared import Workspace


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = own.get(first, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved, sha, digest(*p[-1]).hex() if p else None))
    return sorted(out, key=str)


def random_rows(seed, convs=60, texts="ab"):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "bot", None]), rnd.choice(texts)) for c in range(-7, convs) for t in range(rnd.choice([0, 1, 3, 5, 9, 12]))]
    rows += [(3, None, "user", "a"), (3, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 0, "user", "x"), (71, 0, "", "é𝒳" * 9000), (10**15, 0, "user", "a")]
    rows += [(80, t, "user", "a") for t in range(90)] + [(81, t, "user", "a" if t < 50 else "b") for t in range(70)]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as depth", "1 as place", "'y' as digest", "2 as a")


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_against_brute_force(spark, seed):
    rows = random_rows(seed)
    got = trie.nodes(table(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert all(kind == "bigint" for c, kind in got.dtypes if c not in ("ends_sha256", "digest"))


def test_a_conversation_over_many_ranges_and_batches(spark):
    """One key with most rows is dealt over ranges and batches, and keeps its running values."""
    rows = [(5, i, i % 7 - 3) for i in range(5000)] + [(k, i, i) for k in (1, 4, 6, 9) for i in range(k)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        ws = Workspace(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
        df = spark.createDataFrame(rows, "k long, i long, v long").withColumn("x", trie.F.col("v"))
        got = trie.scan(df, ws, "k", [trie.F.col("i").desc()], adds=("v",), xors=("x",)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for k in {r[0] for r in rows}:
        total, mixed = 0, 0
        for _, i, v in sorted((r for r in rows if r[0] == k), reverse=True):
            total, mixed = total + v, mixed ^ v
            want[k, i] = (total, mixed, v, v)
    assert {(r.k, r.i): (r.v, r.x, r.v_own, r.x_own) for r in got} == want


def test_a_list_of_ends_over_many_ranges(spark):
    ids = [*range(-3000, 9000, 3), 10**14]
    df = spark.createDataFrame([(7, i) for i in ids] + [(8, 1), (6, 2), (6, 10)], "k long, conv_id long").repartition(6)
    Workspace(spark)
    want = {7: ids, 8: [1], 6: [2, 10]}
    assert {r.k: r.ends_sha256 for r in trie.ended(df, ["k"]).collect()} == {k: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for k, x in want.items()}


def test_empty(spark):
    assert trie.nodes(table(spark, [])).collect() == []
    assert trie.nodes(table(spark, [(None, 1, "a", "b")])).collect() == []
