import random

import xxhash

from loomfield.llm import simhash
from loomfield.llm.shared import Workspace


def brute(rows, width=4, bits=4):
    """Fingerprints bit by bit and components over all pairs."""
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = min(low.get(r, d), d)
    return sorted((d, f"{fps[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(n=150, seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows, k = [], 1000
    for _ in range(n // 5):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 220))]
        for _ in range(5):
            v = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            rows.append((k, rnd.choice([" ", "\n", "\t"]).join(v)))
            k -= 1
    return rows


def test_against_all_pairs(spark):
    rows = corpus() + [(5000, None), (5001, ""), (5002, " \n"), (3, "One two"), (4, "one TWO"), (3, "One two"), (7, "x " * 30000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_dense_groups_by_chains_of_links(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(4)]
    prints, d = [], 0
    for b in base:
        x = b
        for _ in range(60):
            x ^= sum(1 << i for i in rnd.sample(range(64), rnd.choice([1, 3, 4, 5])))
            prints.append((d := d + 1, x - (1 << 64) if x >> 63 else x))
    rnd.shuffle(prints)
    ws = simhash.Workspace(spark)
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    found = [{r.fp: r.component_id for r in simhash.classes(df, ws, groups=g).collect()} for g in (None, 5, 9)]
    up = {f: f for _, f in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fs = list(up)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                up[root(a)] = root(b)
    low = {}
    for d, f in prints:
        low[root(f)] = min(low.get(root(f), d), d)
    assert all(got == {f: low[root(f)] for f in fs} for got in found)


def test_groups_grow_with_the_table():
    got = [simhash.groups_for(10**k, 4) for k in range(1, 13)]
    assert got == sorted(got) and got[0] < got[-1]
    for g in (5, 7, 12):
        masks = simhash._masks(4, g)
        assert len(masks) == len(set(masks)) and all(-(1 << 63) <= m < 1 << 63 for m in masks)


def test_null_ids_extra_columns_and_empty_table(spark):
    schema = "doc_id long, text string, fp string, component_id string, grid int"
    rows = [(None, "a b c d e", "x", "y", 1), (2, "a b c d e", "x", "y", 1), (None, "lonely text", None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 2), (2, 2)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_drop_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(9, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (5, "other words entirely here now", None), (None, "a b c d e f", "z")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept_id string"))
    assert got.columns == ["doc_id", "text", "kept_id"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 2, 5]


def test_rows_without_ids_link_others(spark):
    prints = spark.createDataFrame([(9, 0), (None, 15), (3, 255), (None, 1 << 40 | 0xFFFFF000), (4, 15 << 50)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(prints, Workspace(spark)).collect()}
    assert got == {0: 3, 15: 3, 255: 3, 1 << 40 | 0xFFFFF000: None, 15 << 50: 3}


def test_manhattan_bounds_hamming(spark):
    rnd = random.Random(6)
    pairs = [(a := rnd.getrandbits(64) - (1 << 63), a ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    counts = lambda x: [(x >> (2 * i) & 1) + (x >> (2 * i + 1) & 1) for i in range(32)]
    for r in df.select("a", "b", simhash._manhattan(simhash._segment_counts(df.a), simhash._segment_counts(df.b)).alias("d")).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert r.d == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= (a ^ b).bit_count()
