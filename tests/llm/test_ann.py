import numpy as np

from loomfield.llm import ann


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = [g[0] for g in good], np.array([g[1] for g in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = sorted((s, j) for s, j in zip(d.tolist(), ids) if j != i)[:k]
    return out


def vectors(n=1500, d=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 2] = x[rng.integers(0, 40, n // 2)] + 0.05 * rng.normal(size=(n // 2, d))
    return [(i, v.tolist()) for i, v in enumerate(x)]


def run(spark, rows, **how):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as v"), **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()}


def test_recall_and_exact_scores(spark):
    rows, want = vectors(), brute(vectors(), 50, 10)
    got = run(spark, rows, every=50, leaf=32, sample=600)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    x = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for s, i in found:
            assert s == np.sqrt(((np.array(x[i]) - np.array(x[q])) ** 2).sum())


def test_whole_search_is_exact_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.integers(0, 3, 3)]) for i in range(200)]
    rows += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(300)]
    rows += [(None, [1.0, 1.0, 1.0]), (2000, None), (2100, [1.0, None, 1.0]), (2200, [float("nan")] * 3), (2300, [0.0] * 3), (2400, [float("inf"), 1.0, 1.0])]
    want = brute(rows, 100, 10)
    got = run(spark, rows + rows[:5], every=100, fraction=100.0, leaf=8)
    assert got == want


def test_few_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, [(0, [1.0, 2.0]), (7, [1.0, 3.0])]) == {0: [(1.0, 7)]}


def test_lengths_and_extreme_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 7)]) for i in range(400)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5, fraction=ann.TREES).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 50):
        v = dict(rows)[q]
        want = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
    for scale in (1e200, 1e-200):
        rows = [(i, [scale * (i + 1), 0.0]) for i in range(300)]
        got = {r["rank"]: (r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=300, k=3).collect()}
        assert {k: i for k, (i, _) in got.items()} == {1: 1, 2: 2, 3: 3} and all(abs(s / scale - k) < 1e-9 for k, (_, s) in got.items())


def test_parts_of_queries_find_what_one_part_does(spark, monkeypatch):
    rows = vectors(700)
    whole = run(spark, rows, every=7, leaf=32)
    monkeypatch.setattr(ann, "QUERY_PART", 9)
    monkeypatch.setattr(ann, "PART", 120)
    assert run(spark, rows, every=7, leaf=32) == whole


def test_margins_end_the_search_without_a_loss():
    """On clustered vectors the bound of the sample ends the search early, all the more the larger the table is, and what
    it leaves out is no neighbour."""
    shares = []
    for n in (1000, 4000, 16_000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, n)] * 4 + 0.3 * rng.normal(size=(n, 16))
        forest = ann.Forest(x[: min(n, 4000)])
        leaves = [forest.leaves(t, x) for t in range(len(forest.trees))]
        share = []
        for q in x[:40]:
            seen = np.zeros(n, bool)
            found = forest.search(q, fraction=100.0, bound=forest.bound(q, 10))
            for t, leaf in found:
                seen |= leaves[t] == leaf
            near = np.argsort(ann.distances(x, q))[:11]
            assert seen[near].all()
            share.append(seen.mean())
        shares.append(np.mean(share))
    assert shares[2] <= shares[0] and shares[2] < 0.4, shares
