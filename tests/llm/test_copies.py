import random

import corpus_pipeline
from loomfield.llm import copies, simhash

SCHEMA = "doc_id long, text string"


def sets(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """The smallest id of each component over all pairs."""
    s, up = [sets(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted(low.values())


def planted(rnd, n, words):
    """n texts, each with a copy of some words changed; pairs at 0.8 to 1 and below."""
    rows = []
    for i in range(n):
        body = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
        other = list(body)
        for at in rnd.sample(range(words), max(1, round(rnd.uniform(0.002, 0.035) * words))):
            other[at] = f"x{rnd.randrange(10**6)}"
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(other))]
    return rows


def test_planted_pairs_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = planted(rnd, 80, 200) + [(d + 1000, t) for d, t in planted(rnd, 15, 1000)]
    alike = [jaccard(sets(rows[i][1]), sets(rows[i + 1][1])) for i in range(0, len(rows), 2)]
    assert sum(0.8 <= x <= 0.95 for x in alike) >= 30 and sum(x < 0.8 for x in alike) >= 10
    # a chain of copies, each a little changed; a group of copies; short and empty texts
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((3000 + i, " ".join([*chain[3 * i :], *(f"n{j}" for j in range(3 * i))])))
    rows += [(4000 + i, " ".join(f"g{j if j != i else 'own' + str(i)}" for j in range(80))) for i in range(40)]
    rows += [(5000, ""), (5001, None), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "one three")]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, similarity=(4, 5)).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == want


def test_ids_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, 1), (None, text, 2), (7, text, 3), (3, text + " more", 4), (3, "another text of its own here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id long")
    got = simhash.drop_near_duplicates(df, similarity=(4, 5))
    assert got.columns == df.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 3]
    assert simhash.drop_near_duplicates(df.limit(0), similarity=(4, 5)).collect() == []


def test_shared_bands_by_similarity():
    """Pairs at 0.8 and 0.9 nearly always share a band."""
    rnd = random.Random(9)
    for s in (0.8, 0.9):
        found = 0
        for _ in range(300):
            both = round(300 * s)
            h = copies.np.array([rnd.getrandbits(64) for _ in range(300)], copies.np.uint64)
            half = both + (300 - both) // 2
            x, y = h[:half], copies.np.concatenate([h[:both], h[half:]])
            found += bool((copies.bands(x) == copies.bands(y)).any())
        assert found >= 299, (s, found)


def test_pairs_within_few_bits_are_candidates(spark, monkeypatch):
    """The pipeline's stage links fingerprints as the operator does: pairs that share no band are found, if they match."""
    rnd = random.Random(5)
    rows = []
    for i in range(12):
        body = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join([*body[:-1], "other"]))]
    near = [i for i in range(0, 24, 2) if bin((simhash.fingerprint(rows[i][1], 5) ^ simhash.fingerprint(rows[i + 1][1], 5)) & (2**64 - 1)).count("1") <= 4]
    assert len(near) >= 10
    # bands without any match
    monkeypatch.setattr(copies, "bands", lambda h: copies.np.array([copies.mark(h) + k for k in range(copies.BANDS)], copies.np.int64))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == set(range(24)) - {i + 1 for i in near}
