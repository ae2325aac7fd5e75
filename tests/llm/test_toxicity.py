import math
import random
import zlib

import numpy as np

from loomfield.llm import toxicity as T


def plain_ftrl(rows, base, passes):
    """FTRL-proximal one coordinate at a time."""
    shared = {f for x, _ in rows for f in set(x.tolist()) if sum(f in set(y.tolist()) for y, _ in rows) > 1}
    z, n, zb, nb = {}, {}, 0.0, 0.0
    for _ in range(passes):
        for x, y in rows:
            own = sorted(set(x.tolist()) & shared)
            w = {}
            for f in own:
                zf, nf = z.get(f, 0.0), n.get(f, 0.0)
                w[f] = 0.0 if abs(zf) <= T.L1 else -(zf - math.copysign(T.L1, zf)) / ((T.BETA + math.sqrt(nf)) / T.ALPHA + T.L2)
            wb = -zb / ((T.BETA + math.sqrt(nb)) / T.ALPHA + T.L2)
            g = 1 / (1 + math.exp(-max(min(base + wb + sum(w.values()), 35.0), -35.0))) - y
            for f in own:
                nf = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(nf + g * g) - math.sqrt(nf)) / T.ALPHA * w[f]
                n[f] = nf + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / T.ALPHA * wb
            nb += g * g
    return z, n, zb, nb


def corpus(seed, count, bad=0.3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 5))) for _ in range(300)]
    out = []
    for i in range(count):
        y = int(rnd.random() < bad)
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if y:
            w[rnd.randrange(len(w))] = rnd.choice(["Nastyword,", "vileterm"])
        out.append((i, " ".join(w), y))
    return out


def test_ftrl_against_one_coordinate_at_a_time():
    rows = [(T.features(t), y) for _, t, y in corpus(1, 80)]
    keys, z, n = T.ftrl(rows, -1.0, (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)), 3)
    pz, pn, zb, nb = plain_ftrl(rows, -1.0, 3)
    assert set(keys.tolist()) == {0, *pz}
    got = {k: (a, b) for k, a, b in zip(keys.tolist(), z, n)}
    for k in pz:
        assert np.allclose(got[k], (pz[k], pn[k]), atol=1e-9)
    assert np.allclose(got[0], (zb, nb), atol=1e-9)


def test_features():
    f = lambda t: T.features(t).tolist()
    assert f(None) == f("") == f(" \n.,") == []
    assert f("Bad WORD, here!") == f("bad word here")
    assert len(f("a b c d e")) == 5 * (1 + len(T.STEMS)) + 4 + 3 + 2 and len(set(f("a b c d e"))) == len(f("a b c d e"))
    assert set(f("p q")) - set(f("q p")) and not set(f("x a y")) & set(f("a b")) - set(f("a"))
    long = "one two " * 100_000
    assert set(f(long)) >= set(f("one two one two one two"))


def test_model_is_the_sum_of_its_features_weights():
    keys = np.unique(T.features("one two three four"))[::2]
    m = T.Model(keys, np.linspace(-2, 3, len(keys)), -0.5)
    by = dict(zip(m.keys.tolist(), m.weights))
    for text in ("one two", "four three two one " * 500, "nothing", "", None):
        want = -0.5 + sum(by.get(x, 0.0) for x in set(T.features(text).tolist()))
        assert abs(m.score(text) - 1 / (1 + math.exp(-want))) < 1e-12
    assert T.Model(bias=-3.0).score("any text") == 1 / (1 + math.exp(3))


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as toxic", "'x' as score", "true as held_out", "0 as shard")
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text", "1 as y")


def test_held_out_rows_are_told_apart_and_teach_nothing(spark):
    rows = corpus(2, 900)
    d, labels = tables(spark, [r[:2] for r in rows], [(i, y) for i, _, y in rows])
    model = T.fit(d, labels, rows=10**6, shard_rows=200)  # several shards
    got = {r.doc_id: r for r in T.score(d, model).collect()}
    out = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in out) >= 0.95 * len(out) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    again = T.fit(d, tables(spark, [], flipped)[1], rows=10**6, shard_rows=200)
    assert (again.keys == model.keys).all() and np.allclose(again.weights, model.weights)


def test_a_bound_on_the_rows_that_are_learned_from(spark, monkeypatch):
    seen = []
    rows = corpus(3, 600)
    d, labels = tables(spark, [r[:2] for r in rows], [(i, y) for i, _, y in rows])
    save = T.Workspace.save
    monkeypatch.setattr(T.Workspace, "save", lambda self, df: seen.append(save(self, df)) or seen[-1])
    T.fit(d, labels, rows=100)
    assert 50 <= next(t.count() for t in seen if "text" in t.columns) <= 150


def test_nulls_repeats_and_empty_tables(spark):
    rows = corpus(4, 300)
    docs = [r[:2] for r in rows] + [(None, "nastyword"), (1000, None), (1001, ""), (1002, "nastyword"), (1002, "nastyword")]
    labels = [(i, y) for i, _, y in rows] + [(None, 1), (1000, None), (7, 0), (7, 1), (9999, 1)]
    got = T.toxicity(*tables(spark, docs, labels)).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    by = {r.doc_id: r for r in got}
    assert not by[None].held_out and by[1000].score == by[1001].score < 0.5 <= by[1002].score
    empty = tables(spark, [], [])
    assert T.toxicity(*empty).collect() == []
    d, _ = tables(spark, docs, labels)
    assert all(r.score < 1e-5 and r.predicted == 0 for r in T.toxicity(d, empty[1]).collect())
