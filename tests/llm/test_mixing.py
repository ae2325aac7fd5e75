import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm import mixing
from loomfield.llm.shared import Workspace, components


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        src = rnd.choice(["hot"] * 5 + ["a", "b", "c"])
        body = " ".join(rnd.choice(["word", "more", "text"]) for _ in range(rnd.randint(1, 160)))
        rows.append((i, body + rnd.choice(["", " x@y.com", " a = b", " 1234"]), rnd.choice(["en", "en", "de", "fr"]), src))
    return rows


PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string"
TARGETS = {"source": {"hot": 0.25, "a": 0.25, "b": 0.25, "c": 0.25}, "lang": {"en": 0.4, "de": 0.3, "fr": 0.3}}


def shares(cells, m):
    total, out = sum(r.tokens * r.weight for r in cells), {}
    for r in cells:
        out[r[m]] = out.get(r[m], 0) + r.tokens * r.weight / total
    return out


def test_marginals_are_met_and_budget_holds(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as weight", "'x' as cell_lang"), PATH, share=0.5, targets=TARGETS).collect()
    assert len(got) == len(rows)
    for m in ("source", "lang"):
        for value, share in shares(got, m).items():
            assert abs(share - TARGETS[m][value]) < 1e-6
    total = sum(r.tokens for r in got)
    assert abs(sum(r.tokens * r.probability for r in got) - 0.5 * total) < 1e-6 * total
    assert abs(sum(r.tokens for r in got if r.taken) / total - 0.5) < 0.06
    tok = Tokenizer.from_file(PATH)
    for r, (d, t, _, _) in zip(sorted(got), sorted(rows)):
        assert r.tokens == len(tok.encode(t, add_special_tokens=False).ids)
        assert r.taken == (int(hashlib.md5(f"42:{d}".encode()).hexdigest()[:13], 16) / 2**52 < r.probability)


def test_spark_path_agrees_with_the_driver_path(spark):
    df = spark.createDataFrame(corpus(300), SCHEMA)
    a = {r.doc_id: r.probability for r in mixing.mix(df, PATH, share=0.6).collect()}
    b = {r.doc_id: r.probability for r in mixing.mix(df, PATH, share=0.6, driver_cells=0).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_rake_against_plain_fitting():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 50, 24).astype(float)
    codes = [np.arange(24) % 2, np.arange(24) // 2 % 3, np.arange(24) // 6]
    goals = [rng.dirichlet(np.ones(k)) for k in (2, 3, 4)]
    w = mixing.rake(codes, t, goals)
    for c, g in zip(codes, goals):
        assert np.allclose(np.bincount(c, w * t) / (w * t).sum(), g, atol=1e-7)
    r = mixing.rate_for(t, w, 0.4 * t.sum())
    assert abs((t * np.minimum(1, r * w)).sum() - 0.4 * t.sum()) < 1e-9


def test_nulls_repeats_empty_and_columns(spark):
    rows = [(1, None, None, None), (None, "a b c", "en", "s"), (2, "", "en", None), (2, "", "en", None), (3, "x " * 50000, "de", "s")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as mix_source", "5 as probability")
    got = mixing.mix(df, PATH, share=1.0).collect()
    assert len(got) == 5 and all(r.taken for r in got)
    kept = mixing.keep_mixed(df, PATH, share=1.0)
    assert kept.columns == df.columns and kept.count() == 5
    assert mixing.mix(df.limit(0), PATH).collect() == [] and mixing.keep_mixed(df.limit(0), PATH).collect() == []


def test_values_that_numpy_would_confuse(spark):
    rows = [(i, "a b c", "en", s) for i, s in enumerate(["x", "x\0", None, "\0null", "x", "x\0", None, "\0null"])]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), PATH, targets={"source": {"x": 0.7, "x\0": 0.1, None: 0.15, "\0null": 0.05}}, share=1.0).collect()
    assert {(r.source, round(r.weight, 6)) for r in got} == {("x", 2.8), ("x\0", 0.4), (None, 0.6), ("\0null", 0.2)}


def test_topics_follow_the_words(spark):
    rnd = random.Random(4)
    fields = [[f"{p}{i}" for i in range(60)] for p in ("gene", "court", "goal")]
    rows = [(i, " ".join(rnd.choice(fields[i % 3]) for _ in range(80)), "en", "s") for i in range(240)] + [(900, "", "en", "s"), (901, None, "en", "s")]
    got = {r.doc_id: r.topic for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), PATH).collect()}
    assert got[900] == got[901] == "none"
    named = [{got[i] for i in range(240) if i % 3 == k} for k in range(3)]
    assert not named[0] & named[1] and not named[0] & named[2] and not named[1] & named[2]


def test_topics_are_fitted_on_all_documents(spark, monkeypatch):
    """Centres that start on a few documents end where those of all documents are."""
    rnd = random.Random(4)
    fields = [[f"{p}{i}" for i in range(60)] for p in ("gene", "court", "goal", "star", "rain", "bread", "road", "paint")]
    rows = [(i, " ".join(rnd.choice(fields[i % 8]) for _ in range(60)), "en", "s") for i in range(640)]
    encoder = mixing.shared_encoder(PATH)
    counts = np.array([mixing.term_counts(encoder.encode(r[1])) for r in rows])
    terms = [np.flatnonzero(c) for c in counts]
    df = spark.createDataFrame([(i, bytearray(t.astype("<u2").tobytes()), bytearray(c[t].astype("<u4").tobytes())) for i, (c, t) in enumerate(zip(counts, terms))], "h long, at binary, n binary")
    got = mixing.fit_all(df.selectExpr("xxhash64(h) as h", "at", "n"), sample=40)
    assert np.allclose(got.rarity, np.log(641 / ((counts > 0).sum(0) + 1)))
    x = np.log1p(counts) * got.rarity
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = (x @ got.centres.T).argmax(1)
    for k in set(at.tolist()):  # each centre is the mean direction of all its documents
        mean = x[at == k].sum(0)
        assert np.allclose(got.centres[k], mean / np.linalg.norm(mean), atol=1e-6)
    sizes = np.bincount(at, minlength=len(got.centres))
    assert (np.diff(sizes) <= 0).all()
    assert {mixing.Topics.of(got, c) for c in counts} == {f"topic{k}" for k in set(at.tolist())}


def test_probabilities_against_plain_fitting(spark):
    """The query's own margins: raked by dictionaries, the rate by bisection."""
    got = mixing.mix(spark.createDataFrame(corpus(400), SCHEMA), PATH, share=0.7).collect()
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    sums = lambda m, w: {k: sum(t * w[c] for c, t in cells.items() if c[m] == k) for k in {c[m] for c in cells}}
    s = sum(t**0.8 for t in cells.values() if t)
    goals = [{k: sum(t**0.8 for c, t in cells.items() if c[m] == k and t) / s for k in {c[m] for c in cells}} for m in range(3)]
    for _ in range(2000):
        for m in range(3):
            have = sums(m, weight)
            for c in cells:
                weight[c] *= goals[m][c[m]] * total / have[c[m]] if have[c[m]] else 1.0
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(t * min(1, mid * weight[c]) for c, t in cells.items()) < 0.7 * total else (low, mid)
    assert all(abs(r.probability - min(1, high * weight[r.source, r.lang, r.topic])) < 1e-6 for r in got if r.tokens)


def test_long_runs_of_letters(spark):
    df = spark.createDataFrame([(1, "a" * 1_000_000, "en", "s"), (2, "b c", "en", "s")], SCHEMA)
    assert mixing.mix(df, PATH, share=1.0).count() == 2


def test_targets_that_contradict_each_other_are_reported():
    t = np.ones(2)
    with pytest.warns(UserWarning, match="off by a factor"):
        mixing.rake([np.array([0, 1]), np.array([0, 1])], t, [np.array([0.9, 0.1]), np.array([0.1, 0.9])])


def test_no_second_set_of_python_workers(spark, monkeypatch):
    """Rows that the driver gives as plain Python objects pass through RDD workers, beside those of the texts, whose memory stays."""

    def refuse(*_, **__):
        raise AssertionError("plain rows from the driver")

    df = spark.createDataFrame(corpus(40), SCHEMA).persist()
    none = spark.range(3).selectExpr("id as a", "id as b")
    assert df.count() == 40
    monkeypatch.setattr(spark.sparkContext, "parallelize", refuse)
    assert mixing.keep_mixed(df, PATH, share=1.0).count() == mixing.mix(df, PATH).count() == 40
    got = components(none, Workspace(spark))
    assert got.dtypes == [("node", "bigint"), ("component", "bigint")] and got.count() == 0
    df.unpersist()
