import random
import re
from collections import Counter

from loomfield.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        t = "".join(rnd.choice(["a", "b é", " ", "\n", " x", "#", "| ", "\t", "cc ", "\r\n", "𝒳 "]) for _ in range(rnd.randint(0, 120)))
        assert quality.measure(t) == brute(t), t
    assert quality.measure(None) == (0, 0, 0, 0, 0) == brute("")
    long = "one two three four five six " * 20000
    assert quality.measure(long) == brute(long)


GOOD = " ".join(f"word{i} and" for i in range(12))


def rows():
    out = [(i, GOOD + f" {i}", "good") for i in range(40)]
    out += [(100 + i, "bad", "bad") for i in range(39)] + [(139, GOOD + " only good one", "bad")]
    return out + [(200, GOOD, "tiny"), (201, "bad", "tiny2"), (300, None, None), (301, GOOD, None), (301, GOOD, None), (None, "", "good")]


def test_host_verdicts(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "'x' as host", "true as kept")
    got = {(r.doc_id): r for r in quality.judge(df).collect()}
    assert quality.judge(df).count() == len(rows())
    assert got[0].kept and not got[0].base_failed and got[0].host_docs == 41
    assert not got[139].kept and not got[139].base_failed and got[139].host_failed == 39
    assert got[200].kept and got[301].kept and got[301].host_docs is None
    assert not got[300].kept and got[300].n_words == 0 and not got[100].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(40), 200, 301, 301])


def test_shrinkage_and_empty(spark):
    a, b = quality.prior(0.2, 0.02, 0.0)
    assert abs(a / (a + b) - 0.2) < 1e-12 and abs(a + b - 7.0) < 1e-9
    assert quality.prior(0.2, 0.0, 0.1) == (0.2 * 10_000, 0.8 * 10_000)
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(df).collect() == [] and quality.keep_good(df).collect() == []
