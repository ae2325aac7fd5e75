import random
import re

import pytest

from loomfield.operators import patterns as P


def plain(rules, text):
    return [x for x in dict.fromkeys(f"{s}\x1f{n}" for s, _, n, p, regex in sorted(rules) if (re.search(p, text, re.ASCII) if regex else p in text))] if text is not None else []


def test_matcher_against_rule_after_rule():
    rnd = random.Random(1)
    rules = P.default_rules() + [("x", 2, "later", "ab", False), ("x", 1, "sooner", "abc", False), ("x", 1, "sooner", "bc", False), ("r", 0, "any", "[0-9]{3}", True), ("r", 1, "dots", r"a\\.b.*c", True)]
    m = P.Matcher(rules)
    bits = [r[3] for r in rules if not r[4]] + ["cf-", "ray", "__cf", "ch", "ku", "<body>", "</body>", " ", "\n", ".ad.", ".ads.", "banner", ".jpg", "verify", "human", "123", "a.b", "é"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))
        assert m.hits(text) == plain(rules, text), text
    assert m.hits(None) == [] == m.hits("") and P.Matcher([]).hits("abc") == []


@pytest.mark.parametrize("pattern,words", [("cf-.*ray", {"cf-", "ray"}), (r"<body>\s*</body>", {"<body>", "</body>"}), (r"\.ad[s]?\.", {".ad", "."}), ("a+", None), ("a|b", None), (r"\d", None), (".*", None)])
def test_needed_words(pattern, words):
    got = P.needed_words(pattern)
    assert (set(got) if got else got) == words


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([("s", 2, "two", "b", False), ("s", 1, "one", "c", False), ("t", 0, "t", "zz", False), ("s", 0, "none", None, False), ("s", 0, "none", "", False)], P.SCHEMA)
    hits = P.rule_hits(spark, rules)
    df = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, None), (4, "zz")], "id int, t string").select("id", hits("t").alias("h"))
    got = {r.id: (r.f, r.a) for r in df.select("id", P.first_hit(P.F.col("h"), "s").alias("f"), P.any_hit(P.F.col("h"), "t").alias("a")).collect()}
    assert got == {1: ("one", False), 2: ("two", False), 3: (None, False), 4: (None, True)}
    with pytest.raises(ValueError):
        P.rule_hits(spark, spark.range(1100).select(P.F.lit("s").alias("ruleset"), P.F.lit(0).alias("rank"), P.F.lit("n").alias("name"), P.F.repeat(P.F.lit("x"), P.F.lit(16000)).alias("pattern"), P.F.lit(False).alias("regex")))
