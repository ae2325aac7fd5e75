import re
from collections import Counter
from itertools import permutations

import pytest

from loomfield.llm import audit
from loomfield.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {k for k, bad in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))) if bad}


def brute(docs, labels):
    """Applies every order to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        copied = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)
        rows.append((i, source or "", fails(text) | ({"E"} if copied else set())))
    out = []
    for part in {r[1] for r in rows}:
        mine, shapley, steps = [r for r in rows if r[1] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(gone)
                redundant = sum(f in r[2] for r in mine) - len(gone)
                lone = sum(r[2] == {f} for r in mine)
                steps.append((part, "".join(order), step, len(left), len(gone), redundant, lone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"w{i}" for i in range(400))


def planted():
    docs = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (3, LONG, "b"), (4, LONG[:-1] + "X", "a"), (None, LONG, "a"), (None, None, None), (5, "", "a"), (0, None, "b")]
    docs += [(6, LONG + " #", "b"), (7, "A " * 300, "b"), (8, "a " * 300, "b"), (9, "Short # TEXT", "a"), (10, "é𝒳 " * 20000, "a"), (11, "é𝒳 " * 20000, "b"), (11, "other", "b"), (12, "other", "b")]
    docs += [(13, "x" * 63 + "é" + "y" * 300, "a"), (14, "x" * 63 + "é" + "y" * 300, "a"), (15, "x" * 63 + "é" + "y" * 299 + "z", "a")]
    return docs, [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (6, None, None), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' as part", "1 as mask", "'y' as class", "2L as n_chars")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "true as good")


def test_audit_against_applying_every_order(spark):
    docs, labels = planted()
    got = audit.audit(*tables(spark, docs, labels))
    assert got.columns == COLUMNS and dict(got.dtypes)["step"] == "int" and set(got.drop("part", "filter_order", "step").dtypes) == {(c, "bigint") for c in COLUMNS[3:]}
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_equal_hashes_are_told_apart_by_the_texts(spark, monkeypatch):
    """With one hash for every block, classes are lengths, and texts alone decide."""
    docs, labels = planted()
    docs += [(20 + i, f"{i % 4:03}", "c") for i in range(12)]
    d, known = tables(spark, docs, labels)
    measured = audit.measures(d).withColumn("blocks", audit.F.transform("blocks", lambda _: audit.F.lit(7).cast("long")))
    ws = Workspace(spark)
    got = {r.doc_id for r in audit.copied(d, ws.save(measured), ws).collect()}
    assert got == {i for i, t, _ in docs if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs)}


def test_empty_tables(spark):
    d, known = tables(spark, [], [])
    assert audit.audit(d, known).collect() == []
    some, _ = tables(spark, [(1, LONG, "a")], [])
    assert {r.good_lost for r in audit.audit(some, known).collect()} == {0}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 319, 320, 321, 5000])
def test_blocks_cover_a_text_once(n):
    text = "".join(chr(300 + i % 500) for i in range(n))
    changed = {audit.block_hashes(text[:i] + "!" + text[i + 1 :]) == audit.block_hashes(text) for i in range(0, n, 37)}
    assert changed <= {False} and (n == 0) == (audit.block_hashes(text) == [])
