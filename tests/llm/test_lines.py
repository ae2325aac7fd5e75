import random
import re

import numpy as np

from loomfield.llm import lines


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))


def brute(rows):
    """Set level: a set goes everywhere if it matches a different set whose first place is earlier, and
    from all but its first place otherwise."""
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if (s := words(line)) and d is not None:
                first[s] = min(first.get(s, (d, i)), (d, i))
    lost = {s for s in first for u in first if first[u] < first[s] and len(s & u) * 5 >= 4 * len(s | u)}
    out = []
    for d, t in rows:
        kept, seen = [], set()
        for i, line in enumerate((t or "").split("\n")):
            if s := words(line):
                if s in seen or d is not None and (s in lost or first[s] < (d, i)):
                    continue
                seen.add(s)
            kept.append(line)
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(3000)]
    pool = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 30))] for _ in range(80)]
    rows = []
    for d in rnd.sample(range(1000), n):
        body = []
        for _ in range(rnd.randint(0, 8)):
            words = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                rnd.shuffle(words)
            body.append(" ".join(words).title() if rnd.random() < 0.3 else " ".join(words))
        rows.append((d, "\n".join(body)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus() + [(2000, None), (2001, ""), (None, "a b c d e f\na b c d e f"), (2002, "\n \n"), (2003, "q w e r t y " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'x' as line_doc", "2 as gone")
    got = lines.dedup_lines(df)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in got.collect()) == sorted(((d is None, d or 0), t or "") for d, t in brute(rows))
    assert got.columns == ["doc_id", "text", "line_doc", "gone", "n_lines", "n_removed"]


def test_large_groups_in_chunks(spark):
    """Tokens with more than HOT postings, and lines whose candidates fail, take the second search."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(300):
        # members differ from the first in up to a tenth of their words, and from each other in twice that
        body = [w if rnd.random() > rnd.choice([0.0, 0.05, 0.1]) else f"v{rnd.randrange(200)}" for w in base]
        rows.append((d, " ".join(body) + "\n" + " ".join(rnd.sample(base, 25))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows))
    for hot in (lines.HOT, 16):
        assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(df, hot=hot).collect()) == want


def test_long_tokens_that_swap_halves(spark):
    """Tokens are told by all of their bytes."""
    x, y = "a" * 4095 + "b", "c" * 4095 + "d"
    rows = [(1, x + y), (2, y + x), (3, x + y), (4, "é" * 3000 + " ß\u3000x"), (5, "É" * 3000 + " ß\u3000X")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(brute(rows))


def test_repeated_ids(spark):
    """Rows with equal ids and texts are one document; with other texts they are ordered by digest."""
    rows = [(7, "one two three\nfour five"), (7, "one two three\nfour five"), (7, "four five\nsix seven eight"), (8, "six seven eight\nnine")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    both = sorted(r.text for r in got if r.doc_id == 7)
    assert [r.text for r in got if r.doc_id == 8] == ["nine"]
    assert both in (sorted(["one two three\nfour five"] * 2 + ["six seven eight"]), sorted(["one two three"] * 2 + ["four five\nsix seven eight"]))


def test_signatures_bound_the_difference():
    rnd = random.Random(3)
    for _ in range(50):
        a = {f"t{rnd.randrange(300)}" for _ in range(rnd.randint(4, 120))}
        b = (a - set(rnd.sample(sorted(a), len(a) // 5))) | {f"u{rnd.randrange(300)}" for _ in range(rnd.randint(0, 20))}
        got = lines._set_rows([" ".join(a) + "\n" + " ".join(b)], [1], [0], [None], np.zeros(lines.COUNTERS, np.int64), lines.THRESHOLD, 4)
        signs = [np.array(x.to_pylist(), np.int64) for x in got[3:7]]
        assert sum(int(np.bitwise_count((s[:1] ^ s[1:]).view(np.uint64))[0]) for s in signs) <= len(a ^ b)


def test_wordless_documents_go(spark):
    body = "\n".join(f"line {i} has words number {i * 7} and more {i * 11}" for i in range(8))
    rows = [(5, body + "\nOk."), (3, body + "\nOk."), (4, "own words that nobody else has here\n" + body.split("\n")[0] + "\nOk."), (3, body + "\nOk."), (9, ""), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.drop_repeated_lines(df).where("text is not null").collect())
    assert got == [(3, body + "\nOk."), (3, body + "\nOk."), (4, "own words that nobody else has here"), (9, "")]
    assert lines.drop_repeated_lines(df.limit(0)).collect() == []
