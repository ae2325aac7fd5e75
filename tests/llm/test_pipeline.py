"""The pipeline against a plain version of every stage, and what each stage promises."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomfield.llm import mixing, packing
from tests.llm.test_copies import brute as brute_copies
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_quality import brute as brute_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=70, seed=8):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    rows, d = [], 0
    shared = [" ".join(word() for _ in range(20)) for _ in range(3)]
    for _ in range(n):
        body = [" ".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(rnd.randint(1, 5))]
        if rnd.random() < 0.3:
            body.insert(0, rnd.choice(shared))
        if rnd.random() < 0.2:
            body.append("mail a@b.org or 12345")
        rows.append((d := d + 1, "\n".join(body), rnd.choice(["en", "de"]), rnd.choice(["hot", "hot", "a", "b"]), 0))
    rows += [(d + 1 + i, rows[i][1], "en", "hot", 0) for i in range(10)]
    rows += [(500, "too short", "en", "a", 0), (501, "same words again " * 30, "en", "a", 0), (502, None, None, None, None), (None, rows[0][1] + " anonymous", "en", "a", 1)]
    return rows


def plain(spark, rows):
    kept = [r for r in rows if (m := brute_quality(r[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    after = brute_lines([(r[0], r[1]) for r in kept])
    lined = [(r[0], t, *r[2:]) for r, (_, t) in zip(kept, after) if t.split()]
    named = [r for r in lined if r[0] is not None]
    best = set(brute_copies([(r[0], r[1]) for r in named]))
    single = [r for r in lined if r[0] is None or r[0] in best]
    tok, cells, tokens, encoded = Tokenizer.from_file(PATH), {}, {}, {}
    topics = mixing.fit_topics(mixing.sampled_counts(spark.createDataFrame(single, SCHEMA), PATH))
    for r in single:
        encoded[id(r)] = np.array(tok.encode(r[1], add_special_tokens=False).ids, "<u4")
        topic = topics.of(mixing.term_counts(encoded[id(r)].tobytes()))
        cells[id(r)] = (r[3], r[2], topic)
        tokens[cells[id(r)]] = tokens.get(cells[id(r)], 0) + len(encoded[id(r)])
    total, weight = sum(tokens.values()), dict.fromkeys(tokens, 1.0)
    s = sum(t**0.8 for t in tokens.values() if t)
    goals = [{k: sum(t**0.8 for c, t in tokens.items() if c[m] == k and t) / s for k in {c[m] for c in tokens}} for m in range(3)]
    for _ in range(2000):
        for m in range(3):
            have = {}
            for c, t in tokens.items():
                have[c[m]] = have.get(c[m], 0) + t * weight[c]
            for c in tokens:
                weight[c] *= goals[m][c[m]] * total / have[c[m]] if have[c[m]] else 1.0
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(t * min(1, mid * weight[c]) for c, t in tokens.items()) < 0.8 * total else (low, mid)
    unit = lambda r: int(hashlib.md5(f"42:{hashlib.sha256(r[1].encode()).hexdigest() if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
    taken, out = [r for r in single if unit(r) < min(1, high * weight[cells[id(r)]])], []
    for r in taken:
        ids, at = np.append(encoded[id(r)], 1).astype("<u4"), 0
        for k in packing.piece_lengths(len(ids), 2048):
            out.append((r[0] or -1, at, k, zlib.crc32(ids[at : at + k].tobytes())))
            at += k
    return sorted(out)


def test_run_equals_the_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.start, r.length, zlib.crc32(bytes(r.tokens))) for r in got) == plain(spark, rows)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame(corpus(12), SCHEMA)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
