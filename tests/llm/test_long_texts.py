"""Every operator on whole texts takes very long ones, with and without white space."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm import audit, mixing, packing, pii, quality, secrets, simhash, toxicity, trie
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_simhash import brute as brute_simhash

TEXTS = [
    "x" * 1_000_000,
    "word " * 200_000 + "password=hunter2hunter2 mail x@y.net",
    "\n".join(f"line {i % 500} of some text" for i in range(40_000)),
    "é𝒳" * 150_000 + " " + "Ab" * 100_000,
    "short",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", "en") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_near_duplicates(docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_simhash(list(enumerate(TEXTS)))


def test_quality(docs):
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(TEXTS[r.doc_id])


def test_packing_and_mixing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    at = {}
    for r in sorted(packing.digest(packing.pack(docs, path)).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = np.array(want[r.doc_id], "<u4")
        assert r.start == at.get(r.doc_id, 0) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.tokens for r in mixing.mix(docs, path).collect()} == {i: len(x) - 1 for i, x in want.items()}


def test_pii_and_secrets(docs):
    new = {r.doc_id: r.text for r in pii.replace_pii(docs, "k").collect()}
    assert [new[i] == t for i, t in enumerate(TEXTS)] == [True, False, True, True, True]
    assert new[1].startswith("word " * 200_000) and "x@y.net" not in new[1]
    for r in secrets.scan(docs).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in secrets.KINDS]
        assert base == [tuple(x) for x in brute_secrets(TEXTS[r.doc_id])]


def test_audit_toxicity_and_trie(spark, docs):
    masks = {r.doc_id: (r.n_words, r.n_distinct, r.n_chars) for r in audit.failures(docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", docs["doc_id"] + 10))).collect()}
    assert masks == {i % 10: (len(t.split()), len(set(t.split())), len(t)) for i, t in enumerate(TEXTS)} | {10: (1, 1, 1_000_000)}
    model = toxicity.Model(np.unique(toxicity.features("hunter2hunter2")), np.full(len(np.unique(toxicity.features("hunter2hunter2"))), 9.0), -3.0)
    assert {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()} == {1}
    talks = docs.selectExpr("doc_id AS conv_id", "0L AS turn", "'user' AS role", "text")
    assert trie.nodes(talks).where("depth = 0").first().n_convs == len(TEXTS)
