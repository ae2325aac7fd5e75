import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomfield.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(4)
    odd = ["Don't", "it's", "l'été", "ÉCOLE,", "İstanbul", "ΣΊΣΥΦΟΣ", "éa", "x y", "a　b", "\t", "\r\n", "  ", "\n\n", "<|endoftext|>", "123.45", "日本語", "😀", "naïve.", "(a),b", "ß", "Ÿ", "ﬁ", "\u001c", "\u0085", "..", "a.", "A,", "́"]
    out = [" ".join(rnd.choice(odd) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    out += ["".join(rnd.choice([*odd, "plain ", "word "]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    return out + ["", "long " * 9000, "z" * 5000]


def test_encoder_equals_whole_text():
    whole, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for t in texts():
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_with_punctuation_behind_them_need_no_whole_tokenizer(monkeypatch):
    whole, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    forms = ["NICHT!!", "tihawh$$$", "ENSH,!!", "thon.###", "a'", "été'!", "x_", "b\\]^`{|}~", "c<|", "ÉCOLE?\"", "d" + "-" * 3000]
    wanted = [whole.encode(t, add_special_tokens=False).ids for t in forms]
    monkeypatch.setattr(mine, "tokenizer", None)
    assert [np.frombuffer(mine.encode(t), "<u4").tolist() for t in forms] == wanted


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_CHUNKS", 50)
    monkeypatch.setattr(packing, "_WORDS", 80)
    whole, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    text = " ".join(["z" * 5000, "y" * 3000 + ".", *(f"{c}{d}x" for c in "abcdefghij" for d in "klmnopqrst")])
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(mine.chunks) == 50 and len(mine.words) == 80
    assert max(map(len, [*mine.chunks, *mine.words])) <= 64


def test_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(texts())] + [(5000, None), (5001, "same"), (5001, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as start", "'x' as tokens")
    got = packing.digest(packing.pack(df, PATH)).collect()
    pieces = {}
    for r in got:
        assert r.length == 1 << r.bucket <= 2048 and r.offset == 0
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got)
    for d, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces[d], key=lambda r: r.start)
        if d == 5001:
            assert [r.start for r in mine] == sorted(2 * [0, *np.cumsum(packing.piece_lengths(len(ids), 2048))[:-1].tolist()])
            continue
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_lengths():
    assert packing.piece_lengths(4096 + 7, 2048) == [2048, 2048, 4, 2, 1]
    with pytest.raises(ValueError):
        packing.pack(None, PATH, longest=1000)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 5, 17, 300, 2047, 2048, 5000])] + [(None, None)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    got = {(r.bucket, r.length) for r in back.select("bucket", "length").distinct().collect()}
    assert all(length == 1 << bucket for bucket, length in got) and len(got) > 5
    assert back.count() == pieces.count() and sum(r.length for r in back.select("length").collect()) == sum(r.length for r in pieces.select("length").collect())
