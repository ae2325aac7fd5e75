"""Packing by powers of two: a document's tokens are cut into pieces of binary lengths.

A document of n tokens gives n // L pieces of L tokens and one piece for each bit of the rest, largest
first.  Every piece is a training sequence of its own, in the bucket of its length: batches are drawn
from one bucket, nothing is padded, and no sequence crosses documents.  One Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import only, small_batches

_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Chunks and words that a worker remembers, none longer than _LONG; they stay in its memory through all later tasks.
_CHUNKS, _WORDS, _LONG = 50_000, 200_000, 64


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable letter: itself, or the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of texts, equal to encode() of the whole text.

    The vocabulary's rules never join characters across white space, so a text's ids are those of its
    space-separated chunks.  Chunks, and plain words without case and final punctuation, are encoded
    once and remembered, up to _CHUNKS and _WORDS.  Letters with ASCII punctuation behind them are a word and one run
    of punctuation to those rules; chunks of other forms go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = [t.id for t in self.model.tokenize(spelled)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) < _WORDS and len(word) <= _LONG:
                self.words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        m = _SIMPLE.fullmatch(chunk)
        if m:
            got = self._word(m[1].lower()) + (self._word(m[2]) if m[2] else b"")
        else:
            got = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) < _CHUNKS and len(chunk) <= _LONG:
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        known, chunk = self.chunks.get, self._chunk
        return b"".join([x if (x := known(c)) is not None else chunk(c) for c in text.replace("\n", " ").split(" ")])


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder per worker process: tasks that follow find its vocabulary loaded and its words known."""
    return WordEncoder(path)


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as multiples of longest and the powers of two of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (binary, little-endian uint32), doc_tokens,
    bucket (log2 of length), sequence_id, offset (always 0: a piece is its whole sequence).

    A null or empty text is the end id alone.  Repeated rows are packed each on its own; sequence_id is
    unique over rows, not over doc_ids.  An empty table gives no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, tokens binary, doc_tokens long, bucket int"

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            rows, held = [[] for _ in range(6)], 0
            for d, t in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(t.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for k in piece_lengths(n, longest):
                    for column, v in zip(rows, (d.as_py(), start, k, ids[4 * start : 4 * (start + k)], n, k.bit_length() - 1)):
                        column.append(v)
                    start += k
                held += len(ids)
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [[] for _ in range(6)], 0
            yield _batch(rows)

    out = only(docs, doc_id="long", text="string").mapInArrow(run, schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "start", "length", "tokens", "doc_tokens", "bucket"])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """pack()'s pieces as Parquet by bucket, so that a training job draws batches of equal lengths from one folder.
    Each task writes a file for each of the few lengths; nothing is shuffled, so no bucket meets in a task."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns from pack()'s result."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
