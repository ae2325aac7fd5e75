"""Secrets in whole texts, also under layers of URL, Unicode, base64 and compression encodings.

Each text is the first item of a worklist.  An item is scanned for the base patterns; every encoded
segment in it is decoded to a new item, until nothing new appears.  A digest of each layer detects
cycles and repeats.  A span found in a layer is mapped back, layer by layer, to code points of the
original text.

Compressed values are unpacked as streams and scanned in overlapping pieces, so that a value which unpacks
to any size takes bounded memory; a match in a piece is reported as the whole value, as any match in a
compressed layer is.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.shared import only, small_batches

KINDS = ("assign", "access", "hex")
#: Bytes of unpacked data that are scanned at once, and how many of them are scanned again with the next ones.
PIECE, OVERLAP = 1 << 24, 1 << 16

_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"\S+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64, each but the last one up to its end and each but the first one from its start.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Shorter than any base pattern's match.
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){8,}")
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' matches in one layer, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _replaced(text: str, pattern: re.Pattern, decode: Callable[[str], str]) -> tuple[str, Callable[[int, int], tuple[int, int]]]:
    """text with pattern's matches decoded, and the mapping of its spans to spans of text.  The mapping keeps the edges
    of matches alone, four numbers each."""
    out, size, at = io.StringIO(), 0, 0
    begins, stops, froms, tos = (array("q") for _ in range(4))  # a decoded match, and what it was in text
    for m in pattern.finditer(text):
        new = decode(m.group())
        out.write(text[at : m.start()])
        out.write(new)
        size += m.start() - at
        begins.append(size), stops.append(size + len(new)), froms.append(m.start()), tos.append(m.end())
        size, at = size + len(new), m.end()
    out.write(text[at:])

    def place(i: int, last: bool) -> int:
        k = bisect_right(stops, i)  # matches before it have ended
        if k < len(begins) and begins[k] <= i:
            return tos[k] - 1 if last else froms[k]
        return i if not k else tos[k - 1] + i - stops[k - 1]

    return out.getvalue(), lambda s, e: (place(s, False), place(e - 1, True) + 1)


class _Places:
    """Where each character of joined lines stands in the text: a line's characters follow each other, so that a
    line is one range."""

    def __init__(self, lines: list[range], size: int):
        self.lines, self.size, self.before = lines, size, array("q")
        total = 0
        for x in lines:
            self.before.append(total)
            total += len(x)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        i = i + self.size if i < 0 else i
        k = bisect_right(self.before, i) - 1
        return self.lines[k][i - self.before[k]]


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _escape(run: str) -> str:
    units = re.findall(r"\\u(....)|\\x(..)", run)
    raw = b"".join(int(a or b, 16).to_bytes(2, "little") for a, b in units)
    return raw.decode("utf-16-le", "replace")


def _decompressor(raw: bytes):
    """One for the gzip, zlib, bzip2 or xz stream that raw starts with; None if it's none of them."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)


def _compressed(head: bytes) -> bool:
    """Whether a stream that starts so unpacks, at least at first."""
    d = _decompressor(head)
    try:
        return d is not None and d.decompress(head, 1) is not None
    except _BROKEN:
        return False


def _blocks(read: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of read in blocks of a quarter of a piece, so that their heads can be told."""
    held, size = [], 0
    for part in read:
        while part:
            take = part[: PIECE // 4 - size]
            held.append(take)
            size, part = size + len(take), part[len(take) :]
            if size == PIECE // 4:
                yield b"".join(held)
                held, size = [], 0
    if held:
        yield b"".join(held)


def _inflated(read: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of all members of a compressed stream, and bytes behind them as they are."""
    raw = next(read, b"")
    while raw:
        if not _compressed(raw):
            yield raw
            yield from read
            return
        d = _decompressor(raw)
        while True:
            try:
                out = d.decompress(raw, PIECE // 4)
            except _BROKEN:
                yield raw
                yield from read
                return
            if out:
                yield out
            if d.eof:
                break
            # zlib gives back what it hasn't read, the others keep it
            raw = getattr(d, "unconsumed_tail", b"")
            if not raw and (not out or getattr(d, "needs_input", True)):
                raw = next(read, b"")
                if not raw and not out:
                    return
        raw = d.unused_data.lstrip(b"\0")  # padding between members
        while not raw and (more := next(read, b"")):
            raw = more.lstrip(b"\0")
        if raw and len(raw) < 8:
            raw += next(read, b"")


def _contents(read: Iterator[bytes]) -> tuple[Iterator[bytes], bool]:
    """What a decoded value holds under all its compressed layers, as a stream, and whether it was compressed.
    A stream that unpacks to its own beginning again is left as it is."""
    packed, seen = False, set()
    while True:
        head = next(read, b"")
        if not _compressed(head) or (key := hashlib.blake2b(head).digest()) in seen:
            return chain([head], read), packed
        seen.add(key)
        inner = _blocks(_inflated(chain([head], read)))
        read, packed = inner, True


#: What may belong to a value that isn't at its end, from the end of the data on: base64, also over line breaks.
_OPEN = re.compile(rb"[A-Za-z0-9+/_-]*+(?:[ \t]*+\n\r?+[ \t]*+[A-Za-z0-9+/_-]++)*+")
_SPACES = tuple(bytes([c]) for c in b" \t\n\v\f\r")
_KEPT = re.compile(rb"[^A-Za-z0-9+/]+")


class _Run:
    """A base64 run too long to be held, on the way through a stream: it's decoded as it is read, and what it holds is a
    stream again.  ``layers`` must be read to the end before the outer stream goes on."""

    def __init__(self, read: Iterator[bytes]):
        self.read = read

    def layers(self):
        """Like _layers(): of the run itself the text (without a name), and what it decodes to."""
        texts: list[str] = []

        def decoded():
            held, before, first = b"", b"", True
            for block in self.read:
                texts.append((before + block).decode("latin-1"))
                before = block[-OVERLAP:]
                if first:
                    first, block = False, block[_beginning(block) :]
                held += _KEPT.sub(b"", block.replace(b"-", b"+").replace(b"_", b"/"))
                cut = len(held) - len(held) % 4
                if cut:
                    yield base64.b64decode(held[:cut])
                held = held[cut:]
            if len(held) > 1:
                yield base64.b64decode(held + b"=" * (-len(held) % 4))

        read, packed = _contents(decoded())
        for view in _read_views(read):
            while texts:
                yield None, texts.pop(), lambda s, e: (0, 1)
            yield "packed" if packed else "base64", view, lambda s, e: (0, 1)
        while texts:
            yield None, texts.pop(), lambda s, e: (0, 1)


def _beginning(block: bytes) -> int:
    """Where a run's value begins: at its first line, or at the second one if the first is another word, without which
    the rest makes more sense."""
    second = block.find(b"\n") + 1
    if not second or len(block[: second - 1].strip()) == len(block[second:].partition(b"\n")[0].strip()):
        return 0

    def sense(at: int) -> int:
        some = _KEPT.sub(b"", block[at : at + 8192].replace(b"-", b"+").replace(b"_", b"/"))
        head = base64.b64decode(some[: len(some) - len(some) % 4])
        try:
            head[: len(head) - 3].decode("utf-8")
            return 1
        except UnicodeDecodeError as e:
            return 2 * _compressed(head) or int(e.start > len(head) - 8)

    return second if sense(second) > sense(0) else 0


def _pieces(read: Iterator[bytes]) -> Iterator[bytes | _Run]:
    """The stream in pieces of about PIECE bytes, each after the first with the last OVERLAP bytes before it.

    A piece ends where no value is open: before the white space in front of the base64, over one or more lines, or the
    other characters, that the data read so far ends with.  Data without white space is cut between base64 runs, and
    a run that fills a piece is passed on as it comes."""
    held, before = b"", b""
    for block in read:
        held += block
        while len(held) >= PIECE:
            start = len(held) - _OPEN.match(held[::-1]).end()
            start = max((held.rfind(c, 0, start) for c in _SPACES), default=-1) + 1 or start
            if start:
                yield before + held[:start]
                before, held = (before + held[:start])[-OVERLAP:], held[start:]
                continue
            rest: list[bytes] = []
            yield _Run(_run(held, read, rest))
            before, held = b"", b"".join(rest)
    if held:
        yield before + held


#: What ends a run: another character, white space within a line, an empty line.
_END = re.compile(rb"[^A-Za-z0-9+/_\s-]|(?<=[^\s])[ \t]++(?=[^\s])|\n[ \t\r]*+\n")


def _run(held: bytes, read: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """The blocks of an open base64 run that begins with held; what follows it is put into rest."""
    told = 0  # of held has been given out: the character before white space whose meaning the next block tells
    while True:
        m = _END.search(held)
        sure = m.start() if m else len(held.rstrip())
        if sure > told:
            yield held[told:sure]
        if m:
            rest.append(held[m.start() :])
            return
        more = next(read, b"")
        if not more:
            return
        told = min(1, sure)
        held = held[sure - told :] + more


def _read_views(read: Iterator[bytes]) -> Iterator[str | _Run]:
    for piece in _pieces(read):
        yield from [piece] if isinstance(piece, _Run) else _views(piece)


def _views(raw: bytes) -> list[str]:
    """The texts a decoded layer may be: UTF-8, else Latin-1; and UTF-16 wherever ASCII characters alternate
    with zero bytes, of either order and at either alignment."""
    try:
        views = [raw.decode("utf-8")]
    except UnicodeDecodeError:
        views = [raw.decode("latin-1")]
    if b"\0" in raw:
        wide = raw + b"\0"  # the last character of the high-byte-first order has its zero before it
        views += [wide[at:].decode("utf-16-le", "replace") for at in sorted({m.start() % 2 for m in _WIDE.finditer(wide)})]
    return views


def _unpacked(segment: str) -> tuple[Iterator[str], bool] | None:
    """The texts under a base64 segment, and whether it was compressed; None if it can't be decoded."""
    body = segment.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    read, packed = _contents(iter([raw]))
    if not packed:
        return iter(_views(raw)), False
    return _read_views(read), True


def _layers(text: str):
    """(name, decoded text, mapping of its spans to spans of text) of each encoded segment."""
    for mark, name, pattern, decode in (("%", "url", _PERCENT, _percent), ("\\", "unicode", _ESCAPE, _escape)):
        if mark in text:
            for t in _TOKEN.finditer(text):
                if mark in t.group() and pattern.search(t.group()):
                    inner, to = _replaced(t.group(), pattern, decode)
                    yield name, inner, lambda s, e, to=to, at=t.start(): tuple(x + at for x in to(s, e))
    for at, segment in _segments(text):
        if got := _unpacked(segment):
            views, packed = got
            whole = at[0], at[-1] + 1
            for i, inner in enumerate(views):
                if packed or i or not inner.isascii():  # runs are parts of compressed values alone
                    yield "packed" if packed else "base64", inner, lambda s, e, w=whole: w
                else:
                    yield "base64", inner, lambda s, e, at=at: (at[s * 4 // 3], at[min(len(at), -(-e * 4 // 3)) - 1] + 1)


def _segments(text: str):
    """(place of each character in text, characters) of base64 runs: those of one line, and those wrapped over
    several.  Of lines that end and start in a run, all are joined, and lines of equal length with a
    shorter last one, since words or frames beside a wrapped value look like lines of it."""
    for m in _BASE64.finditer(text):
        yield range(*m.span()), m.group()
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines = [range(*x.span()) for x in _LINE.finditer(text, *m.span())]
        groups, i = {(0, len(lines))}, 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and len(lines[j]) == len(lines[i]):
                j += 1
            end = j + (j < len(lines) and len(lines[j]) < len(lines[i]))
            if end - i > 1:
                groups.add((i, end))
            i = j
        for lo, hi in sorted(groups):
            segment = "".join(text[x.start : x.stop] for x in lines[lo:hi])
            whole = len(segment.rstrip("="))
            cut = len(segment) if whole % 4 != 1 else whole - 1  # a rest of one character decodes to nothing
            yield _Places(lines[lo:hi], cut), segment[:cut]


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; null is empty.  Base spans have the kinds of KINDS,
    others the path of layers before it, like ``url/base64/assign``; a layer's span that a base span of
    the same kind already has isn't repeated."""
    if not text:
        return []
    base = base_spans(text)
    root = hashlib.blake2b(text.encode("utf-8", "replace")).digest()
    held, seen, added = set(base), set(), set()
    # the worklist holds open layers, the last one first, so that of a long stream one piece is held at a time
    work: list[tuple] = [(_layers(text), (), lambda s, e: (s, e))]
    while work:
        layers, path, outer = work[-1]
        found = next(layers, None)
        if found is None:
            work.pop()
            continue
        name, inner, to = found
        if name is None:  # more of the layer itself
            added |= {(f"{'/'.join(path)}/{kind}", *outer(*to(s, e))) for kind, s, e in base_spans(inner)}
            continue
        if isinstance(inner, _Run):
            work.append((inner.layers(), (*path, name), lambda s, e, to=to, outer=outer: outer(*to(s, e))))
            continue
        digest = hashlib.blake2b(inner.encode("utf-8", "replace")).digest()
        if not inner or digest == root or (key := (digest, outer(*to(0, len(inner))))) in seen:
            continue
        seen.add(key)
        names = "/".join([*path, name])
        back = lambda s, e, to=to, outer=outer: outer(*to(s, e))
        for kind, s, e in base_spans(inner):
            if (kind, *(span := back(s, e))) not in held:
                added.add((f"{names}/{kind}", *span))
        work.append((_layers(inner), (*path, name), back))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted([*base, *added], key=lambda x: (x[1], rank.get(x[0], len(KINDS)), x[0], x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array<struct<kind, start, end>>) of every row; one Arrow pass, no shuffle.

    Offsets are code points, the end exclusive.  Null and empty texts have no spans; repeated rows give
    repeated results; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s result."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
