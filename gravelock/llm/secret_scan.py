"""8, Secret scans: plain patterns, and a recursive decoding worklist.

The text is the first layer. Every layer is searched for encoded stretches: URL escapes, Unicode and byte escapes,
numeric HTML references, 16-bit characters (these are rewritten in place, so that what stands around them stays),
base64 and hex digits, also wrapped over lines and at every alignment, and compressed data (gzip, zlib, bzip2, xz)
in any of these, at its beginning or within. Each decoded stretch is a new layer, which is scanned and searched in turn
until none is new. It is also put in its place among the words around it, as many as a match can reach, which gives
another layer; there only what lies partly in the stretch counts, and is searched further, as the rest is seen elsewhere.
Layers are bytes, so a stray byte spoils none. They are remembered by digest and origin, so a cycle ends. Nothing
is cut off: compressed layers are unpacked and scanned window by window, so memory is bounded, not coverage.

Every layer keeps a map of its bytes to where they come from in the text (4 to 3 for base64, 2 to 1 for hex, the
whole stretch for compressed data), so what is found in any layer is reported as a span of the text: `assign`,
`access`, `hex` in the text itself, and the kinds prefixed by the layers' codings (`base64.url.assign`) elsewhere.
No secret that the patterns can match has under 12 bytes, which are 16 characters of base64 or 24 hex digits.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gravelock.llm.common import batches, doc_text

#: The patterns asked for (fixed values).
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
IN_BYTES = re.compile(ASSIGN, re.I), re.compile(ACCESS), re.compile(HEX)
IN_TEXT = re.compile(ASSIGN.decode(), re.I | re.A), re.compile(ACCESS.decode()), re.compile(HEX.decode())

URL = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
REFERENCES = re.compile(rb"(?:&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
REFERENCE = re.compile(rb"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
WIDE = re.compile(rb"(?:[\x01-\x7f]\x00){4,}|(?:\x00[\x01-\x7f]){4,}")
#: Base64 of both alphabets, and so hex too; lines may be wrapped.
RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*|[A-Za-z0-9+/_-]{8,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{8,})+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)?")
BLANKS = re.compile(rb"[\x20\t\r\n]")
HEXRUN = re.compile(rb"[0-9A-Fa-f]{24,}")
STANDARD = bytes.maketrans(b"-_", b"+/")
#: What ends every stretch: bytes that no pattern above can hold.
ENDS = np.array([not re.match(rb"[A-Za-z0-9+/=_%\\&#;:.\"'\x00\x20\t\r\n-]", bytes([x])) for x in range(256)])
#: What a match or a stretch can hold between blanks, and how many such words before and after one it can reach.
WORDS, REACH = re.compile(rb"[A-Za-z0-9+/=_%\\&#;:.\"'\x00-]+"), 2
#: The beginnings of gzip, bzip2 and xz data, wherever they stand.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0")
#: Bytes of a compressed layer that are unpacked at a time; an open stretch is held back up to HELD bytes, beyond
#: which it is read in parts that overlap by OVERLAP.
BLOCK, HELD, OVERLAP = 1 << 20, 1 << 26, 1 << 16

Span = tuple[int, int, str]


def matches(s: str | bytes) -> list[Span]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping for each kind."""
    assign, access, hexes = IN_BYTES if isinstance(s, bytes) else IN_TEXT
    low = s.lower() if isinstance(s, bytes) else s.encode("utf-8", "surrogatepass").lower()
    found: list[Span] = []
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in assign.finditer(s) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(m.start(), m.end(), "access") for m in access.finditer(s) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), "hex") for m in hexes.finditer(s)]


class Layer:
    """Bytes, and for each where its origin begins and ends in the text: arrays, or two numbers for all. fresh: the
    stretch that was put in its place, if the layer was made for that."""

    def __init__(self, data: bytes, names: tuple[str, ...], begins: np.ndarray | int, ends: np.ndarray | int, fresh: tuple[int, int] | None = None):
        self.data, self.names, self.begins, self.ends, self.fresh = data, names, begins, ends, fresh

    @classmethod
    def of(cls, text: str) -> Layer:
        data = text.encode("utf-8", "surrogatepass")
        place = np.arange(len(data)) if len(data) == len(text) else np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
        return cls(data, (), place, place + 1)

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (self.begins, self.ends) if isinstance(self.begins, int) else (int(self.begins[a]), int(self.ends[b - 1]))

    def touches(self, a: int, b: int) -> bool:
        return not self.fresh or a < self.fresh[1] and b > self.fresh[0]

    def within(self, a: int, b: int) -> bool:
        """If a..b lies in the fresh stretch, and so was seen in a layer of its own."""
        return bool(self.fresh) and self.fresh[0] <= a and b <= self.fresh[1]

    def inner(self, name: str, data: bytes, first: np.ndarray, last: np.ndarray) -> Layer:
        """A layer whose bytes come from first..last (places in this one, both included)."""
        maps = (self.begins, self.ends) if isinstance(self.begins, int) else (self.begins[first], self.ends[last])
        return Layer(data, (*self.names, name), *maps)

    def rewritten(self, name: str, parts: list[tuple[int, int, bytes]]) -> Layer:
        """This layer with the stretches a..b replaced by what they stand for."""
        out, first, last, at = [], [], [], 0
        for a, b, s in parts:
            out += [self.data[at:a], s]
            first += [np.arange(at, a), np.full(len(s), a)]
            last += [np.arange(at, a), np.full(len(s), b - 1)]
            at = b
        rest = np.arange(at, len(self.data))
        first, last = np.concatenate([*first, rest]), np.concatenate([*last, rest])
        layer = self.inner(name, b"".join([*out, self.data[at:]]), first, last)
        if self.fresh:
            layer.fresh = tuple(np.searchsorted(first, self.fresh).tolist())
        return layer

    def in_place(self, name: str, data: bytes, first: np.ndarray, last: np.ndarray, a: int, b: int, around: tuple[int, int]) -> Layer:
        """The bytes `around` with a..b replaced by data."""
        left, right = np.arange(around[0], a), np.arange(b, around[1])
        layer = self.inner(name, self.data[around[0] : a] + data + self.data[b : around[1]], np.concatenate([left, first, right]), np.concatenate([left, last, right]))
        layer.fresh = (len(left), len(left) + len(data))
        return layer


def unpacked(data: bytes) -> Iterator[bytes]:
    """Blocks of what compressed data holds, as far as it can be read; nothing if it is none."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0):
        make = lambda: zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\0":
        make = lzma.LZMADecompressor
    else:
        return
    try:
        while data:  # members, one after another
            d = make()
            while not d.eof:
                block = d.decompress(data, BLOCK)
                if not block and not getattr(d, "unconsumed_tail", b"") and (d.eof or getattr(d, "needs_input", True)):
                    break
                yield block
                data = getattr(d, "unconsumed_tail", b"")
            data = d.unused_data
            if not d.eof:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def windows(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The stream in windows that no stretch crosses."""
    held = b""
    for block in blocks:
        held += block
        if len(held) > HELD:
            yield held
            held = held[-OVERLAP:]
            continue
        ends = np.flatnonzero(ENDS[np.frombuffer(held, np.uint8, min(BLOCK, len(held)), max(0, len(held) - BLOCK))])
        if len(ends):
            cut = max(0, len(held) - BLOCK) + int(ends[-1]) + 1
            yield held[:cut]
            held = held[cut:]
    if held:
        yield held


def codes(pattern: re.Pattern, s: bytes, a: int, b: int, base: int) -> Iterator[tuple[int, int, bytes]]:
    """Each escape of a run with its bytes. Group 1: digits to `base` of a character, group 2: hex digits."""
    high = None
    for m in pattern.finditer(s, a, b):
        if base == 16 and m[2]:
            yield m.start(), m.end(), bytes([int(m[2], 16)])
            continue
        c = int(m[1], base) if m[1] else int(m[2], 16)
        if high is not None and 0xDC00 <= c < 0xE000 and high[1] == m.start():
            yield high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + c - 0xDC00).encode()
            high = None
            continue
        high = (m.start(), m.end(), c) if 0xD800 <= c < 0xDC00 else None
        if high is None and c < 0x110000:
            yield m.start(), m.end(), chr(c).encode("utf-8", "surrogatepass")


def rewritings(s: bytes) -> Iterator[tuple[str, list[tuple[int, int, bytes]]]]:
    if b"%" in s:
        yield "url", [(m.start() + k, m.start() + k + 3, bytes([int(m[0][k + 1 : k + 3], 16)])) for m in URL.finditer(s) for k in range(0, len(m[0]), 3)]
    if b"\\" in s:
        yield "unicode", [x for m in ESCAPES.finditer(s) for x in codes(ESCAPE, s, m.start(), m.end(), 16)]
    if b"&#" in s:
        yield "reference", [x for m in REFERENCES.finditer(s) for x in codes(REFERENCE, s, m.start(), m.end(), 10)]
    if b"\0" in s:
        yield "utf16", [(m.start() + k, m.start() + k + 2, m[0][k : k + 2].strip(b"\0")) for m in WIDE.finditer(s) for k in range(0, len(m[0]), 2)]


def together(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Stretches that follow each other as one."""
    run: list[tuple[int, int, bytes]] = []
    for x in [*parts, None]:
        if run and (x is None or x[0] != run[-1][1]):
            yield run[0][0], run[-1][1], b"".join(p[2] for p in run)
            run = []
        if x:
            run.append(x)


class Words:
    """The words of a layer, which are looked for when first asked for."""

    def __init__(self, s: bytes):
        self.s = s

    @cached_property
    def spans(self) -> tuple[list[int], list[int]]:
        found = [m.span() for m in WORDS.finditer(self.s)]
        return [x[0] for x in found], [x[1] for x in found]

    def around(self, a: int, b: int) -> tuple[int, int]:
        """a..b, which begins and ends in words, with the words that a match over its ends can reach: blanks only are between."""
        starts, ends = self.spans
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(ends, b)
        for _ in range(REACH):
            i -= i > 0 and self.s[ends[i - 1] : starts[i]].isspace()
            j += j + 1 < len(ends) and self.s[ends[j] : starts[j + 1]].isspace()
        return starts[i], ends[j]


def decoded(layer: Layer) -> Iterator[Layer]:
    s = layer.data

    def packed(name: str, data: bytes, a: int, b: int, end: int) -> Iterator[Layer]:
        """What is compressed in the decoded stretch, and its ends with what is before and after the stretch."""
        if layer.within(a, b):
            return
        names, where = (*layer.names, name, "zip"), layer.origin(a, b)
        for at in {0, *(m.start() for m in MAGIC.finditer(data))}:
            window = None
            for k, window in enumerate(windows(unpacked(data[at:] if at else data))):
                yield Layer(window, names, *where)
                if not k and not at:
                    lo, _ = words.around(a, b)
                    if lo < a:
                        yield Layer(s[lo:a] + window, names, *layer.origin(lo, b), (a - lo, a - lo + len(window)))
            if window is not None:
                _, hi = words.around(a, end)
                if end < hi:
                    yield Layer(window + s[end:hi], names, *layer.origin(a, hi), (0, len(window)))

    def put(name: str, data: bytes, first: np.ndarray, last: np.ndarray, a: int, b: int, end: int) -> Iterator[Layer]:
        """The decoded stretch a..b as a layer of its own, what is compressed in it, and in its place (up to `end`)."""
        if not layer.within(a, b):
            yield layer.inner(name, data, first, last)
        yield from packed(name, data, a, b, end)
        lo, hi = words.around(a, end)
        if lo < a or end < hi:
            yield layer.in_place(name, data, first, last, a, end, (lo, hi))

    words = Words(s)
    for name, parts in rewritings(s):
        if any(layer.touches(a, b) for a, b, _ in parts):
            yield layer.rewritten(name, parts)
            for a, b, data in together(parts):
                if layer.touches(a, b):
                    yield from packed(name, data, a, b, b)
    for m in RUN.finditer(s):
        if not layer.touches(*m.span()):
            continue
        raw, base = m[0], m.start()
        place = None
        if b"\n" in raw:
            place = np.flatnonzero(~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\r\n", np.uint8)))
            raw = BLANKS.sub(b"", raw)
        at = (lambda k: base + k) if place is None else (lambda k: base + place[k])  # noqa: B023, E731
        for h in HEXRUN.finditer(raw):
            for shift in (0, 1):
                a = h.start() + shift
                n = (h.end() - a) // 2
                k = a + 2 * np.arange(n)
                data = binascii.unhexlify(raw[a : a + 2 * n])
                end = int(at(a + 2 * n - 1)) + 1
                yield from put("hextext", data, at(k), at(k + 1), int(at(a)), end, end)
        raw = raw.translate(STANDARD)
        for shift in range(4):
            n = (len(raw) - shift) // 4 * 4
            rest = len(raw) - shift - n
            part = raw[shift : shift + n + rest] if rest > 1 else raw[shift : shift + n]
            data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            k = 8 * np.arange(len(data))
            end = int(at(shift + len(part) - 1)) + 1
            padding = sum(s[end : end + x] == b"=" * x for x in range(1, -len(part) % 4 + 1))
            yield from put("base64", data, at(shift + k // 6), at(shift + (k + 7) // 6), int(at(shift)), end, end + padding)


def secret_spans(text: str) -> list[Span]:
    """All spans of the text, of all layers, by start, end and kind, without repeats."""
    found = matches(text)
    if not (RUN.search(text.encode("utf-8", "surrogatepass")) or any(x in text for x in ("%", "\\", "&#", "\0"))):
        return sorted(found)
    known, seen = set(found), set()
    work = [decoded(Layer.of(text))]  # depth first: only the layers above the one at hand are held
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if len(layer.data) < 2:
            continue
        key = hashlib.blake2b(layer.data, digest_size=16, person=b"%x:%x" % layer.origin(0, len(layer.data))).digest(), layer.fresh
        if key in seen:
            continue
        seen.add(key)
        for a, b, kind in matches(layer.data):
            if not layer.touches(a, b) or layer.within(a, b):
                continue
            span = (*layer.origin(a, b), kind)
            if layer.fresh and any(k == kind and x <= span[0] and span[1] <= z for x, z, k in known):
                continue  # a plain value that was taken for an encoded one
            if span not in known:
                known.add(span)
                found.append((*span[:2], ".".join((*layer.names, kind))))
        work.append(decoded(layer))
    return sorted(set(found))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): the counts of the plain patterns, their digest, and all spans as kind:start:end.

    Null and empty texts have no spans (base_sha256 is that of the empty string); a null doc_id stays null;
    repeated rows each get a row; a very long text is held whole, with its layers; an empty table gives an empty
    result; other columns are ignored. A narrow map without a shuffle; memory is that of one text, of the layers
    above the one at hand, and of HELD bytes of a compressed one.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, texts in batches(found):
            out = []
            for text in texts:
                spans = secret_spans(text)
                shown = lambda some: ",".join(f"{k}:{a}:{z}" for a, z, k in some)
                base = sorted((x for x in spans if x[2] in KINDS), key=lambda x: (x[0], KINDS.index(x[2])))
                rest = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else 3, x))
                out.append((*(sum(x[2] == k for x in base) for k in KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(rest)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [x.split()[0] for x in SCHEMA.split(", ")])

    return doc_text(docs).mapInArrow(run, SCHEMA)
