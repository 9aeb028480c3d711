"""Secret scans with a recursive decoding worklist.

Every text is scanned for assignments, access keys and hexadecimal runs.  Then
its encoded parts are unwrapped (URL escapes, Unicode escapes and character
references, base64, compressed data), each result is scanned again and unwrapped
in turn, until nothing new appears.  A layer that was seen before at the same
place is not taken up again, so cycles end.  Spans found in a layer are mapped
back to code points of the text that was given.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run, as runs are maximal
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KEYWORDS = ("passw", "secret", "token", "api")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|(&#[^;]+;)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])+")
BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\U000000([0-9A-Fa-f]{2})|(&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)|\\([abfnrtv0'"\\])|([\x00-\xff])""")
PLAIN = dict(zip("abfnrtv0'\"\\", b"\a\b\f\n\r\t\v\0'\"\\", strict=True))
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
#: Decompressed data is read to its end in windows of so many bytes, cut at white space, which share OVERLAP.
LAYER_BYTES = 64 << 20
OVERLAP = 1 << 16
PIECE = 1 << 20
#: Compressed streams one right in another; a text whose streams go deeper, or are of a kind that can't be opened here, is marked as not read to its end.
DEPTH = 64
#: Control characters, what was no UTF-8, and the like; the shortest secret has 14 characters.
UNREADABLE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\ud7ff\\uf900-\\ufffc\\U00010000-\\U000e007f]+")
LEAST_READABLE = 12


class Unread(Exception):
    """A compressed stream that was not read to its end."""

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """(kind, start, end) of the secrets that stand in the text itself."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Feed:
    """Bytes from pieces, with a look ahead."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.used = pieces, b"", 0

    def head(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        self.head(1)
        out, self.held = self.held[:n], self.held[n:]
        self.used += len(out)
        return out

    def back(self, rest: bytes) -> None:
        self.held, self.used = rest + self.held, self.used - len(rest)


def opened(head: bytes):
    """A decompressor for a gzip, zlib, bzip2, xz or zstandard stream; None for anything else."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        try:
            import zstandard
        except ImportError:
            raise Unread from None

        return zstandard.ZstdDecompressor().decompressobj()
    return None


def inflated(feed: Feed) -> Iterator[bytes]:
    """What the streams one after another hold, in pieces; ends at anything else and at damage."""
    while (stream := opened(feed.head(6))) is not None:
        bounded = not type(stream).__name__.startswith("Zstd")
        try:
            while not stream.eof and (data := feed.take(1 << 16 if bounded else 1 << 10)):
                while True:
                    out = stream.decompress(data, PIECE) if bounded else stream.decompress(data)
                    if out:
                        yield out
                    if stream.eof or not bounded:
                        break
                    data = getattr(stream, "unconsumed_tail", b"")
                    if not data and getattr(stream, "needs_input", len(out) < PIECE):
                        break
            if not stream.eof:
                return
            feed.back(stream.unused_data)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        except Exception as error:  # zstandard raises a type of its own
            if type(error).__name__ != "ZstdError":
                raise
            return
        while feed.head(1) == b"\0":  # padding between streams
            feed.take(1)


def windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined to windows of LAYER_BYTES, cut at white space where there is some, never in a character of UTF-8."""
    held: list[bytes] = []
    size = 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size < LAYER_BYTES + OVERLAP:
            continue
        data = b"".join(held)
        cut = max(data.rfind(b"\n"), data.rfind(b" ")) + 1
        if cut <= OVERLAP:
            cut = len(data)
        start = cut - 1
        while cut - start < 4 and data[start] & 0xC0 == 0x80:
            start -= 1
        if data[start] >= 0xC0 and cut - start < (2 if data[start] < 0xE0 else 3 if data[start] < 0xF0 else 4):
            cut = start
        yield data[:cut]
        start = cut - OVERLAP
        while start < cut and data[start] & 0xC0 == 0x80:
            start += 1
        held, size = [data[start:]], len(data) - start
    if size:
        yield b"".join(held)


def texts_of(data: bytes, unread: list[int]) -> tuple[list[str], int]:
    """(texts of the compressed streams that bytes begin with, one in another, how many bytes they take); counts up ``unread`` where a stream stays closed."""
    feed = Feed(iter([data]))
    try:
        if opened(data[:6]) is None:
            return [], 0
    except Unread:
        unread[0] += 1
        return [], 0

    def innermost(feed: Feed, depth: int = 1) -> Iterator[bytes]:
        inner = Feed(inflated(feed))
        try:
            more = opened(inner.head(6)) is not None
        except Unread:
            more, depth = True, DEPTH
        if more and depth >= DEPTH:
            unread[0] += 1
        elif more:
            yield from innermost(inner, depth + 1)
        while out := inner.take(PIECE):  # what follows the streams, or is none
            yield out

    return [t for w in windows(innermost(feed)) for t in readable(w)], feed.used


def readable(data: bytes) -> list[str]:
    """The stretches of bytes that are UTF-8 and can be read, LEAST characters or more: a secret may stand among others."""
    return [t for t in UNREADABLE.split(data.decode("utf-8", "replace")) if len(t) >= LEAST_READABLE]


def unbase64(token: str) -> bytes | None:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _bytes_text(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run of %XX with the places they come from."""
    data = bytes.fromhex(run.replace("%", ""))
    out, i = [], 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            char = data[i : i + size].decode()
        except UnicodeDecodeError:
            size, char = 1, chr(data[i])
        out.append((char, 3 * i, 3 * (i + size)))
        i += size
    return out


def _escape_text(run: str) -> list[tuple[str, int, int]]:
    out = []
    for m in ONE.finditer(run):
        if m[4]:
            char = html.unescape(m[4])
        else:
            code = int(m[1] or m[2] or m[3], 16)
            char = chr(code) if code < 0x110000 else "�"
        out += [(c, m.start(), m.end()) for c in char]
    return out


class Layer:
    """A text, and for each of its characters the span of the given text it comes from.

    ``start`` None: the text is the given one; of one entry: all of it comes from there.
    """

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        if len(self.start) == 1:
            return int(self.start[0]), int(self.end[0])
        return int(self.start[a]), int(self.end[b - 1])

    def key(self) -> tuple:
        where = ("whole",) if self.start is None or len(self.start) > 1 else (int(self.start[0]), int(self.end[0]))
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), where

    def replaced(self, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int, int]]]) -> Layer | None:
        """The layer with every match of ``pattern`` decoded, the rest as it is."""
        parts: list[str] = []
        starts: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        at = 0
        for m in pattern.finditer(self.text):
            chars = decode(m[0])
            plain = np.arange(at, m.start())
            parts += [self.text[at : m.start()], *(c for c, _, _ in chars)]
            starts += [plain, np.array([m.start() + a for _, a, _ in chars], np.int64)]
            ends += [plain + 1, np.array([m.start() + b for _, _, b in chars], np.int64)]
            at = m.end()
        if not parts:
            return None
        plain = np.arange(at, len(self.text))
        text = "".join([*parts, self.text[at:]])
        start, end = np.concatenate([*starts, plain]).astype(np.int64), np.concatenate([*ends, plain + 1]).astype(np.int64)
        if self.start is not None:
            if len(self.start) == 1:
                return Layer(text, self.start, self.end)
            start, end = self.start[start], self.end[end - 1]
        if len(start) == 1:  # one character: its span stands for all of it
            return Layer(text, start, end)
        return Layer(text, start, end) if len(start) else None


def unwrapped(layer: Layer, unread: list[int]) -> Iterator[Layer]:
    """The layers right below one."""
    text = layer.text
    if "%" in text and (out := layer.replaced(URL, _bytes_text)):
        yield out
    if ("\\" in text or "&#" in text) and (out := layer.replaced(ESCAPE, _escape_text)):
        yield out
    for a, b, token in tokens64(text):
        for skip in range(4):  # the token may begin with other characters
            data = unbase64(token[skip:])
            for inner in readable(data) if data else ():
                start, end = layer.origin(a, b)
                yield Layer(inner, np.array([start]), np.array([end]))
            for inner, _, _ in streams_of(data or b"", unread):
                start, end = layer.origin(a, b)
                yield Layer(inner, np.array([start]), np.array([end]))
    for data, begin, finish in byte_runs(text):
        for inner, i, j in streams_of(data, unread):
            start, end = layer.origin(int(begin[i]), int(finish[j - 1]))
            yield Layer(inner, np.array([start]), np.array([end]))


def streams_of(data: bytes, unread: list[int]) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the compressed streams anywhere in some bytes."""
    at = 0
    while (m := MAGIC.search(data, at)) is not None:
        inner, used = texts_of(data[m.start() :], unread)
        at = m.start() + (max(used, 1) if inner else 1)
        for t in inner:
            yield t, m.start(), at


def tokens64(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of base64 in one run, and of runs that lines may have wrapped."""
    for m in BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
    if "\n" not in text:
        return
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        spans = {(0, len(lines)), (0, len(lines) - 1)}
        i = 0
        while i < len(lines):  # lines of one length and a last, shorter one
            j, size = i + 1, lines[i][1] - lines[i][0]
            while j < len(lines) and lines[j][1] - lines[j][0] == size:
                j += 1
            spans |= {(i, j), (i, j + 1)}
            i = j
        for i, j in sorted(spans):
            if j - i > 1 and j <= len(lines):
                yield lines[i][0], lines[j - 1][1], "".join(text[a:b] for a, b in lines[i:j])


def byte_runs(text: str) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Bytes written as %XX or as escapes, plain characters between, with the start and end of each."""
    if "%" in text:
        for m in URL_BYTES.finditer(text):
            if "%" in m[0]:
                runs = [(int(x[0][1:], 16) if x[0][0] == "%" else 0x20 if x[0] == "+" else ord(x[0]), m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"%..|.", m[0])]
                data, begin, finish = map(list, zip(*runs, strict=True))
                yield bytes(data), begin, finish
    if "\\x" in text or "\\u00" in text or "\\U000000" in text or "&#" in text:
        data, begin, finish = bytearray(), [], []
        for m in BYTE.finditer(text):
            code = int(m[1] or m[2] or m[3], 16) if m[1] or m[2] or m[3] else PLAIN[m[5]] if m[5] else ord(m[6]) if m[6] else int(m[4][3:-1], 16) if m[4][2] in "xX" else int(m[4][2:-1])
            if (finish and finish[-1] != m.start()) or code > 255:
                yield bytes(data), begin, finish
                data, begin, finish = bytearray(), [], []
            if code <= 255:
                data.append(code)
                begin.append(m.start())
                finish.append(m.end())
        yield bytes(data), begin, finish


def all_spans(text: str) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, base and decoded spans, layers unwrapped, compressed streams not read to their end); both lists in order of start, kind, end."""
    base = scan(text)
    found = set(base)
    seen, work, layers, unread = set(), [Layer(text)], 0, [0]
    while work:
        for inner in unwrapped(work.pop(), unread):
            key = inner.key()
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            found.update((kind, *inner.origin(a, b)) for kind, a, b in scan(inner.text))
            work.append(inner)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order), layers, unread[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            base, spans, layers, unread = all_spans(text.as_py() or "")
            n = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), layers, unread))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_layers", "n_unread"])


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, n_layers, n_unread.

    A null or empty text has no span.  Spans are kind:start:end in code points,
    end exclusive, by start, then kind; base_sha256 is over those that stand in
    the text itself.  A secret found in a layer is reported at the place of
    the encoded characters it comes from, for base64 at that of the whole
    token; the same kind and place count once.  n_unread counts compressed
    streams that were not read to their end: those nested more than DEPTH deep,
    or of a kind whose library is missing; 0 says that all was read.  Texts are
    scanned whole, however long.  Repeated rows and rows without a doc_id get a
    row each, an empty table gives none; other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_layers long, n_unread long"
    )
