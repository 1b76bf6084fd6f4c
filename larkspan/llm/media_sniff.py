"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over stored bytes.  A validator per format
then walks the structure behind each hit (chunk lengths, checksums, trailers) and returns where the medium ends, or 0.
Validators work by offsets in the whole bytes; trailers are found once for all hits, and walks that meet at a place go on
as one, so many false hits cost no more than a pass.  The format that starts the bytes corrects the declared type; valid
media at later offsets are carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

BLOCK = 192
RATE = 8000
#: Magic bytes, the offset of the file's start before them, and the format.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": (0, "png"),
    b"\xff\xd8\xff": (0, "jpeg"),
    b"GIF87a": (0, "gif"),
    b"GIF89a": (0, "gif"),
    b"RIFF": (0, "riff"),
    b"%PDF-": (0, "pdf"),
    b"PK\x03\x04": (0, "zip"),
    b"\x1f\x8b\x08": (0, "gzip"),
    b"OggS": (0, "ogg"),
    b"BM": (0, "bmp"),
    b"ftyp": (4, "mp4"),
}
_KINDS = tuple(dict.fromkeys(kind for _, kind in MAGIC.values()))
TYPES = {
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo",
    "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "bmp": "image/bmp", "mp4": "video/mp4",
}


_OGG_POLY_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_FORMS = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}
_WEBP = (b"VP8 ", b"VP8L", b"VP8X")
_AFTER_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


#: Bytes between two remembered CRCs.
CRC_STEP = 2048
_CRC_POLY = 0xEDB88320


@cache
def _crc_tables(k: int) -> tuple[tuple[int, ...], ...]:
    """What 2 ** k zero bytes do to a CRC-32, for each value of each of its four bytes."""
    if k:
        below = _crc_tables(k - 1)
        bits = [_apply(below, _apply(below, 1 << i)) for i in range(32)]
    else:
        bits = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = c >> 1 ^ (_CRC_POLY if c & 1 else 0)
            bits.append(c)
    out = []
    for byte in range(4):
        row = [0] * 256
        for v in range(1, 256):
            low = (v & -v).bit_length() - 1
            row[v] = row[v & v - 1] ^ bits[8 * byte + low]
        out.append(tuple(row))
    return tuple(out)


def _apply(tables: tuple[tuple[int, ...], ...], c: int) -> int:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def crc_moved(crc: int, by: int) -> int:
    """The part of a CRC-32 that is left of ``crc`` when ``by`` more bytes follow; with the CRC of those it gives that of both."""
    k = 0
    while by:
        if by & 1:
            crc = _apply(_crc_tables(k), crc)
        by >>= 1
        k += 1
    return crc


class _Walk:
    """Validators over the bytes of one text; each takes where its format's file would start and returns its end, or 0."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.seen: dict[tuple[str, int], int] = {}
        self.found: dict[bytes, list[int]] = {}
        self.chunks: dict[int, tuple[int, int, int]] = {}
        self.before: list[int] = [0]
        self.streams: dict[int, tuple[int, int, int]] = {}

    def crc(self, at: int, end: int) -> int:
        """CRC-32 of a range, for a price that does not grow with its length: from the CRCs of all data before its ends."""
        if end - at <= 2 * CRC_STEP:
            return zlib.crc32(self.data[at:end])
        while len(self.before) * CRC_STEP < end:
            done = len(self.before) * CRC_STEP
            self.before.append(zlib.crc32(self.data[done - CRC_STEP : done], self.before[-1]))
        one, two = (zlib.crc32(self.data[x - x % CRC_STEP : x], self.before[x // CRC_STEP]) for x in (at, end - 1))
        two = zlib.crc32(self.data[end - 1 : end], two)
        return two ^ crc_moved(one, end - at)

    def number(self, at: int, n: int, order: str = "little") -> int:
        return int.from_bytes(self.data[at : at + n], order)

    def places(self, pattern: bytes) -> list[int]:
        """All offsets of ``pattern``, searched once."""
        if pattern not in self.found:
            self.found[pattern] = [m.start() for m in re.finditer(re.escape(pattern), self.data)]
        return self.found[pattern]

    def next_of(self, pattern: bytes, at: int) -> int:
        """The first offset of ``pattern`` from ``at`` on, or -1."""
        known = self.places(pattern)
        k = bisect_left(known, at)
        return known[k] if k < len(known) else -1

    def follow(self, kind: str, at: int, step) -> int:
        """Walk from ``at`` by ``step``, which gives (next place, None) or (None, end); each place is walked once."""
        trail, end = [], self.seen.get((kind, at))
        while end is None:
            trail.append(at)
            at, end = step(at)
            if end is None:
                end = self.seen.get((kind, at))
        for place in trail:
            self.seen[kind, place] = end
        return end

    def png(self, start: int) -> int:
        if self.data[start + 8 : start + 16] != b"\0\0\0\rIHDR":
            return 0

        def chunk(at: int):
            n, body = self.number(at, 4, "big"), at + 8
            if body + n + 4 > self.size or self.crc(at + 4, body + n) != self.number(body + n, 4, "big"):
                return None, 0
            return (None, body + n + 4) if self.data[at + 4 : body] == b"IEND" else (body + n + 4, None)

        return self.follow("png", start + 8, chunk)

    def jpeg(self, start: int) -> int:
        def segment(at: int):
            while at + 1 < self.size and self.data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > self.size or self.data[at] != 0xFF:
                return None, 0
            kind = self.data[at + 1]
            if kind == 0xD9:
                return None, at + 2
            if kind == 1 or 0xD0 <= kind <= 0xD7:
                return at + 2, None
            n = self.number(at + 2, 2, "big")
            if n < 2 or kind in (0, 0xD8):
                return None, 0
            if kind != 0xDA:
                return at + 2 + n, None
            m = _AFTER_SCAN.search(self.data, at + 2 + n)
            return (m.end() - 2, None) if m else (None, 0)

        return self.follow("jpeg", start + 2, segment) if self.places(b"\xff\xd9") else 0

    def gif(self, start: int) -> int:
        if start + 14 > self.size:
            return 0

        def table(flags: int) -> int:
            return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

        def sub_block(at: int):
            if at >= self.size:
                return None, 0
            return (None, at + 1) if not self.data[at] else (at + 1 + self.data[at], None)

        def block(at: int):
            mark = self.data[at] if at < self.size else 0
            if mark == 0x3B:
                return None, at + 1
            if mark == 0x21:
                after = self.follow("gif-data", at + 2, sub_block)
            elif mark == 0x2C and at + 10 < self.size:
                after = self.follow("gif-data", at + 11 + table(self.data[at + 9]), sub_block)
            else:
                after = 0
            return (after, None) if after else (None, 0)

        at = start + 13 + table(self.data[start + 10])
        return self.follow("gif", at, block) if at < self.size and self.data[at] in b";!," else 0

    def riff(self, start: int) -> int:
        form, first = self.data[start + 8 : start + 12], self.data[start + 12 : start + 16]
        if form not in _FORMS:
            return 0
        usual = {b"WAVE": first != b"data", b"WEBP": first in _WEBP, b"AVI ": first == b"LIST"}.get(form, False)
        end = start + 8 + self.number(start + 4, 4)
        if not usual or end > self.size:
            return 0
        if form == b"WEBP":
            good = {b"VP8 ": self.data[start + 23 : start + 26] == b"\x9d\x01\x2a", b"VP8L": self.data[start + 20 : start + 21] == b"/", b"VP8X": self.number(start + 16, 4) == 10}
            if not good[first]:
                return 0
        return end if self._reaches(start + 12, end) else 0

    def _reaches(self, at: int, end: int) -> bool:
        """Whether RIFF chunks from ``at`` on come to stand exactly at ``end``.

        Chunks are padded to the parity of the first, so walks that meet go on together: a forest with its roots beyond
        the data.  Every place is walked once and gets a jump towards its root besides the next chunk, of a span that
        grows with its depth, so that ``end`` is found on the way in a logarithmic number of steps.
        """
        trail, place = [], at
        while place not in self.chunks and place + 8 <= self.size:
            trail.append(place)
            place += 8 + self.number(place + 4, 4)
            place += (place - at) % 2
        self.chunks.setdefault(place, (place, place, 0))  # a root is its own next
        for below in reversed(trail):
            depth, jump = self.chunks[place][2], self.chunks[place][1]
            again = self.chunks[jump]
            far = again[1] if depth - again[2] == again[2] - self.chunks[again[1]][2] else place
            self.chunks[below] = (place, far, depth + 1)
            place = below
        while at < end:
            after, far, depth = self.chunks[at]
            if not depth:
                return False
            at = far if far <= end else after
        return at == end

    def pdf(self, start: int) -> int:
        end = self.next_of(b"%%EOF", start)
        return end + 5 if end >= 0 and start < self.next_of(b"startxref", start) < end else 0

    def zip(self, start: int) -> int:
        if "zip" not in self.found:
            self.found["zip"] = {}
            for at in reversed(self.places(b"PK\x05\x06")):
                size, begin = self.number(at + 12, 4), self.number(at + 16, 4)
                if at + 22 <= self.size and (not size or self.data[at - size : at - size + 4] == b"PK\x01\x02"):
                    self.found["zip"][at - size - begin] = at + 22 + self.number(at + 20, 2)
        return self.found["zip"].get(start, 0)

    def gzip(self, start: int) -> int:
        flags, at = self.data[start + 3] if start + 18 <= self.size else 0xFF, start + 10
        if flags & 0xE0:
            return 0
        if flags & 4:
            at += 2 + self.number(at, 2)
        for name in (8, 16):
            if flags & name:
                at = self.next_of(b"\0", at) + 1
                if not at:
                    return 0
        end, crc, n = self._deflated(at + (flags & 2))
        return end + 8 if end and end + 8 <= self.size and self.number(end, 4) == crc and self.number(end + 4, 4) == n & 0xFFFFFFFF else 0

    def _deflated(self, start: int) -> tuple[int, int, int]:
        """(end, CRC-32, length) of what a deflate stream holds; end 0 where it is none.

        Stored blocks that lead a stream stand at whole bytes and lead into the same blocks from many starts: each is
        read once, and what follows it is remembered by its place.
        """
        trail, at, told = [], start, None
        while told is None:
            told = self.streams.get(at)
            if told is None and at + 5 <= self.size and not self.data[at] & 6:
                n = self.number(at + 1, 2)
                if n ^ self.number(at + 3, 2) != 0xFFFF or at + 5 + n > self.size:
                    trail.append((at, 0))
                    told = (0, 0, 0)
                else:
                    trail.append((at, n))
                    if self.data[at] & 1:
                        told = (at + 5 + n, 0, 0)
                    at += 5 + n
            elif told is None:
                told = self.streams[at] = self._inflated(at)
        for place, n in reversed(trail):
            end, crc, length = told
            if end:
                told = (end, crc_moved(self.crc(place + 5, place + 5 + n), length) ^ crc, n + length)
            self.streams[place] = told
        return told

    def _inflated(self, start: int) -> tuple[int, int, int]:
        one, at, crc, n = zlib.decompressobj(-15), start, 0, 0
        try:
            while at < self.size and not one.eof:
                part = self.data[at : at + 65536]
                at += len(part)
                while part and not one.eof:
                    out = one.decompress(part, 1 << 20)
                    crc, n, part = zlib.crc32(out, crc), n + len(out), one.unconsumed_tail
        except zlib.error:
            return 0, 0, 0
        return (at - len(one.unused_data), crc, n) if one.eof else (0, 0, 0)

    def ogg(self, start: int) -> int:
        def page(at: int):
            if self.data[at : at + 5] != b"OggS\0" or at + 27 > self.size:
                return None, 0
            n = self.data[at + 26]
            end = at + 27 + n + sum(self.data[at + 27 : at + 27 + n])
            last = self.data[at + 5] & 4
            if at + 27 + n > self.size or end > self.size or not (last or self.data[end : end + 5] == b"OggS\0"):
                return None, 0
            # the checksum runs high bit first, so zlib's gets every byte reversed
            turned = (self.data[at : at + 22] + b"\0\0\0\0" + self.data[at + 26 : end]).translate(_OGG_POLY_REVERSED)
            crc = int(f"{zlib.crc32(turned, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)
            if crc != self.number(at + 22, 4):
                return None, 0
            return (None, end) if last else (end, None)

        return self.follow("ogg", start, page)

    def bmp(self, start: int) -> int:
        head = self.number(start + 14, 4)
        if head not in (12, 40, 52, 56, 108, 124):
            return 0
        size, begin = self.number(start + 2, 4), self.number(start + 10, 4)
        return start + size if 14 + head <= begin <= size <= self.size - start else 0

    def mp4(self, start: int) -> int:
        """``ftyp``, then boxes up to the first place that begins none; media data must be among them."""

        def box(at: int):
            n, kind = self.number(at, 4, "big"), self.data[at + 4 : at + 8]
            if at + 8 > self.size or n < 8 or at + n > self.size or not kind.isalnum():
                return None, at
            return at + n, None

        def media(at: int):
            after, end = box(at)
            return (None, 0) if end is not None else (None, 1) if self.data[at + 4 : at + 8] in (b"moov", b"mdat", b"moof") else (after, None)

        first = self.number(start, 4, "big")
        if self.data[start + 4 : start + 8] != b"ftyp" or not 8 <= first <= self.size - start or not self.follow("mp4-media", start + first, media):
            return 0
        return self.follow("mp4", start, box)


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (before, kind) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), 16 * (len(magic) - 1 + before) - _KINDS.index(kind))
    found.make_automaton()
    return found


def carve(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all valid media, in order.  Media inside a container that starts at 0 are told too; otherwise none overlap."""
    out, free, walk = [], 0, None
    for hit in _hits(data):
        at, kind = hit >> 4, _KINDS[hit & 15]
        if at < free:
            continue
        walk = walk or _Walk(data)
        if end := getattr(walk, kind)(at):
            name = _FORMS[data[at + 8 : at + 12]] if kind == "riff" else kind
            out.append((TYPES[name], at, end - at))
            free = end if at else 1
    return out


def _hits(data: bytes) -> list[int]:
    """Where a file may start, times 16, plus the number of its format."""
    found = [end * 16 - back for end, back in _automaton().iter(data.decode("latin-1"))]
    return sorted(x for x in found if x >= 0)


def wav(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAV file."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def sniffed(df: DataFrame, data_col: str, declared_col: str) -> DataFrame:
    """``df`` with media_type (the type found at the start, else the declared one), declared_ok and carved.

    ``carved`` lists (type, start, length).  Null and empty data carve nothing and keep the declared type.  Rows are
    judged one by one, so repeated rows repeat their result; an empty table gives no rows.  Columns of ``df`` with the
    three new names are replaced.
    """
    one = T.StructType().add("type", T.StringType()).add("start", T.IntegerType()).add("length", T.IntegerType())
    df = df.drop(*[c for c in ("media_type", "declared_ok", "carved") if c not in (data_col, declared_col)])
    schema = T.StructType(df.schema.fields + [T.StructField("media_type", T.StringType()), T.StructField("declared_ok", T.BooleanType()), T.StructField("carved", T.ArrayType(one))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, oks, lists = [], [], []
            for data, declared in zip(batch.column(data_col), batch.column(declared_col).to_pylist()):
                found = carve(data.as_py() or b"")
                first = found[0][0] if found and found[0][1] == 0 else None
                types.append(first or declared)
                oks.append(first == declared if first else None)
                lists.append([{"type": t, "start": s, "length": n} for t, s, n in found])
            kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
            new = [pa.array(types, pa.string()), pa.array(oks, pa.bool_()), pa.array(lists, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "media_type", "declared_ok", "carved"])

    return df.mapInArrow(run, schema)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text, padded with spaces to a positive multiple of 192 bytes, as a WAV file.

    The table is written to the shared folder and read back.  A null text is an empty one.  Every row has its own media,
    repeated rows too; rows without an id keep a null; extra columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
                media = [wav(t + b" " * (-len(t) % BLOCK or (0 if t else BLOCK))) for t in texts]
                cols = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(["application/octet-stream"] * len(texts)), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "declared", "media"])

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, declared string, media binary")
    return materialise(made, "media")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and a feature string of stored WAV files, all from the bytes read back.

    The feature string depends on the stored bytes alone: format, sample statistics, and what was carved.  Repeated rows
    repeat their result; an empty table gives no rows.
    """
    out = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, kind, carved, data in zip(*(batch.column(c).to_pylist() for c in ("id", "n_bytes", "media_type", "carved", "media"))):
                samples = wav_samples(data)
                x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
                inside = ",".join(f"{c['type']}@{c['start']}+{c['length']}" for c in carved)
                turns = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
                text = f"{kind};rate={RATE};samples={len(x)};mean={x.mean():.4f};rms={np.sqrt(np.mean(x * x)):.4f};turns={turns:.4f};carved={inside}"
                rows.append((i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), text))
            names = [x.split()[0] for x in out.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in out.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return sniffed(media, "media", "declared").mapInArrow(run, out)
