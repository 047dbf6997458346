"""Media columns: signature sniffing, type correction, carving, and bytes stored as 8-bit samples.

One Aho-Corasick automaton locates the magic bytes of all formats in a value. A format's validator
then walks the structure from there and returns its length, or nothing if the bytes are only alike.
A valid format at offset 0 that fills the value is its type, whatever was declared; valid ones
further in are carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

UNIT = 64
#: What the texts were declared as; sniffing corrects it when the stored media are read.
DECLARED = "text/plain"
SAMPLE_RATE = 8000
#: Bytes of results that are handed on at once.
OUT_BYTES = 8_000_000


def _png(b: memoryview, at: int) -> int | None:
    """Chunks up to IEND, each with its check sum."""
    p = at + 8
    first = True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        p += 12 + size
        first = False
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(b: memoryview, at: int) -> int | None:
    """Marker segments, then entropy-coded data up to the end marker; a frame header must occur."""
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xFF:
            p += 1
            continue
        if marker == 0xD9:
            return p + 2 - at if frame else None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return None
        frame = frame or marker in (0xC0, 0xC1, 0xC2)
        p += 2 + size
        if marker == 0xDA:
            p = b.obj.find(b"\xff", p)
            while p >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p = b.obj.find(b"\xff", p + 2)
            if p < 0:
                return None
    return p + 2 - at if frame and p + 2 <= len(b) and b[p : p + 2] == b"\xff\xd9" else None


def _gif(b: memoryview, at: int) -> int | None:
    """Screen descriptor, colour tables and blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1 if p < len(b) else None

    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def wav_data(b: memoryview, at: int = 0) -> tuple[int, int, int] | None:
    """(length, start and size of the samples) of a RIFF/WAVE file whose chunks fill its stated size."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, shape, data = at + 12, False, None
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, p)
        if p + 8 + size > end:
            return None
        shape = shape or kind == b"fmt " and size >= 16
        if kind == b"data":
            data = p + 8, size
        p += 8 + size + (size & 1)
    return (end - at, *data) if shape and data else None


def _wav(b: memoryview, at: int) -> int | None:
    found = wav_data(b, at)
    return found[0] if found else None


def _bmp(b: memoryview, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return size if header in (12, 40, 52, 56, 64, 108, 124) and not reserved and 14 + header <= offset <= size <= len(b) - at else None


def _gzip(b: bytes, at: int, memo: dict) -> int | None:
    """Up to the end of the member; short pieces first, as most marks are no files. A name or comment needs a byte 0 after the fixed header."""
    if "zero" not in memo:
        memo["zero"] = b.rfind(b"\0")
    if at + 18 > len(b) or b[at + 3] & 0xE0 or b[at + 3] & 0x18 and memo["zero"] < at + 10:
        return None
    unpack, p, piece = zlib.decompressobj(31), at, 64
    try:
        while p < len(b) and not unpack.eof:
            unpack.decompress(b[p : p + piece], 1 << 20)
            p += piece
            piece = min(2 * piece, 65536)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return min(p, len(b)) - at - len(unpack.unused_data) if unpack.eof else None


def _places(b: bytes, mark: bytes, memo: dict) -> list[int]:
    """All places of a mark in a value, looked for once."""
    if mark not in memo:
        memo[mark] = [m.start() for m in re.finditer(re.escape(mark), b)]
    return memo[mark]


def _pdf(b: bytes, at: int, memo: dict) -> int | None:
    """Up to the last end mark before another file begins; a cross-reference must stand before the first."""
    ends, crosses, heads = [_places(b, m, memo) for m in (b"%%EOF", b"startxref", b"%PDF-")]
    first, cross, head = bisect_left(ends, at), bisect_left(crosses, at), bisect_right(heads, at)
    if first == len(ends) or cross == len(crosses) or crosses[cross] > ends[first]:
        return None
    last = bisect_left(ends, heads[head]) - 1 if head < len(heads) else len(ends) - 1
    return ends[max(first, last)] + 5 - at


def _zip(b: bytes, at: int, memo: dict) -> int | None:
    """Up to the end record whose directory offset and size agree with its place: each end record belongs to one start."""
    if "zip" not in memo:
        memo["zip"] = {}
        for p in _places(b, b"PK\x05\x06", memo):
            if p + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, p + 12)
                start = p - size - offset
                if start >= 0 and p + 22 + note <= len(b) and b[start + offset : start + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    memo["zip"].setdefault(start, p + 22 + note)
    end = memo["zip"].get(at)
    return None if end is None else end - at


def _ogg(b: bytes, at: int, memo: dict) -> int | None:
    """Pages up to the one with the end flag; where a page leads is kept for all pages on the way, so that each is walked once."""
    ends, way, p = memo.setdefault("ogg", {}), [], at
    end = None
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS":
        if p in ends:
            end = ends[p]
            break
        segments = b[p + 26]
        if p + 27 + segments > len(b):
            break
        way.append(p)
        last = bool(b[p + 5] & 4)
        p += 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if last:
            end = p if p <= len(b) else None
            break
    for page in way:
        ends[page] = end
    return None if end is None else end - at


def _mp4(b: bytes, at: int, memo: dict) -> int | None:
    """Boxes from ftyp on; at is the place of the four bytes before the magic. The end and whether a moov is met are kept for all boxes on the way."""
    known, way, p = memo.setdefault("mp4", {}), [], at
    while p not in known and p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        way.append((p, kind == b"moov"))
        p += size
    end, moov = known.get(p, (p, False))
    for box, own in reversed(way):
        moov = moov or own
        known[box] = end, moov
    return end - at if moov else None


#: Type, magic bytes, their place in the file, validator.
FORMATS: list[tuple[str, bytes, int, Callable[..., int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/bmp", b"BM", 0, _bmp),
    ("audio/wav", b"RIFF", 0, _wav),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
]


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, (_, magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), i)
    out.make_automaton()
    return out


_machine: list[ahocorasick.Automaton] = []


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each valid file in value, outermost only, in order; the marks of a value are looked for once."""
    if not _machine:
        _machine.append(_automaton())
    view, found, covered, memo = memoryview(value), [], 0, {}
    hits = sorted((end - len(FORMATS[i][1]) + 1 - FORMATS[i][2], i) for end, i in _machine[0].iter(value.decode("latin-1")))
    for at, i in hits:
        if at < covered or at < 0:
            continue
        check = FORMATS[i][3]
        length = check(value, at, memo) if check in (_pdf, _zip, _ogg, _mp4, _gzip) else check(view, at)
        if length:
            found.append((FORMATS[i][0], at, length))
            covered = at + length
    return found


SNIFFED = "media_type string, declared_ok boolean, length long, embedded array<struct<media_type:string,offset:long,length:long>>"


def sniff_media(rows: DataFrame, id_col: str, content_col: str, declared_col: str | None = None) -> DataFrame:
    """id, media_type, declared_ok, length, embedded of every row.

    media_type is the validated type at offset 0 (null if none), length its length; declared_ok says
    whether the declared type agrees (null without one). embedded lists valid files further in. Null
    and empty contents have no type and no embedded files. Repeated rows give repeated results; no
    rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, oks, lengths, inner = [], [], [], []
            for value, declared in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = sniff(value.as_py() or b"")
                own = found[0] if found and found[0][1] == 0 else None
                kinds.append(own[0] if own else None)
                oks.append(None if declared is None else own is not None and declared == own[0])
                lengths.append(own[2] if own else None)
                inner.append([{"media_type": t, "offset": o, "length": n} for t, o, n in found if o > 0])
            kind = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(oks, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(inner, kind)], ["id", "media_type", "declared_ok", "length", "embedded"])

    declared = F.lit(None).cast("string") if declared_col is None else F.col(declared_col).cast("string")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).cast("binary").alias("content"), declared.alias("declared")).mapInArrow(run, f"id long, {SNIFFED}")


def carve(rows: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, media_type, offset, content: one row for each file found inside a value; null and empty values and no rows give none."""
    found = rows.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py() or b""
                out += [(row, t, o, raw[o : o + n]) for t, o, n in sniff(raw) if o > 0]
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["id", "media_type", "offset", "content"])

    return found.select(F.col("id").cast("long"), "content").mapInArrow(run, "id long, media_type string, offset long, content binary")


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples; no bytes give no samples."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload) + len(pad)) + b"WAVE" + head + payload + pad


def _batches(ids: list, columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as stored media: doc_id, n_bytes, declared_type, media. Null texts count as empty; bytes 0 fill up to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n_bytes", "declared_type", "media"], [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (value.as_py() or "").encode()
                payload = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
                ids.append(doc_id)
                sizes.append(len(raw))
                media.append(to_wav(payload))
                held += len(payload)
                if held > OUT_BYTES:
                    yield _batches(ids, [sizes, [DECLARED] * len(ids), media], names, kinds)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield _batches(ids, [sizes, [DECLARED] * len(ids), media], names, kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, declared_type string, media binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """Read stored media back: sizes, digests and a feature string of each row.

    media_type is the sniffed type and corrects the declared one (declared_ok says whether they agree);
    a value that is no whole WAV file has a null payload and the feature 'invalid'. The feature holds
    the type, samples, mean, peak, zero samples and embedded files. Repeated rows give repeated
    results; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for value, declared in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = value.as_py() or b""
                shape = wav_data(memoryview(raw))
                found = sniff(raw)
                if not shape or shape[0] != len(raw) or not found or found[0][:2] != ("audio/wav", 0):
                    row = (None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), "invalid")
                else:
                    payload = raw[shape[1] : shape[1] + shape[2]]
                    samples = np.frombuffer(payload, np.uint8)
                    inner = sniff(payload)
                    feature = f"audio/wav;samples={len(samples)};mean={int(samples.sum()) * 1000 // max(1, len(samples))};peak={int(samples.max(initial=0))};zeros={int((samples == 0).sum())};embedded={len(inner)}"
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)
                kind = found[0][0] if found and found[0][1] == 0 else None
                row += (kind, None if declared is None else kind == declared)
                for column, x in zip(cols, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", *_FEATURES])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, declared_ok boolean"
    return stored.select("doc_id", "n_bytes", "media", "declared_type").mapInArrow(run, schema)


_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "declared_ok"]


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents stored as media and read back; null texts count as empty."""
    return media_features(store_texts(table(spark, sf_dir, "documents")))
