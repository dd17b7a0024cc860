"""Media columns: lossless storage, signature sniffing and carving.

Bytes are stored as media of a known format and read back.  The type of
stored or foreign bytes is never taken from a label: an Aho-Corasick
automaton over magic bytes proposes candidates in one pass, a validator of
each format walks its structure and gives the exact length, and only what
a validator confirms counts.  The confirmed type at offset zero corrects a
declared type; confirmed media at other offsets are carved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 192
RATE = 8000


def pad(payload: bytes) -> bytes:
    """Append bytes 32 up to a positive multiple of ``ROW``."""
    return payload + b" " * (-len(payload) % ROW if payload else ROW)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit mono PCM; an odd data chunk gets its pad byte."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def to_bmp(samples: bytes) -> bytes:
    """A 24-bit bitmap of rows of ``ROW`` bytes, 64 pixels, without padding."""
    head = struct.pack("<2sIHHI", b"BM", 54 + len(samples), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, ROW // 3, len(samples) // ROW, 1, 24, 0, len(samples), 2835, 2835, 0, 0) + samples


def to_au(samples: bytes, rate: int = RATE) -> bytes:
    """An AU file of 8-bit linear mono PCM."""
    return struct.pack(">4sIIIII", b".snd", 24, len(samples), 2, rate, 1) + samples


def stored_form(payload: bytes) -> bytes:
    """Payloads take turns by their number of rows: WAVE, bitmap, AU."""
    return (to_wav, to_bmp, to_au)[len(payload) // ROW % 3](payload)


@dataclass(frozen=True)
class Media:
    """Confirmed media: its type, byte range and where its samples lie."""

    kind: str
    start: int
    end: int
    data_start: int
    data_end: int
    detail: str


def _wav(b: memoryview, at: int) -> Media | None:
    if len(b) - at < 44 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, fmt, data = at + 12, None, None
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        body = pos + 8
        if body + size > end:
            return None
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, body)
        elif name == b"data" and data is None:
            data = (body, body + size)
        pos = body + size + (size & 1)
    if fmt is None or data is None or pos != end or not fmt[1] or fmt[4] * 8 != fmt[1] * fmt[5]:
        return None
    return Media("audio/wav", at, end, *data, f"channels={fmt[1]},rate={fmt[2]},bits={fmt[5]}")


def _png(b: memoryview, at: int) -> Media | None:
    pos, size, seen = at + 8, None, False
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        body, stop = pos + 8, pos + 12 + n
        if stop > len(b) or zlib.crc32(b[pos + 4 : body + n]) != struct.unpack_from(">I", b, body + n)[0]:
            return None
        if size is None:
            if name != b"IHDR" or n != 13:
                return None
            size = struct.unpack_from(">II", b, body)
        seen |= name == b"IDAT"
        if name == b"IEND":
            return Media("image/png", at, stop, at, stop, f"width={size[0]},height={size[1]}") if seen and n == 0 else None
        pos = stop
    return None


def _bmp(b: memoryview, at: int) -> Media | None:
    if len(b) - at < 54:
        return None
    total, zero, first, head, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or packed:
        return None
    stride = (width * bits + 31) // 32 * 4
    if first < 14 + head or total != first + stride * abs(height) or at + total > len(b):
        return None
    return Media("image/bmp", at, at + total, at + first, at + total, f"width={width},height={abs(height)},bits={bits}")


def _gif(b: memoryview, at: int) -> Media | None:
    def blocks(pos: int) -> int:
        while pos < len(b):
            if b[pos] == 0:
                return pos + 1
            pos += 1 + b[pos]
        return -1

    if len(b) - at < 14 or bytes(b[at + 3 : at + 6]) not in (b"87a", b"89a"):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    pos, frames = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), 0
    while 0 < pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return Media("image/gif", at, pos + 1, at, pos + 1, f"width={width},height={height},frames={frames}") if frames else None
        if mark == 0x21:
            pos = blocks(pos + 2)
        elif mark == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos = blocks(pos + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
            frames += 1
        else:
            return None
    return None


def _jpeg(b: memoryview, at: int) -> Media | None:
    pos, size = at + 2, None
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if mark in (0xD8, 0x00) or n < 2 or pos + 2 + n > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and n >= 8:
            size = struct.unpack_from(">HH", b, pos + 5)
        pos += 2 + n
        if mark == 0xDA:
            raw = bytes(b[pos:])
            cut = 0
            while (cut := raw.find(b"\xff", cut)) >= 0 and cut + 1 < len(raw):
                follow = raw[cut + 1]
                if follow == 0xD9:
                    return Media("image/jpeg", at, pos + cut + 2, at, pos + cut + 2, f"width={size[1]},height={size[0]}") if size else None
                if follow and not 0xD0 <= follow <= 0xD7:
                    break
                cut += 2
            if cut < 0 or cut + 1 >= len(raw):
                return None
            pos += cut
    return None


def _au(b: memoryview, at: int) -> Media | None:
    if len(b) - at < 24:
        return None
    first, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    width = {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 8, 27: 1}.get(coding)
    if first < 24 or width is None or not rate or not 0 < channels <= 64 or not size or size % (width * channels) or at + first + size > len(b):
        return None
    return Media("audio/basic", at, at + first + size, at + first, at + first + size, f"channels={channels},rate={rate},bits={8 * width}")


def _gzip(b: memoryview, at: int) -> Media | None:
    if len(b) - at < 18 or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    unpack, pos = zlib.decompressobj(31), at
    try:
        while not unpack.eof and pos < len(b):
            unpack.decompress(b[pos : pos + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            pos += 65536
    except zlib.error:
        return None
    end = min(pos, len(b)) - len(unpack.unused_data)
    return Media("application/gzip", at, end, at, end, "") if unpack.eof else None


#: Magic bytes of each format and its validator.
FORMATS: list[tuple[bytes, Callable[[memoryview, int], Media | None]]] = [
    (b"RIFF", _wav),
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"BM", _bmp),
    (b"GIF8", _gif),
    (b"\xff\xd8\xff", _jpeg),
    (b"\x1f\x8b", _gzip),
    (b".snd", _au),
]

_automaton: list = []


def _magic() -> ahocorasick.Automaton:
    if not _automaton:
        built = ahocorasick.Automaton()
        for magic, check in FORMATS:
            built.add_word(magic.decode("latin-1"), (len(magic), check))
        built.make_automaton()
        _automaton.append(built)
    return _automaton[0]


def sniff(stored: bytes) -> list[Media]:
    """All confirmed media in order of offset, none inside another."""
    found: list[Media] = []
    view, free = memoryview(stored), 0
    for last, (width, check) in _magic().iter(stored.decode("latin-1")):
        at = last - width + 1
        if at >= free and (media := check(view, at)) is not None:
            found.append(media)
            free = media.end
    return found


MEDIA = "array<struct<kind:string,start:long,end:long,data_start:long,data_end:long,detail:string>>"


def sniff_column(df: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, kind, corrected, media): types found in a binary column.

    ``kind`` is the type confirmed at offset zero, else null; ``corrected``
    says that it differs from the declared type.  ``media`` lists all
    confirmed media with their byte ranges, for carving.  Null and empty
    bytes hold no media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw, declared in zip(*(c.to_pylist() for c in batch.columns)):
                media = sniff(raw or b"")
                kind = media[0].kind if media and media[0].start == 0 else None
                rows.append({"key": key, "declared": declared, "kind": kind, "corrected": kind is not None and kind != declared, "media": [vars(m) for m in media]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data_start", pa.int64()), ("data_end", pa.int64()), ("detail", pa.string())])
    arrow = pa.schema([("key", pa.int64()), ("declared", pa.string()), ("kind", pa.string()), ("corrected", pa.bool_()), ("media", pa.list_(one))])
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    source = df.select(F.col(id_col).cast("long").alias("key"), F.col(bytes_col).cast("binary").alias("raw"), declared.alias("declared"))
    return source.mapInArrow(run, f"key long, declared string, kind string, corrected boolean, media {MEDIA}").withColumnRenamed("key", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "audio/wav") -> DataFrame:
    """Store each whole text as 8-bit samples and describe what is read back.

    (id, n_bytes, declared, kind, media, payload, samples, embedded): ``media``
    is the stored file, in the format that ``stored_form`` gives; ``declared``
    is the one type that the whole column is said to have and ``kind`` the
    type that is found; ``payload`` is what a reader that only trusts sniffing
    gets back; ``samples`` are statistics of it; ``embedded`` counts the
    media carved out of the payload itself.  A null text is empty; its
    payload is one row of blanks.  A text of 4 GiB or more, which no format
    here can hold, raises ``struct.error``; Spark strings end at 2 GiB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for key, text in zip(keys[lo : lo + 256].to_pylist(), texts[lo : lo + 256].to_pylist()):
                    raw = (text or "").encode()
                    stored = stored_form(pad(raw))
                    found = sniff(stored)
                    if not found or found[0].start or found[0].end != len(stored):
                        raise ValueError(f"stored media of row {key} are not confirmed")
                    first = found[0]
                    back = stored[first.data_start : first.data_end]
                    values = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                    mean = float(values @ np.arange(256)) / len(back)
                    rows.append(
                        {
                            "key": key,
                            "n_bytes": len(raw),
                            "declared": declared,
                            "kind": first.kind,
                            "media": stored,
                            "payload": back,
                            "embedded": len(sniff(back)),
                            "samples": f"{first.detail},n={len(back)},mean={mean:.6f},peak={int(np.flatnonzero(values)[-1])},distinct={int((values > 0).sum())}",
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("kind", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("samples", pa.string()), ("embedded", pa.int64())])
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "key long, n_bytes long, declared string, kind string, media binary, payload binary, samples string, embedded long").withColumnRenamed("key", id_col)
