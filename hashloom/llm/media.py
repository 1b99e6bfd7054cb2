"""Media columns: ISO base media containers (MP4 boxes) written and read without any codec.

`mux` stores a payload as raw 8-bit samples of one track; `walk` yields nested boxes; `describe` decodes the sample tables (stts, stsc, stsz,
stco or co64, stss) into codec, duration and the byte ranges of keyframes without touching the payload; `payload` reads the samples back.

Odd input: a null text is an empty one; an empty payload is padded to one sample; broken or foreign bytes have null features; boxes of
64-bit size, of size 0 (to the end) and of unknown type are handled; repeated rows and null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import id_and_text

#: A sample is a grey 24 x 24 frame of 8-bit units; ticks a second; samples of a chunk; every so many samples a keyframe.
SIDE, SAMPLE, RATE, CHUNK, KEY = 24, 576, 25, 8, 12
#: Levels of nested boxes that are walked; samples of a track that are described at most in relation to the bytes at hand (a sample of no
#: bytes has none of its own, so a header of a few bytes could claim billions).
DEPTH = 32
#: Box types that hold boxes.
HOLDERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"})


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """Container of a payload whose size is a positive multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError(f"payload of {len(payload)} bytes isn't a positive multiple of {SAMPLE}")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    keys = range(1, n + 1, KEY)

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        at = [first + k * CHUNK * SAMPLE for k in range(chunks + bool(rest))]
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, 1)),
            _full(b"stss", struct.pack(f">{len(keys) + 1}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", c, m, 1) for c, m in runs)),
            _full(b"stsz", struct.pack(">2I", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *at)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">4IIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    first = len(ftyp) + size + head
    if len(moov(first)) != size:  # wide offsets
        first = len(ftyp) + len(moov(1 << 32)) + head
    return ftyp + moov(first) + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of the body, end) of each box, holders before what they hold; nothing beyond a holder's end is read. Boxes nested deeper
    than DEPTH are passed over as a whole."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        at, end, path = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                continue
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if at + size > end or at + size < body:
            continue
        yield (*path, kind), body, at + size
        open_.append((at + size, end, path))
        if kind in HOLDERS and len(path) < DEPTH:
            open_.append((body, at + size, (*path, kind)))


@dataclass
class Track:
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    offset: np.ndarray
    size: np.ndarray
    time: np.ndarray
    key: np.ndarray

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (offset, size) of the keyframes."""
        k = self.key
        return list(zip(self.offset[k].tolist(), self.size[k].tolist()))


def _table(data: bytes, body: tuple[int, int], columns: int, wide: bool = False) -> np.ndarray:
    n = struct.unpack_from(">I", data, body[0] + 4)[0]
    if body[0] + 8 + n * columns * (8 if wide else 4) > body[1]:
        raise ValueError("a table reaches beyond its box")
    return np.frombuffer(data, ">u8" if wide else ">u4", n * columns, body[0] + 8).astype(np.int64).reshape(-1, columns)


def tracks(data: bytes) -> list[Track]:
    """Tracks of a container from its boxes; a track without full sample tables is left out. Raises ValueError for tables that contradict
    each other or the size of the file."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, body, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (body, end))
    return [_track(data, t) for t in found if {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} <= t.keys() and {b"stco", b"co64"} & t.keys()]


def _track(data: bytes, t: dict[bytes, tuple[int, int]]) -> Track:
    at = t[b"mdhd"][0]
    if data[at] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, at + 20)
    else:
        timescale, duration = struct.unpack_from(">II", data, at + 12)
    entry = t[b"stsd"][0] + 8
    codec = data[entry + 4 : entry + 8].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, entry + 32) if t.get(b"vmhd") else (0, 0)
    sizes, end = t[b"stsz"]
    same, n = struct.unpack_from(">II", data, sizes + 4)
    if n * (same or 4) > len(data) or (not same and sizes + 12 + 4 * n > end):
        raise ValueError("more samples than the file can hold")
    size = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, sizes + 12).astype(np.int64)
    chunk = _table(data, t[b"stco"], 1)[:, 0] if b"stco" in t else _table(data, t[b"co64"], 1, True)[:, 0]
    runs = _table(data, t[b"stsc"], 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > max(len(chunk), 1)):
        raise ValueError("runs of chunks aren't in order")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1))) if len(runs) else np.zeros(len(chunk), np.int64)
    begins = np.cumsum(per) - per
    if int(per.sum()) != n:
        raise ValueError("chunks and sizes disagree on the number of samples")
    of = np.repeat(np.arange(len(chunk)), per)
    before = np.cumsum(size) - size
    offset = chunk[of] + before - before[begins[of]] if n else np.zeros(0, np.int64)
    steps = _table(data, t[b"stts"], 2)
    if int(steps[:, 0].sum()) != n:
        raise ValueError("times and sizes disagree on the number of samples")
    delta = np.repeat(steps[:, 1], steps[:, 0])
    key = _table(data, t[b"stss"], 1)[:, 0] - 1 if b"stss" in t else np.arange(n)
    if n and ((offset < 0) | (offset + size > len(data))).any() or len(key) and (key.min() < 0 or key.max() >= n):
        raise ValueError("a sample lies outside the file")
    return Track(codec, width, height, timescale, duration, offset, size, np.cumsum(delta) - delta, key)


def payload(data: bytes) -> bytes:
    """The samples of the first track, read by its tables."""
    return samples(data, tracks(data)[0])


def samples(data: bytes, t: Track) -> bytes:
    joint = t.offset[1:] == (t.offset + t.size)[:-1]
    start = np.flatnonzero(np.append(True, ~joint))
    stop = np.append(start[1:], len(t.offset)) - 1
    return b"".join(data[t.offset[a] : t.offset[b] + t.size[b]] for a, b in zip(start, stop))


#: What broken or foreign bytes raise on the way.
BROKEN = (IndexError, struct.error, ValueError, OverflowError, MemoryError)


def described(t: Track) -> dict:
    """Codec, duration and keyframes' byte ranges of a track, from its tables alone."""
    return {"codec": t.codec, "duration_s": t.duration / t.timescale if t.timescale else None, "samples": len(t.size), "keyframes": [{"offset": a, "size": b} for a, b in t.keyframes()]}


def describe(data: bytes) -> dict:
    """Features of the first track, from the boxes alone; nulls for broken or foreign bytes."""
    try:
        return described(tracks(data)[0])
    except BROKEN:
        return dict.fromkeys(("codec", "duration_s", "samples", "keyframes"))


def containers(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, padded with bytes 255 and stored in a container."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                raw = [t.encode() for t in part["text"]]
                media = [mux(r.ljust(max(1, -(-len(r) // SAMPLE)) * SAMPLE, b"\xff")) for r in raw]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(r) for r in raw], "media": media})

    return id_and_text(docs).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests of stored containers and what is read back from them; no codec is run. media: doc_id, n_bytes, media. A null container has
    nulls, one of broken or foreign bytes its own size and digest alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc_id, n, *_row(data)) for doc_id, n, data in zip(pdf["doc_id"].astype("Int64"), pdf["n_bytes"].astype("Int64"), pdf["media"])]
            yield pd.DataFrame(rows, columns=COLUMNS).astype(dict.fromkeys(("doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes"), "Int64"))

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInPandas(run, SCHEMA)


def _row(data) -> tuple:
    if data is None:
        return (None,) * (len(COLUMNS) - 2)
    data = bytes(data)
    own = len(data), hashlib.sha256(data).hexdigest()
    try:
        t = tracks(data)[0]
        back, d = samples(data, t), described(t)
    except BROKEN:
        return None, None, None, *own, None, None, None, None
    crc = zlib.crc32(b"".join(b"%d:%d;" % (k["offset"], k["size"]) for k in d["keyframes"]))
    seconds = "unknown" if d["duration_s"] is None else f"{d['duration_s']:.2f}"
    feature = f"codec={d['codec'].strip()};duration={seconds};samples={d['samples']};keyframes={len(d['keyframes'])};ranges={crc:08x}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), *own, feature, d["codec"], d["duration_s"], d["keyframes"]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,size:long>>"
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
