"""ISO media containers (ISO/IEC 14496-12) as a binary column.

``mux`` stores a payload as 8-bit PCM samples of one audio track: ``ftyp``, ``moov`` with its nested boxes, and ``mdat``.
``probe`` walks the nested boxes and decodes each track's own sample tables (``stsd``, ``stts``, ``stsc``, ``stsz``,
``stco``/``co64``, ``stss``) to codec, duration and the byte ranges of the keyframes, never touching the payload.
``sample_bytes`` follows the same tables to the sample bytes.

Defined cases: a null or empty payload is stored as 192 spaces; a column that is no container, is cut short or is
fragmented, or whose tables disagree, gets ``error`` and nulls elsewhere; box sizes may be 32-bit, 64-bit or "to the end"; unknown boxes are
skipped; a track without ``stss`` has only keyframes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Bytes of a sample, ticks of the track's clock in a second, samples in a chunk, and samples from keyframe to keyframe.
UNIT, TIMESCALE, CHUNK_SAMPLES, KEY_EVERY = 192, 19_200, 16, 25
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def described(t: dict) -> dict:
    """A track as ``probe`` returns it."""
    keyframes = [{"offset": a, "size": b} for a, b in zip(t["offsets"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist())]
    return {**{c: t[c] for c in ("number", "handler", "codec")}, "duration_s": t["ticks"] / t["timescale"] if t["timescale"] else None, "samples": len(t["sizes"]), "keyframes": keyframes}


def padded(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return payload + b" " * ((-len(payload)) % UNIT if payload else UNIT)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux_bytes(payload: bytes) -> bytes:
    """A container whose one track holds ``payload`` (whole units) as samples of one unit each."""
    n, ticks = len(payload) // UNIT, len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    runs = ([(1, CHUNK_SAMPLES, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    starts = np.arange(chunks + bool(rest), dtype="u8") * (CHUNK_SAMPLES * UNIT)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16 & 0xFFFFFFFF))
    wide = ticks >= 1 << 32

    def moov(at: int) -> bytes:
        offsets = starts + at
        big = wide or int(offsets[-1]) >= 1 << 32
        table = full(b"co64" if big else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if big else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        length = struct.pack(">Q" if wide else ">I", ticks)
        times = bytes(16 if wide else 8)
        mdhd = full(b"mdhd", times, struct.pack(">I", TIMESCALE), length, struct.pack(">HH", 0x55C4, 0), version=int(wide))
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = full(b"tkhd", times, struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=int(wide), flags=7)
        mvhd = full(b"mvhd", times, struct.pack(">I", TIMESCALE), length, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=int(wide))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of the body, end) of every box, in file order, walking into those that hold boxes."""
    if depth > 16:
        raise ValueError("boxes too deep")
    while start < end:
        if end - start < 8:
            raise ValueError("cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("box beyond its parent")
        yield (kind,), start + head, start + size
        if kind in NESTED:
            for path, a, b in boxes(data, start + head, start + size, depth + 1):
                yield (kind, *path), a, b
        start += size


def tracks(media: bytes) -> list[dict]:
    """Of each track: number, handler, codec, clock and sample table (``offsets`` and ``sizes`` of all samples, ``keys`` their indices)."""
    data = memoryview(media)
    found: list[dict[bytes, tuple[int, int]]] = []
    kinds = set()
    for path, a, b in boxes(data, 0, len(data)):
        kinds.add(path[0])
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (a, b))
    if b"moof" in kinds:
        raise ValueError("fragmented")
    if not found:
        raise ValueError("no track")
    return [_track(data, x) for x in found]


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> dict:
    """One track from its own boxes. Counts are held against the boxes' sizes before anything is made of them."""

    def body(kind: bytes, least: int = 8) -> tuple[int, int]:
        if kind not in found:
            raise ValueError(f"no {kind.decode('latin-1')} in a track")
        a, b = found[kind]
        if b - a < least:
            raise ValueError("table cut short")
        return a, b

    def ints(kind: bytes, each: int = 1, skip: int = 4, form: str = ">u4") -> np.ndarray:
        a, b = body(kind, skip + 4)
        n = struct.unpack_from(">I", data, a + skip)[0] * each
        if skip + 4 + n * int(form[-1]) > b - a:
            raise ValueError("table cut short")
        return np.frombuffer(data, form, n, a + skip + 4).astype(np.int64)

    a, _ = body(b"mdhd", 20)
    scale, ticks = struct.unpack_from(">IQ", data, body(b"mdhd", 32)[0] + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, _ = body(b"stsd", 16)
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
    number = handler = None
    if b"tkhd" in found:
        a, _ = body(b"tkhd", 24)
        number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    if b"hdlr" in found:
        a, _ = body(b"hdlr", 12)
        handler = bytes(data[a + 8 : a + 12]).decode("latin-1").strip()
    a, _ = body(b"stsz", 12)
    uniform, n = struct.unpack_from(">II", data, a + 4)
    if uniform and n * uniform > len(data):
        raise ValueError("samples beyond the end")
    sizes = np.full(n, uniform, np.int64) if uniform else ints(b"stsz", skip=8)
    chunks = ints(b"co64", form=">u8") if b"co64" in found else ints(b"stco")
    if len(chunks) and (chunks.min() < 0 or chunks.max() > len(data)):  # before anything is added to them
        raise ValueError("samples beyond the end")
    runs = ints(b"stsc", 3).reshape(-1, 3)
    first = runs[:, 0]
    if len(runs) and (first[0] != 1 or first[-1] > len(chunks) or (np.diff(first) <= 0).any()) or (len(chunks) and not len(runs)):
        raise ValueError("sample tables disagree")
    times = np.diff(np.append(first, len(chunks) + 1))
    if int((times * runs[:, 1]).sum()) != n:
        raise ValueError("sample tables disagree")
    per = np.repeat(runs[:, 1], times)
    start = np.repeat(np.cumsum(per) - per, per)
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks, per) + before - (before[start] if n else before)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples beyond the end")
    stts = ints(b"stts", 2).reshape(-1, 2)
    table_ticks = int((stts[:, 0] * stts[:, 1]).sum())
    if int(stts[:, 0].sum()) != n or ticks not in (0, 2**32 - 1, 2**64 - 1, table_ticks):
        raise ValueError("sample tables disagree")
    keys = ints(b"stss") - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys[0] < 0 or keys[-1] >= n or (np.diff(keys) <= 0).any()):
        raise ValueError("sample tables disagree")
    return {"number": number, "handler": handler, "codec": codec, "timescale": scale, "ticks": ticks, "table_ticks": table_ticks, "offsets": offsets, "sizes": sizes, "keys": keys}


def sample_bytes(media: bytes, t: dict) -> bytes:
    """All samples of a track in decoding order; samples that follow one another are read as one range."""
    if not len(t["offsets"]):
        return b""
    cut = np.flatnonzero(t["offsets"][1:] != (t["offsets"] + t["sizes"])[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(t["offsets"])) - 1
    return b"".join(media[a:b] for a, b in zip(t["offsets"][first].tolist(), (t["offsets"] + t["sizes"])[last].tolist()))


def mux(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text, padded with spaces to whole units, as a media column."""

    def work(columns, texts):
        return {"id": columns["id"], "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "media": pa.array([mux_bytes(padded(x)) for x in texts], pa.binary())}

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return map_texts(docs, work, f"id {kind}, n_bytes bigint, media binary", text_col=text_col, keep={"id": id_col}).withColumnRenamed("id", id_col)


KEYFRAMES = "array<struct<offset:bigint,size:bigint>>"
TRACKS = f"array<struct<number:bigint,handler:string,codec:string,duration_s:double,samples:bigint,keyframes:{KEYFRAMES}>>"
PROBED = f"tracks {TRACKS}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, error string"


def probe(media: DataFrame, *, keep: list[str], media_col: str = "media", read: bool = False) -> DataFrame:
    """``keep`` columns with ``tracks``: number, handler, codec, duration, number of samples and keyframe ranges of each.

    With ``read`` also digests of the first track's samples, read back by its tables.
    """

    def one(m: bytes | None) -> dict:
        try:
            if m is None:
                raise ValueError("null")
            found = tracks(m)
        except (ValueError, IndexError, struct.error) as wrong:
            return {"error": str(wrong) or type(wrong).__name__}
        out = {"tracks": [described(t) for t in found]}
        if read:
            payload = sample_bytes(m, found[0])
            out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
        return out

    fields = ["tracks", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
    keyframes = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    track = pa.struct([("number", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", keyframes)])
    kinds = {"tracks": pa.list_(track), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
    base = media.select(*keep, F.col(media_col).alias("__media"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [one(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *(pa.array([r.get(f) for r in rows], kinds.get(f, pa.string())) for f in fields)], names=[*keep, *fields])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}, {PROBED}")
