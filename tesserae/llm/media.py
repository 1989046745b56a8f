"""Media columns: ISO media files (nested boxes) as a binary column, and their features without decoding a payload.

`wrap_media` stores bytes losslessly as the 8-bit samples of one `raw ` audio track; `inspect_media` walks the boxes of any
such file, decodes the sample tables and gives codec, duration and the byte ranges of key frames; `payload_of` joins the
samples' bytes. Each row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, slices, unpacked

#: Bytes of a sample, samples from one key frame to the next, and samples a second of 8-bit sound.
SAMPLE, KEY_EVERY, RATE = 192, 8, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
FEATURES = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>, tracks array<struct<codec:string,timescale:long,duration:long,n_samples:long,n_keyframes:long>>, error string"
#: What a damaged file, or one that isn't a media file, fails with.
DAMAGED = (ValueError, KeyError, IndexError, OverflowError, struct.error)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def padded(text: bytes) -> bytes:
    """With blanks up to a positive multiple of SAMPLE."""
    return text + b" " * (-len(text) % SAMPLE if text else SAMPLE)


def wrap(payload: bytes) -> bytes:
    """A file of one track: ftyp, moov with the sample tables, mdat with the payload. The payload is whole samples."""
    n = len(payload) // SAMPLE
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    full = lambda kind, *parts: box(kind, b"\0\0\0\0", *parts)  # noqa: E731  version and flags

    def moov(at: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        chunk = full(b"co64", struct.pack(">IQ", 1, at)) if at + len(payload) >= 2**32 else full(b"stco", struct.pack(">II", 1, at))
        tables = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)), full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), full(b"stsz", struct.pack(">II", SAMPLE, n)), chunk,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload) & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), box(b"minf", full(b"smhd", bytes(4)), dinf, tables))
        return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, len(payload) & 0xFFFFFFFF), bytes(80)), box(b"trak", full(b"tkhd", bytes(80)), media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = len(kind) + len(moov(0)) + (8 if len(payload) + 8 < 2**32 else 16)
    return b"".join((kind, moov(head), box(b"mdat", payload)))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes side by side."""
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", data[start : start + 8])
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", data[start + 8 : start + 16]), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"the box at {start} has the size {size}")
        yield kind, start + head, start + size
        start += size


def tracks_of(data: memoryview, start: int, end: int) -> list[dict[bytes, tuple[int, int]]]:
    """For each track of moov the bodies of its leaf boxes by kind (the first of each)."""
    return [_leaves(data, a, b) for kind, a, b in boxes(data, start, end) if kind == b"trak"]


def _leaves(data: memoryview, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    found: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in boxes(data, start, end):
        for k, v in (_leaves(data, a, b) if kind in NESTED else {kind: (a, b)}).items():
            found.setdefault(k, v)
    return found


def samples_of(data: memoryview, at: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all samples: stsz has the sizes, stsc the samples of each chunk, stco or co64 the chunks' places."""
    numbers = lambda kind, skip, form: np.frombuffer(data[at[kind][0] + skip : at[kind][1]], form).astype(np.int64)
    size, n = struct.unpack(">II", data[at[b"stsz"][0] + 4 : at[b"stsz"][0] + 12])
    if size and size * n > len(data) or not size and at[b"stsz"][1] - at[b"stsz"][0] < 12 + 4 * n:
        raise ValueError(f"{n} samples are more than the file has")  # before an array of that length is made
    sizes = np.full(n, size, np.int64) if size else numbers(b"stsz", 12, ">u4")[:n]
    chunks = numbers(b"stco", 8, ">u4") if b"stco" in at else numbers(b"co64", 8, ">u8")
    runs = numbers(b"stsc", 8, ">u4").reshape(-1, 3)
    many = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(runs) and runs[0, 0] != 1 or (many < 0).any() or (runs[:, 1] * many).sum() < n or (runs[:, 1] > max(n, 1)).any():
        raise ValueError("the chunks don't hold the samples")
    each = np.repeat(runs[:, 1], many)
    chunk = np.repeat(np.arange(len(chunks)), each)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    offsets = chunks[chunk] + before - before[first[chunk]]
    if n and ((offsets < 0).any() or (offsets + sizes > len(data)).any()):
        raise ValueError("a sample lies outside of the file")
    return offsets, sizes


def _track(data: memoryview, at: dict[bytes, tuple[int, int]]) -> tuple[dict, np.ndarray, np.ndarray]:
    offsets, sizes = samples_of(data, at)
    head = at[b"mdhd"][0]
    timescale = struct.unpack(">I", data[head + 20 : head + 24] if data[head] else data[head + 12 : head + 16])[0]
    times = np.frombuffer(data[at[b"stts"][0] + 8 : at[b"stts"][1]], ">u4").astype(np.int64).reshape(-1, 2)
    if b"stss" in at:
        keys = np.frombuffer(data[at[b"stss"][0] + 8 : at[b"stss"][1]], ">u4").astype(np.int64) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
            raise ValueError("a key frame is no sample")
    else:
        keys = np.arange(len(sizes))  # without the table each sample is one
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    return {"codec": codec, "timescale": timescale, "duration": int((times[:, 0] * times[:, 1]).sum()), "n_samples": len(sizes), "keyframes": [{"offset": int(o), "size": int(s)} for o, s in zip(offsets[keys], sizes[keys], strict=True)]}, offsets, sizes


def inspect(media: bytes | memoryview) -> tuple[dict, np.ndarray, np.ndarray]:
    """Features, and the first track's samples' offsets and sizes. Fails with one of DAMAGED on a damaged file."""
    data = memoryview(media)
    top: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in boxes(data, 0, len(data)):
        top.setdefault(kind, (a, b))
    if b"moof" in top:
        raise ValueError("a fragmented file: its moof boxes are not read")
    tracks = [_track(data, t) for t in tracks_of(data, *top[b"moov"])]
    short = [{**{k: t[k] for k in ("codec", "timescale", "duration", "n_samples")}, "n_keyframes": len(t["keyframes"])} for t, _, _ in tracks]
    first, offsets, sizes = tracks[0]
    return {**first, "tracks": short, "error": None}, offsets, sizes


def wrap_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with the column `media`: the whole text's UTF-8 bytes, blanks up to a positive multiple of SAMPLE, as a file.

    Null or empty text: one sample of blanks. Equal texts make equal files. Repeated rows and an empty table come out as
    such; the column of the new one's name is replaced, others kept. A very long text makes one long file of its own batch.
    """
    rows = packed(docs, _text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([wrap(padded(t)) for t in batch.column("_text").to_pylist()], pa.binary())], names=["_row", "_media"])

    return unpacked(rows.mapInArrow(work, rows.select("_row", F.col("_text").alias("_media")).schema), docs.columns, **{media_col: F.col("_media")})


def inspect_media(table: DataFrame, media_col: str = "media", payload: bool = False) -> DataFrame:
    """table with the columns of FEATURES and, if asked for, `payload` (the samples' bytes, end to end).

    The columns up to keyframes, and the payload, are the first track's; tracks has a row for each. duration counts units of
    1 / timescale seconds. A fragmented file (moof), and one without a track, count as damaged. Null media has null features; for a damaged file they are null too
    but for `error`. Columns of these names are replaced, others kept; repeated rows and empty tables come out as such.
    """
    rows = packed(table, _media=F.col(f"`{media_col}`"))
    fields = [*T._parse_datatype_string(FEATURES).fields, *([T.StructField("payload", T.BinaryType())] if payload else [])]
    schema = T.StructType([rows.schema["_row"], *fields])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64())])), pa.string(), pa.binary()]

    def one(media: pa.Scalar) -> dict:
        if not media.is_valid:
            return {}
        data = memoryview(media.as_buffer())
        try:
            found, offsets, sizes = inspect(data)
        except DAMAGED as e:
            return {"error": f"{type(e).__name__}: {e}"}
        if payload:
            ends = offsets + sizes
            cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1  # samples side by side are taken at once
            found["payload"] = b"".join(data[a:b] for a, b in zip(offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)], strict=True)) if len(offsets) else b""
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_media"):
            found = [one(m) for m in batch.column("_media")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array([x.get(f.name) for x in found], k) for f, k in zip(fields, kinds, strict=False)]], names=["_row", *[f.name for f in fields]])

    made = rows.mapInArrow(work, schema)
    return unpacked(made, table.columns, **{f.name: F.col(f.name) for f in fields})
