"""Token ids as length-delimited binary records in shards, with an offset index.

A shard is a row of frames, each: payload length (8 bytes), masked crc32 of those 8 bytes (4), payload, masked crc32 of
the payload (4), a line feed. A payload is the document's id (8 bytes, signed), the width of its ids in bytes (1), then
the ids. All numbers are little-endian. Spark's text writer writes the frames as they are, so shards go to any file system
that Spark can write and are committed as all its output is: a lost or repeated task leaves no half of a shard.
The index (Parquet) has for each record its shard, offset and size, and how many ids stand before it in its shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, id_key, slices, text_of
from .tokens import PieceEncoder

HEAD, TAIL = 12, 5
#: Bytes of text that a shard holds in the mean; its ids take about as many, well under what one row of a file may have.
SHARD_BYTES = 128 << 20


def masked(crc: int) -> int:
    """Rotated and shifted, so that the checksum of data that holds checksums is no weaker."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc: int, ids: np.ndarray) -> bytes:
    """All but the line feed, which the writer adds."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    payload = struct.pack("<qB", doc, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(zlib.crc32(head))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def unframe(shard: memoryview, offset: int, payload: bool = True) -> tuple[int, int, int, np.ndarray | None]:
    """The record at an offset: its id, number of ids, size in the shard, and the ids. Fails if a checksum is wrong."""
    head = bytes(shard[offset : offset + 8])
    (size,), (crc,) = struct.unpack("<Q", head), struct.unpack("<I", shard[offset + 8 : offset + HEAD])
    if crc != masked(zlib.crc32(head)):
        raise ValueError(f"the length of the record at {offset} is damaged")
    at = offset + HEAD
    doc, width = struct.unpack("<qB", shard[at : at + 9])
    ids = None
    if payload:
        if struct.unpack("<I", shard[at + size : at + size + 4])[0] != masked(zlib.crc32(shard[at : at + size])):
            raise ValueError(f"the record at {offset} is damaged")
        ids = np.frombuffer(shard[at + 9 : at + size], f"<u{width}").astype("<u4")
    return doc, (size - 9) // width, HEAD + size + TAIL, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes path/shards and path/index: each whole text encoded, with end_id after it, in ascending order of ids.

    Null text is empty: a record of end_id alone. A null id counts as the smallest long. Rows of one id stand in the order
    of their texts; repeated rows make repeated records. An empty table makes an index without rows. Other columns are
    not read, so any names do. The ids are dealt by ranges, as many as `shards` says or else one for each SHARD_BYTES of text, at least spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    dealt = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in slices(batches, "text", 8 << 20):
            out = encoder.encode(batch.column("text"))
            frames = [frame(doc, np.append(out.flat[a:b], np.uint32(end_id))) for doc, a, b in zip(batch.column("id").to_pylist(), out.bounds[:-1], out.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    dealt.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(f"{path}/shards")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, content = batch.column("shard")[i].as_py(), memoryview(batch.column("content")[i].as_buffer())
                found = []
                for r in _all(content):
                    doc, count, size, _ = unframe(content, r["offset"], payload=False)
                    found.append((shard, doc, r["offset"], size, r["before"], count))
                columns = [np.array(c, np.int64) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "id", "offset", "size", "before", "n_tokens"])

    shards_of(spark, path).mapInArrow(index, "shard long, id long, offset long, size long, before long, n_tokens long").write.parquet(f"{path}/index")


def shards_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): a row for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def read_tokens(spark: SparkSession, path: str, picks: DataFrame | None = None) -> DataFrame:
    """(id, start, n_tokens, ids): ids as little-endian 32-bit integers, start the number of ids before the record in all
    shards. picks (rows of the index, in any subset) limits it to those records, found by their offsets."""
    places = spark.read.parquet(f"{path}/index")
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    files = shards_of(spark, path).join(F.broadcast(base), "shard")  # 16 bytes for each file
    if picks is None:
        files = files.select("content", "base", F.lit(None).cast("array<struct<offset:long,before:long>>").alias("records"))
    else:
        lists = picks.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("offset", "before"))).alias("records"))
        files = files.join(lists, "shard").select("content", "base", "records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content, before = memoryview(batch.column("content")[i].as_buffer()), batch.column("base")[i].as_py()
                picked = batch.column("records")[i].as_py()
                todo = iter(picked) if picked is not None else _all(content)
                out: list[tuple] = []
                for r in todo:
                    doc, count, _, ids = unframe(content, r["offset"])
                    out.append((doc, before + r["before"], count, ids.tobytes()))
                    if len(out) == 1024:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return files.mapInArrow(read, "id long, start long, n_tokens long, ids binary").select(id_back("id").alias("id"), "start", "n_tokens", "ids")


def _all(content: memoryview) -> Iterator[dict]:
    at, before = 0, 0
    while at < len(content):
        _, count, size, _ = unframe(content, at, payload=False)
        yield {"offset": at, "before": before}
        at, before = at + size, before + count


def _rows(out: list[tuple]) -> pa.RecordBatch:
    doc, start, count, ids = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])
