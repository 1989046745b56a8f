"""Volumes as Zarr (version 3) arrays and as NPY planes: each chunk or plane is a file that one task writes or reads.

Files are listed and read by Spark, so any file system that it knows will do; they are written through pyarrow's file systems under
a name of their own and then moved, so a task that is lost and run again leaves whole files only. An array is a folder
`img=<n>/<level>` with zarr.json beside its chunks `c/z/y/x`; a group's zarr.json lists its levels as OME multiscales.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: Zarr's names of element types, and numpy's.
TYPES = {"float64": "<f8", "float32": "<f4", "int64": "<i8", "int32": "<i4", "uint32": "<u4", "int16": "<i2", "uint16": "<u2", "int8": "<i1", "uint8": "<u1", "bool": "?"}


def put(path: str, content: bytes) -> None:
    """The file, whole or not at all."""
    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:", "", path))
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(content)
    system.move(own, place)


def array_metadata(shape: list[int], chunks: list[int], dtype: str, fill: float = 0) -> dict:
    return {
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "fill_value": fill, "dimension_names": list(AXES), "attributes": {},
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 5}}],
    }


def group_metadata(levels: int, factor: int = 2) -> dict:
    sets = [{"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [float(factor**i)] * 3}]} for i in range(levels)]
    return {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [{"axes": [{"name": a, "type": "space"} for a in AXES], "datasets": sets}]}}}


def encode(chunk: np.ndarray, meta: dict) -> bytes:
    raw = np.ascontiguousarray(chunk.astype(TYPES[meta["data_type"]])).tobytes()
    for codec in meta["codecs"][1:]:
        raw = gzip.compress(raw, codec["configuration"]["level"], mtime=0) if codec["name"] == "gzip" else _unknown(codec)
    return raw


def decode(raw: bytes, meta: dict) -> np.ndarray:
    for codec in meta["codecs"][:0:-1]:
        if codec["name"] == "gzip":
            raw = gzip.decompress(raw)
        elif codec["name"] == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif codec["name"] == "crc32c":
            raw = raw[:-4]
        else:
            _unknown(codec)
    first = meta["codecs"][0]
    if first["name"] != "bytes":
        _unknown(first)
    kind = TYPES[meta["data_type"]]
    if first.get("configuration", {}).get("endian") == "big":
        kind = kind.replace("<", ">")
    return np.frombuffer(raw, kind).reshape(meta["chunk_grid"]["configuration"]["chunk_shape"])


def _unknown(codec: dict) -> bytes:
    raise ValueError(f"the codec {codec['name']} is not known")


def write_zarr(vol: DataFrame, path: str, level: int = 0, levels: int = 1, chunks: tuple[int, int, int] = (32, 32, 32), dtype: str = "float64", column: str = "v") -> None:
    """Writes the volumes (img, z, y, x, v; coordinates from 0) to path/img=<n>/<level>. An image's shape is that of its cells' box
    from the origin; cells that aren't there are 0; chunks without cells are no files. An empty volume writes nothing."""
    ends = vol.groupBy("img").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    size = list(chunks)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                put(f"{path}/img={r['img']}/{level}/zarr.json", json.dumps(array_metadata([r[f"n{a}"] for a in AXES], size, dtype)).encode())
                put(f"{path}/img={r['img']}/zarr.json", json.dumps(group_metadata(levels)).encode())
            yield batch.select(["img"])

    def chunk(key: tuple, table: pa.Table) -> pa.Table:
        img, *at = (k.as_py() for k in key)
        block = np.zeros(size)
        block[tuple(np.asarray(table.column(a)) - b * n for a, b, n in zip(AXES, at, size, strict=True))] = np.asarray(table.column(column))
        put(f"{path}/img={img}/{level}/c/{'/'.join(map(str, at))}", encode(block, array_metadata([], size, dtype)))
        return pa.table({"img": pa.array([img], pa.int32())})

    ends.mapInArrow(documents, "img int").write.format("noop").mode("overwrite").save()
    dealt = vol.select("img", *AXES, column, *[F.floor(F.col(a) / n).alias(f"c{a}") for a, n in zip(AXES, size, strict=True)])
    dealt.groupBy("img", "cz", "cy", "cx").applyInArrow(chunk, "img int").write.format("noop").mode("overwrite").save()


def read_zarr(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """(img, z, y, x, v double): all cells of the level's arrays; those of chunks that have no file are the fill value."""
    files = lambda glob: spark.read.format("binaryFile").load(f"{path}/img=*/{level}/{glob}").select(F.regexp_extract("path", r"img=(\d+)/", 1).cast("int").alias("img"), "path", "content")
    metas = files("zarr.json").select("img", F.col("content").cast("string").alias("meta"))
    counts = [F.ceil(F.get_json_object("meta", f"$.shape[{i}]").cast("int") / F.get_json_object("meta", f"$.chunk_grid.configuration.chunk_shape[{i}]").cast("int")) for i in range(3)]
    every = metas
    for a, n in zip(AXES, counts, strict=True):
        every = every.withColumn(f"c{a}", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    found = files("c/*/*/*")
    found = found.select("img", *[F.regexp_extract("path", r"/c/(\d+)/(\d+)/(\d+)$", i + 1).cast("int").alias(f"c{a}") for i, a in enumerate(AXES)], "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                meta = json.loads(batch.column("meta")[i].as_py())
                size, raw = meta["chunk_grid"]["configuration"]["chunk_shape"], batch.column("content")[i].as_py()
                block = decode(raw, meta) if raw is not None else np.full(size, meta["fill_value"], TYPES[meta["data_type"]])
                at = [batch.column(f"c{a}")[i].as_py() * n for a, n in zip(AXES, size, strict=True)]
                block = block[tuple(slice(0, n - a) for n, a in zip(meta["shape"], at, strict=True))]
                grid = np.indices(block.shape).reshape(3, -1) + np.array(at)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(block.size, batch.column("img")[i].as_py()), pa.int32()), *[pa.array(g, pa.int32()) for g in grid], pa.array(block.reshape(-1).astype(float))], names=["img", *AXES, "v"])

    keys = ["img", "cz", "cy", "cx"]
    return every.join(found, keys, "left").select(*keys, "meta", "content").mapInArrow(cells, "img int, z int, y int, x int, v double")


def write_npy(vol: DataFrame, path: str, column: str = "v") -> None:
    """Each plane (img, z) as path/img=<n>/z=<n>.npy, of the box of its cells from the origin; a plane is what one task holds."""

    def plane(key: tuple, table: pa.Table) -> pa.Table:
        y, x = (np.asarray(table.column(a)) for a in ("y", "x"))
        out, whole = io.BytesIO(), np.zeros((y.max() + 1, x.max() + 1))
        whole[y, x] = np.asarray(table.column(column))
        np.save(out, whole)
        put(f"{path}/img={key[0].as_py()}/z={key[1].as_py()}.npy", out.getvalue())
        return pa.table({"img": pa.array([key[0].as_py()], pa.int32())})

    vol.select("img", *AXES, column).groupBy("img", "z").applyInArrow(plane, "img int").write.format("noop").mode("overwrite").save()


def read_npy(spark: SparkSession, path: str, selected: str = "*") -> DataFrame:
    """(img, z, y, x, v double) of the planes that `write_npy` wrote, or of a time-lapse stored so, whose frames are z; `selected`
    is a glob of planes."""
    files = spark.read.format("binaryFile").load(f"{path}/img=*/z={selected}.npy")
    files = files.select(F.regexp_extract("path", r"img=(\d+)/", 1).cast("int").alias("img"), F.regexp_extract("path", r"z=(\d+)\.npy", 1).cast("int").alias("z"), "content")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                plane = np.load(io.BytesIO(batch.column("content")[i].as_py()), allow_pickle=False)
                y, x = np.indices(plane.shape).reshape(2, -1)
                one = lambda c, n=plane.size: pa.array(np.full(n, batch.column(c)[i].as_py()), pa.int32())  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([one("img"), one("z"), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(plane.reshape(-1).astype(float))], names=["img", *AXES, "v"])

    return files.mapInArrow(cells, "img int, z int, y int, x int, v double")
