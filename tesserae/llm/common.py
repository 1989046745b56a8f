"""What the text operators share: row keys, the shared folder and slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored  # noqa: F401

#: A null id takes part as the smallest long.
NULL_ID = -(2**63)
#: Bytes of text that a task works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def id_key(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    """The id that a key stands for."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def packed(df: DataFrame, without: str | None = None, **columns: Column) -> DataFrame:
    """The row as struct `_row` beside the named columns, so that no input column can clash with them; `without` is a
    column that the result replaces, and that needn't be moved twice."""
    mark, names = "_is", {c.lower() for c in df.columns}
    while mark in names:
        mark += "_"
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != without], F.lit(True).alias(mark)).alias("_row")
    return df.select(row, *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns again, with the new ones in place of those of the same name or after them."""
    old = [(new.get(c, F.col(f"_row.`{c}`"))).alias(c) for c in columns]
    return df.select(*old, *[v.alias(n) for n, v in new.items() if n not in columns])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of whole rows whose texts take at most `limit` bytes, or of one row. After the last one the worker
    gives back what it has freed, as it stays for later stages, beside whose own memory that would count."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Freed memory of Arrow and of the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 offsets of the texts in them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of ragged runs: starts[0], starts[0] + 1, ..., starts[1], ..."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
