"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes before each place where a piece may start picks the chunk bounds, so texts that share a
passage share its chunks wherever it stands. Each different chunk is encoded once by a worker, which remembers the ids of the
chunks and pieces that it saw last, over all its texts and tasks, in a bounded number of bytes. Then every join of two chunks
is checked: the piece before and the piece after it are encoded together by the tokenizer; where that differs from what both
give alone, the chunks are joined and encoded anew, until all joins agree. All work is within a task: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, spread, unpacked, utf8
from .tokens import PieceEncoder, Ragged, binary, piece_cuts, strings
from .words import mix

#: Bytes that the rolling hash sees, and pieces in a chunk in the mean (a power of two).
WINDOW, CHUNK = 16, 64
#: Bytes of text that a task encodes at a time.
TEXT_BYTES = 2 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunk_bounds(data: np.ndarray, bounds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices into the piece bounds at which chunks start, and the end. A text's start is one, and a piece where the
    rolling hash of the WINDOW bytes before it has log2(CHUNK) zero bits on top."""
    at = bounds[:-1]
    seen = np.zeros(len(at), np.uint64)
    for back in range(min(WINDOW, len(data)), 0, -1):
        seen = (seen << np.uint64(1)) + _GEAR[data[np.maximum(at - back, 0)]]
    top = np.uint64(64 - (CHUNK.bit_length() - 1))
    cut = np.zeros(len(bounds), bool)
    cut[:-1] = (mix(seen) >> top == 0) & (data[at - 1] != 0x0A)  # a line feed's piece stays with what follows
    cut[np.searchsorted(bounds, offsets)] = True
    cut[-1] = True
    return np.flatnonzero(cut)


def encode_column(encoder: PieceEncoder, column: pa.Array) -> Ragged:
    """The ids of each text."""
    data, offsets = utf8(column)
    bounds = piece_cuts(data, offsets)
    if len(bounds) < 2:
        return Ragged(np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64))
    starts = chunk_bounds(data, bounds, offsets)
    coded = strings(data, bounds[starts]).dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    chunk_ids = encoder.chunks.of(coded.dictionary, encoder.encode).take(code)
    edges = bounds[starts]
    joins = np.flatnonzero(~np.isin(edges, offsets)[1:-1]) + 1  # chunk joins[i] - 1 meets chunk joins[i]
    bad = _disagree(encoder, data, bounds, starts[joins])
    while len(bad):  # join the chunks on both sides of a bad place, encode them as one, and look at its neighbours again
        edges = np.setdiff1d(edges, edges[joins[bad]])
        chunk_ids = encoder.plain(strings(data, edges))
        joins = np.flatnonzero(~np.isin(edges, offsets)[1:-1]) + 1
        bad = _disagree(encoder, data, bounds, np.searchsorted(bounds, edges[joins]))
    return chunk_ids.grouped(np.searchsorted(edges, offsets))


def _between(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """data[a[i]:b[i]] as strings, of which equal ones are one in the dictionary."""
    length = b - a
    return strings(data[spread(a, length)], np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])).dictionary_encode()


def _disagree(encoder: PieceEncoder, data: np.ndarray, bounds: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Joins, given as indices of the piece bounds they stand at, where the piece before and the piece after it, encoded as one
    text by the tokenizer, don't give the ids that both have alone."""
    if not len(middle):
        return np.zeros(0, np.int64)
    a, m, b = bounds[middle - 1], bounds[middle], bounds[middle + 1]
    seams = _between(data, a, b)
    whole = encoder.seams.of(seams.dictionary, encoder.plain).take(np.asarray(seams.indices, dtype=np.int64))
    sides = _between(data, np.stack([a, m], axis=1).ravel(), np.stack([m, b], axis=1).ravel())
    ids = encoder.distinct(sides.dictionary).take(np.asarray(sides.indices, dtype=np.int64))
    size = ids.bounds[2::2] - ids.bounds[:-1:2]
    same = np.diff(whole.bounds) == size
    agree = same.copy()
    if same.any():
        keep = np.flatnonzero(same & (size > 0))
        p, q = spread(whole.bounds[keep], size[keep]), spread(ids.bounds[::2][keep], size[keep])
        differ = np.repeat(np.arange(len(keep)), size[keep])[whole.flat[p] != ids.flat[q]]
        agree[keep[differ]] = False
    return np.flatnonzero(~agree)


def decoded(ids: np.ndarray, bounds: np.ndarray, vocabulary: pa.Array) -> pa.Array:
    """The tokens' strings with a blank between them, as a tokenizer file without a decoder gives."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), vocabulary.take(pa.array(ids))), " ")


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with `ids`: the ids of each whole text as little-endian 32-bit integers in a binary, without special tokens.

    With decoded_col there is also the text that the ids decode to, made in the same pass; without keep_text the text is not
    among the columns, and isn't moved back. Null and empty texts have no ids (an empty binary) and decode to the empty text.
    Repeated rows and empty tables come out as such; a very long text is a slice of its own. Columns of the new ones' names
    are replaced, others kept.
    """
    rows = packed(docs, text_col, _text=F.col(f"`{text_col}`"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in slices(batches, "_text", TEXT_BYTES):
            out = encode_column(encoder, batch.column("_text"))
            made = [batch.column("_row"), binary(out.flat.astype("<u4"), out.bounds)]
            if keep_text:
                made.append(batch.column("_text"))
            if decoded_col:
                made.append(decoded(out.flat, out.bounds, encoder.vocabulary()))
            yield pa.RecordBatch.from_arrays(made, names=names)

    text = F.col("_text")
    wanted = {"_row": F.col("_row"), "_ids": text.cast("binary"), **({"_text": text} if keep_text else {}), **({"_decoded": text} if decoded_col else {})}
    names = list(wanted)
    out = rows.mapInArrow(work, rows.select(*[c.alias(n) for n, c in wanted.items()]).schema)
    columns = [c for c in docs.columns if keep_text or c != text_col]
    new = {text_col: text} if keep_text else {}
    return unpacked(out, columns, **(new | {ids_col: F.col("_ids")} | ({decoded_col: F.col("_decoded")} if decoded_col else {})))


def decode_ids(table: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """table with `decoded`: the tokens' strings with a blank between them, as a tokenizer file without a decoder gives.

    Null ids decode to null, no ids to the empty text. Repeated rows and empty tables come out as such; a column of the new
    one's name is replaced, others kept. Very long ids are a slice of their own.
    """
    rows = packed(table, _ids=F.col(f"`{ids_col}`"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = PieceEncoder.of(tokenizer).vocabulary()
        for batch in slices(batches, "_ids", TEXT_BYTES):
            raw, offsets = utf8(batch.column("_ids"))
            text = pc.if_else(batch.column("_ids").is_valid(), decoded(np.frombuffer(raw.tobytes(), "<u4"), offsets // 4, vocabulary), None)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), text], names=["_row", "_decoded"])

    schema = rows.select("_row", F.col("_ids").cast("string").alias("_decoded")).schema
    return unpacked(rows.mapInArrow(work, schema), table.columns, **{text_col: F.col("_decoded")})
