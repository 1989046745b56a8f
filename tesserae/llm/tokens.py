"""Encoding many texts with a tokenizer file of the tokenizers library, each different piece of text once."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices, spread, utf8
from .words import string_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
#: First bytes of characters that are no white space in any tokenizer's pattern.
_BLACK = np.zeros(256, bool)
#: Not "<", with which added tokens start: white space before those is the end of a text of its own.
_BLACK[[*range(0x21, 0x3C), *range(0x3D, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[[0x2C, 0x2E]] = True
#: Bytes that a Python worker takes to remember pieces and chunks, and bytes and texts that the tokenizer gets at a time.
PIECE_BYTES, CHUNK_BYTES, PLAIN_BYTES, PLAIN_ROWS = 48 << 20, 32 << 20, 1 << 18, 4096
_encoders: dict[str, PieceEncoder] = {}


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of pieces that encode alone as they do in the text: a blank or line feed before a visible character starts
    one, as patterns let no token go on over it; after a line feed there is another, and so do a comma and a
    full stop after a plain letter."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        lead = _SPACE[data[:-1]] & _BLACK[data[1:]]
        inner = offsets[(offsets > 0) & (offsets < n)]
        lead[inner - 1] = False  # what follows is another text
        cut[:-2] |= lead
        cut[1:-1] |= lead & (data[:-1] == 0x0A)
        cut[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut)


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as strings."""
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


class Ragged:
    """Ids of many strings, end to end, with n + 1 bounds."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        self.flat, self.bounds = flat, bounds

    def take(self, which: np.ndarray) -> Ragged:
        length = np.diff(self.bounds)[which]
        return Ragged(self.flat[spread(self.bounds[which], length)], np.concatenate([np.zeros(1, np.int64), np.cumsum(length)]))

    def grouped(self, at: np.ndarray) -> Ragged:
        """Strings at[i] to at[i + 1] as one."""
        return Ragged(self.flat, self.bounds[at])


class Generation:
    """Strings with their ids, found by the sorted 64-bit hashes of their bytes; the bytes are compared as well."""

    def __init__(self):
        self.keys, self.slot, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.texts, self.text_at = Growing(np.uint8), Growing(np.int64, 0)
        self.ids, self.ids_at = Growing(np.uint32), Growing(np.int64, 0)

    def size(self) -> int:
        return 16 * self.n + sum(g.array.nbytes for g in (self.texts, self.text_at, self.ids, self.ids_at))

    def find(self, keys: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The slot of each string raw[bounds[i]:bounds[i + 1]], or -1."""
        if not self.n:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        slot = np.where(self.keys[at] == keys, self.slot[at], -1)
        some = np.flatnonzero(slot >= 0)
        start, size = self.text_at.values()[slot[some]], np.diff(bounds)[some]
        other = self.text_at.values()[slot[some] + 1] - start != size
        slot[some[other]] = -1
        some, start, size = some[~other], start[~other], size[~other]
        differ = self.texts.values()[spread(start, size)] != raw[spread(bounds[some], size)]
        slot[np.repeat(some, size)[differ]] = -1
        return slot

    def add(self, keys: np.ndarray, raw: np.ndarray, bounds: np.ndarray, ids: Ragged) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slot = np.insert(self.keys, at, keys[order]), np.insert(self.slot, at, self.n + order)
        self.text_at.append(self.texts.used + bounds[1:] - bounds[0])
        self.texts.append(raw[bounds[0] : bounds[-1]])
        self.ids_at.append(self.ids.used + ids.bounds[1:] - ids.bounds[0])
        self.ids.append(ids.flat[ids.bounds[0] : ids.bounds[-1]])
        self.n += len(keys)


class Growing:
    """An array that takes more at its end, its room growing by a half."""

    def __init__(self, kind: type, *first: int):
        self.array, self.used = np.array(first, kind), len(first)

    def append(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.array):
            self.array = np.concatenate([self.values(), np.empty(len(values) + self.used // 2, self.array.dtype)])
        self.array[self.used : self.used + len(values)] = values
        self.used += len(values)

    def values(self) -> np.ndarray:
        return self.array[: self.used]


class Memory:
    """The ids of strings seen before, in about `limit` bytes: two generations, of which the older one goes when the younger
    one has half of that. What is found in the older one moves to the younger one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit // 2, Generation(), Generation()

    def of(self, values: pa.Array, plain: Callable[[pa.Array], Ragged]) -> Ragged:
        """The ids of each of these different strings; those not known come from `plain`, all at once."""
        raw, bounds = utf8(values)
        keys = string_hashes(raw, bounds)
        out: list[tuple[np.ndarray, Ragged]] = []
        left = np.arange(len(keys))
        for known in (self.young, self.old):
            size = np.diff(bounds)[left]
            slot = known.find(keys[left], raw[spread(bounds[left], size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))
            hit = slot >= 0
            out.append((left[hit], Ragged(known.ids.values(), known.ids_at.values()).take(slot[hit])))
            left = left[~hit]
        out.append((left, plain(values.take(pa.array(left))) if len(left) else Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))))
        for which, ids in out[1:]:
            if len(which):
                if self.young.size() > self.limit:
                    self.young, self.old = Generation(), self.young
                size = np.diff(bounds)[which]
                self.young.add(keys[which], raw[spread(bounds[which], size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]), ids)
        place = np.empty(len(keys), np.int64)
        place[np.concatenate([w for w, _ in out])] = np.arange(len(keys))
        flat = np.concatenate([r.flat for _, r in out])
        sizes = np.concatenate([np.diff(r.bounds) for _, r in out])
        return Ragged(flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])).take(place)


class PieceEncoder:
    """A tokenizer and the ids of the pieces and chunks seen last, bounded in bytes."""

    @staticmethod
    def of(path: str) -> PieceEncoder:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        return _encoders[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words: pa.Array | None = None
        self.known, self.chunks, self.seams = Memory(PIECE_BYTES), Memory(CHUNK_BYTES), Memory(PIECE_BYTES // 4)

    def vocabulary(self) -> pa.Array:
        """The token of each id."""
        if self.tokenizer.decoder is not None:
            raise ValueError("only files without a decoder")
        if self.words is None:
            by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
            self.words = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
        return self.words

    def plain(self, texts: pa.Array) -> Ragged:
        """Straight from the tokenizer, a few texts at a time, as its encodings take many times the bytes of their texts."""
        flat, ends = array("I"), array("q", [0])
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", PLAIN_BYTES):
            for at in range(0, part.num_rows, PLAIN_ROWS):
                for e in self.tokenizer.encode_batch_fast(part.column(0)[at : at + PLAIN_ROWS].to_pylist(), add_special_tokens=False):
                    flat.extend(e.ids)
                    ends.append(len(flat))
        return Ragged(np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32), np.frombuffer(ends, np.int64))

    def distinct(self, values: pa.Array) -> Ragged:
        """The ids of different strings, from memory where they are known."""
        return self.known.of(values, self.plain)

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> Ragged:
        if len(bounds) < 2:
            return Ragged(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        coded = strings(data, bounds).dictionary_encode()
        return self.distinct(coded.dictionary).take(np.asarray(coded.indices, dtype=np.int64))

    def encode(self, column: pa.Array) -> Ragged:
        data, offsets = utf8(column)
        bounds = piece_cuts(data, offsets)
        return self.pieces(data, bounds).grouped(np.searchsorted(bounds, offsets))


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of whole-number values as little-endian binaries."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
