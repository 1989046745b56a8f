"""Words of many texts at once, as arrays: bounds, the text they belong to and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import utf8

_BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_R))
_POW = np.cumprod(np.full(_BLOCK, _R, np.uint64), dtype=np.uint64)
_INV = np.cumprod(np.full(_BLOCK, pow(_R, -1, 2**64), np.uint64), dtype=np.uint64)

SPACES = np.ones(256, bool)
#: White space of [\x20\x09-\x0D]; all else makes words.
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
#: Digits, a-z and all beyond ASCII make words.
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words in order of their texts. `first` has the n + 1 bounds of the texts in terms of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words_of(column: pa.Array, is_word: np.ndarray, lower: bool, hashed: bool = True) -> Words:
    data, offsets = utf8(column)
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)  # a word can't go on over the end of its text
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & ~(before & ~edge[:n]))
    after = np.empty(n, bool)
    after[n - 1 :] = False
    after[: n - 1] = inside[1:]
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, start, end, text, first, _hashes(data, start, end) if hashed else np.zeros(0, np.uint64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, side="right")))
        low, high = int(start[at]), int(end[to - 1])
        if high - low > _BLOCK:  # one very long word
            total = U(0)
            for block in range(low, high, _BLOCK):
                part = _BYTE[data[block : min(high, block + _BLOCK)]]
                total = mix(np.array([total ^ (part * _POW[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[at] = total
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low:high]] * _POW[: high - low], out=sums[1:])
            s, e = start[at:to] - low, end[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64))
        at = to
    return out


def string_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[bounds[i]:bounds[i + 1]]."""
    return _hashes(data, bounds[:-1], bounds[1:])


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the k words from each word on, and whether these lie in one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= U(0x2545F4914F6CDD1D)
        out += words.hash[i : i + n]
    return mix(out), words.text[:n] == words.text[k - 1 : k - 1 + n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each on; doubles the span step by step."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return out if span == w else np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])
