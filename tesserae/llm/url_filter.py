"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules become runs of bits in 64-bit words, as many words as the rules need. One pass over the bytes of a URL moves
the states of all patterns at once (Shift-And with self-loops for wildcards), and numpy does so for a whole Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, unpacked, utf8

ONE = np.uint64(1)
#: Bytes of the states of the URLs that are read side by side.
STATE_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """`host/path`: for the host and its subdomains, where the URL's path starts with the rule's. Both may have globs:
    * is any run and ? any one character; neither crosses from the host into the path."""

    rule: str
    verdict: str


@dataclass
class Automaton:
    """Masks of shape (256, words) for bytes, (words,) for the rest; accept has the pattern's last bit."""

    step: np.ndarray
    loop: np.ndarray
    first: np.ndarray
    accept: list[tuple[int, np.uint64, int]]
    words: int


def compile_rules(rules: list[Rule]) -> Automaton:
    """Two patterns for each rule: its host alone, and any labels and a dot before it."""
    patterns = []
    for i, r in enumerate(rules):
        host, slash, path = r.rule.partition("/")
        host = host.translate({c: c + 32 for c in range(65, 91)})
        for glob in (host + slash + path, "*." + host + slash + path):
            items, inside = [], True
            for ch in glob.encode():
                inside = inside and ch != 0x2F
                items.append((ch, inside))
            patterns.append((i, items, inside))
    bits = sum(1 + host_only + sum(ch != 0x2A for ch, _ in items) for _, items, host_only in patterns)
    words = max(1, -(-bits // 64))
    step, loop, first = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    accept, at = [], 0

    def put(mask: np.ndarray, bit: int, allowed: np.ndarray) -> None:
        mask[allowed, bit // 64] |= ONE << np.uint64(bit % 64)

    for i, items, host_only in patterns:
        first[at // 64] |= ONE << np.uint64(at % 64)  # the bit before anything is read
        for ch, in_host in items:
            other = np.ones(256, bool)
            other[0x2F] = not in_host
            if ch == 0x2A:
                put(loop, at, other)
            else:
                at += 1
                only = other if ch == 0x3F else np.arange(256) == ch
                put(step, at, only)
        accept.append((at // 64, ONE << np.uint64(at % 64), i))
        if host_only:  # a rule without a path ends where the host ends: there, or at a slash
            at += 1
            put(step, at, np.arange(256) == 0x2F)
            accept.append((at // 64, ONE << np.uint64(at % 64), i))
        put(loop, at, np.ones(256, bool))  # a prefix that fits goes on fitting
        at += 1
    return Automaton(step, loop, first, accept, words)


def run(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The states after the last byte of each URL: (urls, words). URLs are taken from the longest on, so that those still running lead."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    start, length = offsets[:-1][order], length[order]
    state = np.repeat(auto.first[None, :], len(order), axis=0)
    going = len(order)
    for i in range(int(length[0]) if len(length) else 0):
        going = int(np.searchsorted(-length[:going], -i, side="left")) if length[going - 1] <= i else going
        ch = data[start[:going] + i]
        old = state[:going]
        moved = old << ONE
        moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
        state[:going] = (moved & auto.step[ch]) | (old & auto.loop[ch])
    out = np.empty_like(state)
    out[order] = state
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (strings) of each URL.

    Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end. A null
    URL, an empty one or one without :// has both empty. Of the rules that fit the longest wins (then the smaller rule in
    string order); with none, rule is null and verdict is `default`. Repeated rows give repeated results, an empty table
    an empty one, very long URLs are read whole. Columns of these four names are replaced, others kept.
    """
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = packed(pages, _host=host, _path=F.regexp_extract(url, parts, 2))
    rows = rows.withColumn("_canonical", F.concat("_host", "_path"))
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.rule))  # the first that fits wins
    auto = compile_rules(ranked)
    masks, accept = np.zeros(auto.words, np.uint64), {}
    for word, bit, i in auto.accept:
        masks[word] |= bit
        accept.setdefault(word, []).append((bit, i))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_canonical"):
            best = np.full(batch.num_rows, len(ranked))
            each = max(1, STATE_BYTES // (8 * auto.words))
            for at in range(0, batch.num_rows, each):
                state = run(auto, *utf8(batch.column("_canonical").slice(at, each)))
                for word in np.flatnonzero((state & masks).any(axis=0)):
                    some = np.flatnonzero(state[:, word] & masks[word])
                    for bit, i in accept[word]:
                        hit = some[state[some, word] & bit != 0]
                        best[at + hit] = np.minimum(best[at + hit], i)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "_host", "_path")], pa.array(best.astype(np.int32))], names=["_row", "_host", "_path", "_rule"])

    schema = rows.drop("_canonical").withColumn("_rule", F.lit(0)).schema
    judged = rows.mapInArrow(judge, schema)
    names = F.array(*[F.lit(r.rule) for r in ranked], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for r in ranked], F.lit(default))
    pick = lambda values: F.get(values, F.col("_rule"))
    return unpacked(judged, pages.columns, host=F.col("_host"), path=F.col("_path"), rule=pick(names), verdict=pick(verdicts))
