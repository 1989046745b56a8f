"""Substring dedup: repeats of WINDOW words or more, from suffix subtrees that are built apart, a group of prefixes at a time.

The suffixes that a group gets are those of a *sparse* suffix tree: of each WINDOW words the K words with the least hash are the
anchor. Equal windows have equal anchors at equal places, so all copies of a repeat fall into the group of their anchor's
K-word prefix, with the words around it. Then:

1. Prefixes are counted over all documents (with partial sums, so a hot one is no hot task). A prefix of one document only
   can't repeat, and its suffixes are not moved at all. A prefix of more than `limit` documents would outgrow a task: its
   suffixes start at the windows themselves and their prefix is WINDOW words long.
2. The words of the suffixes left go to their group. There words get numbers, the suffixes are sorted by prefix doubling, and
   neighbours whose common prefix is WINDOW words or longer hang from one internal node of that depth: a repeat. The earliest
   place of each node stays. Words themselves are compared, not hashes.
3. Groups of long prefixes are dealt by document as well, a part for each `limit` documents, and what is first in its part meets
   the other parts' firsts, so a passage that a third of all documents hold is no unbounded group either.

A task first settles the repeats among its own slice of texts in the same way and passes on one place of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, packed, slices, spread, stored, text_of, unpacked
from .tokens import strings
from .words import SPACES, U, Words, grams, mix, sliding_min, words_of

WINDOW, K = 20, 8
#: Documents with one prefix that a task takes, and bytes of suffixes in a group's task.
LIMIT, GROUP_BYTES = 50_000, 32 << 20
#: Bytes that a suffix takes in the mean; decides only how many groups there are.
SUFFIX_BYTES = 160
#: Windows `at` to `at + n - 1` of a document with their words; n = 0: a span that is settled, up to the word `end`.
_SUFFIX = "key long, part long, id long, at long, n int, end long, hot boolean, words string"


def anchored(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text, with the hash of their anchor and a hash of all their words."""
    g, _ = grams(words, k)
    h, inside = grams(words, window)
    at = np.flatnonzero(inside)
    return at, sliding_min(g, window - k + 1)[at] if len(at) else np.zeros(0, np.uint64), h[at]


def codes(words: Words) -> np.ndarray:
    """A number for each different word."""
    size = words.end - words.start
    texts = strings(words.data[spread(words.start, size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))
    return np.asarray(texts.dictionary_encode().indices, dtype=np.int64)


def nodes(numbers: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The internal node of the given depth over each suffix at[i], as a number in the order of their first `depth` words: suffixes
    are sorted by prefix doubling, and neighbours with a shorter common prefix are under different nodes. All suffixes have
    that many words."""
    rank, span, done = numbers, 1, 0
    node = np.zeros(len(at), np.int64)
    while True:
        if depth & span:  # the words that this power of two stands for in the depth
            both = node * (rank.max(initial=0) + 1) + rank[at + done]
            node = np.unique(both, return_inverse=True)[1]
            done += span
        if done == depth:
            return node
        both = rank[: len(rank) - span] * (rank.max(initial=0) + 1) + rank[span:]
        rank = np.unique(both, return_inverse=True)[1]
        span *= 2


def earliest(node: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes under the same node: whether a place is the first, and whether an earlier one exists. The same (doc, at) twice is no repeat."""
    first, repeat = np.ones(len(node), bool), np.zeros(len(node), bool)
    order = np.lexsort((at, doc, node))
    w, d, a = node[order], doc[order], at[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    first[order], repeat[order] = new, (d != d[head]) | (a != a[head])
    return first, repeat


def runs(doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans (doc, start, end) that the windows cover, joined where windows follow each other."""
    order = np.lexsort((at, doc))
    d, a = doc[order], at[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] > a[:-1] + window)
    start = np.flatnonzero(new)
    return d[start], a[start], (a[np.append(start[1:], len(a)) - 1] + window) if len(a) else a[start]


class Slice:
    """The windows of a slice of texts, those settled within it, and those that stay."""

    def __init__(self, batch: pa.RecordBatch, window: int, k: int):
        self.words = words_of(batch.column("text"), SPACES, lower=False)
        at, self.anchor, whole = anchored(self.words, window, k)
        text = self.words.text[at]
        self.at, self.text, self.doc, self.place = at, text, np.asarray(batch.column("id"))[text], at - self.words.first[text]
        # only windows whose hash is there twice can be equal; of those the words decide
        order = np.argsort(whole)
        same = whole[order[1:]] == whole[order[:-1]]
        twin = np.zeros(len(at), bool)
        if len(at):
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
        some = np.flatnonzero(twin)
        self.first, self.repeat = np.ones(len(at), bool), np.zeros(len(at), bool)
        if len(some):
            self.first[some], self.repeat[some] = earliest(nodes(codes(self.words), at[some], window), self.doc[some], self.place[some])
        self.left = np.flatnonzero(self.first)
        self.whole = whole


def _spans(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["id", "start", "end"])


def _suffixes(key: np.ndarray, part: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, end: np.ndarray, hot: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    kinds = {"key": np.int64, "part": np.int64, "id": np.int64, "at": np.int64, "n": np.int32, "end": np.int64, "hot": bool}
    columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip((key, part, doc, at, n, end, hot), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, words], names=[*kinds, "words"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, limit: int = LIMIT) -> DataFrame:
    """(id, start, end): word spans covered by windows whose words also start earlier. Spans of one id may overlap.

    Null and empty texts have none; a null id is the smallest long; the same place of an id in repeated rows is no repeat of
    itself; an empty table gives an empty table. The result doesn't depend on limit.
    """
    spark = docs.sparkSession
    rows = packed(docs, text_col, _id=id_key(id_col), _text=text_of(text_col))
    narrow = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))

    def prefixes(skip: np.ndarray) -> DataFrame:
        """(p, id): the anchors of each row's windows, once a row."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = words_of(batch.column("text"), SPACES, lower=False)
                at, anchor, _ = anchored(words, window, k)
                text = words.text[at]
                step = np.ones(len(anchor), bool)  # a run of windows with one anchor
                step[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                anchor, text = anchor[step], text[step]
                order = np.lexsort((anchor, text))
                anchor, text = anchor[order], text[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                if len(skip):
                    new &= ~np.isin(anchor, skip)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(np.asarray(batch.column("id"))[text[new]])], names=["p", "id"])

        return narrow.mapInArrow(work, "p long, id long")

    shared = stored(prefixes(np.zeros(0, np.uint64)).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = shared.where(F.col("n") > limit).toArrow()  # a row for each `limit` documents' prefixes at most
    order = np.argsort(np.asarray(hot.column("p")).astype(np.int64).view(np.uint64))
    frequent, parts = np.asarray(hot.column("p")).astype(np.int64).view(np.uint64)[order], -(-np.asarray(hot.column("n"), dtype=np.int64)[order] // limit)
    needs = prefixes(frequent).join(shared.select("p"), "p").groupBy("id").agg(F.collect_set("p").alias("_needs"))
    size = (shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * SUFFIX_BYTES) // GROUP_BYTES
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = Slice(batch, window, k)
            d, a, b = runs(s.doc[s.repeat], s.place[s.repeat], window)
            if len(d):
                zero = np.zeros(len(d), np.int64)
                yield _suffixes(mix(d.view(np.uint64) ^ a.view(np.uint64)), zero, d, a, zero, b, zero, pa.nulls(len(d), pa.string()))
            lists = batch.column("needs")
            wanted = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64) ^ mix(np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0))).astype(np.uint64))
            left, anchor = s.left, s.anchor[s.left]
            hot = np.isin(anchor, frequent)
            need = hot | np.isin(anchor ^ mix(s.text[left].astype(np.uint64)), wanted)
            left, anchor, hot = left[need], anchor[need], hot[need]
            if not len(left):
                continue
            step = np.ones(len(left), bool)
            step[1:] = (anchor[1:] != anchor[:-1]) | (s.text[left[1:]] != s.text[left[:-1]]) | (s.at[left[1:]] != s.at[left[:-1]] + 1) | hot[1:]
            start = np.flatnonzero(step)
            n, begin, hot = np.diff(np.append(start, len(left))), s.at[left[start]], hot[start]
            low, high = s.words.start[begin], s.words.end[begin + n + window - 2]
            texts = strings(s.words.data[spread(low, high - low)], np.concatenate([np.zeros(1, np.int64), np.cumsum(high - low)]))
            doc, key = s.doc[left[start]], np.where(hot, s.whole[left[start]], anchor[start])
            many = parts[np.minimum(np.searchsorted(frequent, anchor[start]), len(parts) - 1)] if len(parts) else np.ones(len(start), np.int64)
            part = np.where(hot, (mix(doc.view(np.uint64)) % np.maximum(many, 1).astype(np.uint64)).astype(np.int64), 0)
            yield _suffixes(key, part, doc, s.place[left[start]], n, np.zeros(len(start), np.int64), hot, texts)

    def subtrees(spans: bool):
        """The spans of repeats; or else the suffixes of long prefixes that are first in their part."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                n = np.asarray(batch.column("n"))
                if spans:
                    done = batch.filter(pa.array(n == 0))
                    yield pa.RecordBatch.from_arrays([done.column(c) for c in ("id", "at", "end")], names=["id", "start", "end"])
                held.append(batch.filter(pa.array((n > 0) if spans else np.asarray(batch.column("hot").to_numpy(zero_copy_only=False)))))
            if not sum(b.num_rows for b in held):
                return
            table = pa.Table.from_batches(held)
            doc, at, n = (np.asarray(table.column(c)).astype(np.int64) for c in ("id", "at", "n"))
            words = words_of(pa.concat_arrays(table.column("words").chunks), SPACES, lower=False, hashed=False)
            row, place = np.repeat(np.arange(len(n)), n), spread(at, n)  # the windows of a row start one word apart
            first, repeat = earliest(nodes(codes(words), spread(words.first[:-1], n), window), doc[row], place)
            if spans:
                yield _spans(*runs(doc[row][repeat], place[repeat], window))
            else:  # rows of one window each
                yield from table.filter(pa.array(first)).to_batches()

        return work

    both = rows.join(needs.withColumnRenamed("id", "_id"), "_id", "left")
    # all columns of the rows go along, so that the rows are dealt by id once for this join and for the one that cuts the texts
    sent = both.select("_row", F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_needs").alias("needs")).mapInArrow(suffixes, _SUFFIX)
    dealt = sent.repartition(groups, "key", "part")
    found = dealt.mapInArrow(subtrees(True), "id long, start long, end long")
    if len(frequent):
        found = found.union(dealt.mapInArrow(subtrees(False), _SUFFIX).repartition(groups, "key").mapInArrow(subtrees(True), "id long, start long, end long"))
    return found


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, limit: int = LIMIT) -> DataFrame:
    """docs with the text's words that no repeat covers, joined by one blank, and n_words, n_removed (long).

    Words: runs of anything but white space [\\x20\\x09-\\x0D]. A word goes if a window of `window` words over it has words
    that also start earlier: in a smaller id, or in the same document further on the left. Windows are judged on the input.
    Null and empty text have no words and become "". A null id is the smallest. Rows with one id count as one document:
    repeated rows don't repeat each other, and a word place removed in one goes in all. Empty tables give empty tables;
    columns n_words and n_removed are replaced, others kept. A very long text is a slice of its own.
    """
    spans = repeats(docs, id_col, text_col, window, k, limit).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    rows = packed(docs, text_col, _id=id_key(id_col), _text=text_of(text_col))
    both = rows.join(spans.withColumnRenamed("id", "_id"), "_id", "left").select("_row", "_text", "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"), SPACES, lower=False, hashed=False)
            count = np.diff(words.first)
            lists = batch.column("_spans")
            which = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            low = np.minimum(np.asarray(flat.field("start")), count[which]) + words.first[which]
            high = np.minimum(np.asarray(flat.field("end")), count[which]) + words.first[which]
            depth = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(depth, low, 1)
            np.add.at(depth, high, -1)
            keep = np.cumsum(depth)[:-1] == 0
            kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[words.first]
            start, size = words.start[keep], (words.end - words.start)[keep]
            # each kept word with a blank after it, then no blank at a text's end
            place = spread(start, size + 1)
            raw = np.append(words.data, np.uint8(32))[np.minimum(place, len(words.data))]
            ends = np.cumsum(size + 1)
            raw[ends - 1] = 32
            bytes_at = np.concatenate([np.zeros(1, np.int64), ends])[kept]
            last = bytes_at[1:][np.diff(kept) > 0] - 1
            solid = np.ones(len(raw), bool)
            solid[last] = False
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid)])[bytes_at]
            text = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw[solid]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), text, pa.array(count), pa.array(count - np.diff(kept))], names=["_row", "_text", "_n", "_gone"])

    schema = both.select("_row", "_text", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_gone")).schema
    return unpacked(both.mapInArrow(cut, schema), docs.columns, **{text_col: F.col("_text"), "n_words": F.col("_n"), "n_removed": F.col("_gone")})
