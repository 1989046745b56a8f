"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; brute force on small corpora."""

import random

import public_tokenizers
import pytest

from tesserae.llm.bpe import decode_ids, encode_texts
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.license_scan import scan_licenses
from tesserae.llm.line_dedup import dedup_lines
from tesserae.llm.media import inspect_media, wrap_media
from tesserae.llm.near_dedup import near_duplicates
from tesserae.llm.quality import classify_quality
from tesserae.llm.substring_dedup import dedup_substrings
from tesserae.llm.token_records import read_tokens, write_tokens
from tesserae.llm.url_filter import Rule, filter_urls

SCHEMA = "doc_id long, text string, _row string, id long, _id int, n_words long, key int, `a.b` int"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six\nA repeated line", "r", 5, 1, 9, 0, 3), (2, None, None, None, None, None, None, None), (3, "", "", 0, 0, 0, 0, 0), (None, "no id here, but a text of some words", "x", 1, 1, 1, 1, 1),
    (4, LONG, "l", 1, 1, 1, 1, 1), (5, "one two three four five six\nA REPEATED line ", "r", 5, 1, 9, 0, 3), (5, "one two three four five six\nA REPEATED line ", "r", 5, 1, 9, 0, 3), (6, " \t\n", "b", 1, 1, 1, 1, 1), (7, "word", "b", 1, 1, 1, 1, 1), (8, "word", "b", 1, 1, 1, 1, 1),
]
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 1), (8, None, 5)], "doc_id long, quality int, toxic int")


def all_of(spark, docs, marks):
    bench = spark.createDataFrame([(1, "two THREE four"), (2, None), (None, "word"), (3, "")], "item_id long, text string")
    yield dedup_lines(docs)
    yield inspect_media(wrap_media(docs), payload=True)
    yield decontaminate(docs, bench)
    yield dedup_substrings(docs)
    yield decode_ids(encode_texts(docs, WORDS), WORDS)
    yield scan_licenses(docs)
    yield near_duplicates(docs)
    yield classify_quality(docs, marks)
    yield filter_urls(docs.withColumn("url", docs.text), [Rule("com/a", "block")])


def test_odd_rows_keep_their_number_and_columns(spark, docs, marks):
    for out in all_of(spark, docs, marks):
        assert set(docs.columns) <= set(out.columns)
        assert len(out.collect()) == len(ROWS)


def test_empty_tables(spark, docs, marks):
    for out in all_of(spark, docs.limit(0), marks.limit(0)):
        assert out.collect() == []


def test_token_records_of_odd_rows(spark, docs, tmp_path):
    write_tokens(docs, str(tmp_path / "a"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = sorted(read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8] and [r.n_tokens for r in got][2:4] == [1, 1]
    index = spark.read.parquet(str(tmp_path / "a/index"))
    picked = read_tokens(spark, str(tmp_path / "a"), index.where("id in (4, 8)"))
    assert sorted((r.id, r.start, bytes(r.ids)) for r in picked.collect()) == sorted((r.id, r.start, bytes(r.ids)) for r in got if r.id in (4, 8))
    write_tokens(docs.limit(0), str(tmp_path / "b"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_line_dedup_rules(docs):
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[1].n_dropped == 0 and got[5].n_dropped == 2 and got[5].text == "" and (got[2].n_lines, got[2].text) == (1, "")


def test_a_longer_rule_wins_and_hosts_are_whole(spark):
    urls = ["http://a.com/x", "http://B.A.com/x/y", "http://ba.com/x", "http://a.com", "http://e.org/a.com/x", "a.com/x", None, "x://a.com/q?://b/"]
    rules = [Rule("a.com", "block"), Rule("a.com/x", "allow"), Rule("*.net/*.zip", "block")]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://c.net/d/e.zip?x", "http://c.net.org/e.zip"])], "page_id long, url string")
    got = [r.rule for r in filter_urls(frame, rules).orderBy("page_id").collect()]
    assert got == ["a.com/x", "a.com/x", None, "a.com", None, None, None, "a.com", "*.net/*.zip", None]


def test_many_rules_need_several_words(spark):
    rules = [Rule(f"host{i}.example/p{i}", "block") for i in range(200)]
    frame = spark.createDataFrame([(i, f"https://www.host{i}.example/p{i}/z") for i in range(200)], "page_id long, url string")
    assert [r.rule for r in filter_urls(frame, rules).orderBy("page_id").collect()] == [r.rule for r in rules]


def corpus(seed, n=120):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    base = [random.choices(words, k=random.randint(1, 120)) for _ in range(n // 3)]
    out = [" ".join(b) for b in base]
    while len(out) < n:
        b = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            b[random.randrange(len(b))] = random.choice(words)
        out.append(" ".join(b + random.choice(base)[:25] * random.randint(0, 1)))
    return out


def test_near_duplicates_are_those_of_brute_force(spark):
    lines = corpus(5)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in lines]
    top = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    got = near_duplicates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(len(s), t) for s, t in zip(sets, top, strict=True)]


def test_substrings_are_those_of_brute_force(spark):
    lines, seen, want = corpus(6), {}, []
    for t in lines:
        w, gone = t.split(), set()
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (len(want), i)) != (len(want), i):
                gone |= set(range(i, i + 20))
        want.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = dedup_substrings(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.text) for r in got] == want


def test_long_prefixes_in_parts_give_the_same(spark):
    frame = spark.createDataFrame(list(enumerate(corpus(7) * 3)), "doc_id long, text string").repartition(20)
    got = [sorted(map(tuple, dedup_substrings(frame, limit=limit).collect())) for limit in (50_000, 4, 1)]
    assert got[0] == got[1] == got[2]


def test_a_column_named_as_the_marker_of_packed_rows(spark):
    assert [tuple(r) for r in dedup_lines(spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, _is int")).collect()] == [(1, "a", 5, 1, 0)]


def test_damaged_and_many_track_files(spark):
    import struct

    from tesserae.llm.media import box, boxes, inspect, padded, wrap

    good = wrap(padded(b"x" * 1000))
    at = good.index(b"stsz") + 12
    huge = good[:at] + struct.pack(">I", 2**32 - 1) + good[at + 4 :]
    at = good.index(b"stco") + 12
    far = good[:at] + struct.pack(">I", 1_000_000) + good[at + 4 :]
    top = {kind: good[a:b] for kind, a, b in boxes(memoryview(good), 0, len(good))}
    track = next(top[b"moov"][a:b] for kind, a, b in boxes(memoryview(top[b"moov"]), 0, len(top[b"moov"])) if kind == b"trak")
    two = good[: good.index(b"moov") - 4] + box(b"moov", top[b"moov"], box(b"trak", track)) + box(b"mdat", bytes(2000))
    files = [good, huge, far, good[:100], b"", b"no media", two, box(b"ftyp") + box(b"moof"), None]
    out = inspect_media(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary"), payload=True).orderBy("doc_id").collect()
    assert [r.error is None for r in out] == [True, False, False, False, False, False, True, False, True]
    assert out[0].payload == padded(b"x" * 1000) and len(out[6].tracks) == 2 and out[6].tracks[1].n_samples == inspect(good)[0]["n_samples"]


def test_a_common_line_is_dropped_by_broadcast_as_by_join(spark, monkeypatch):
    from tesserae.llm import line_dedup

    frame = spark.createDataFrame([(i, f"a line that all have\nline number {i} of its own\npair line {i // 2} of two") for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, dedup_lines(frame).collect()))
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 12)
    assert sorted(map(tuple, dedup_lines(frame).collect())) == want and want[1][3] == 2 and want[2][3] == 1


def test_rules_of_many_words_in_small_blocks(spark, monkeypatch):
    from tesserae.llm import url_filter

    monkeypatch.setattr(url_filter, "STATE_BYTES", 4096)
    test_many_rules_need_several_words(spark)


def test_large_template_sets_are_joined(spark, monkeypatch):
    from tesserae.llm import license_scan

    frame = spark.createDataFrame([(1, "so it is Released under the MIT License. and more")], "doc_id long, text string")
    want = scan_licenses(frame).collect()
    monkeypatch.setattr(license_scan, "BROADCAST_WORDS", 10)
    assert scan_licenses(frame).collect() == want and want[0].n_licenses == 1
