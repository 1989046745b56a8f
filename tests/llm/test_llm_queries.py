import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF, rows
from tokenizers import Tokenizer

from tesserae.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_gives_what_sql_says(spark, duck, name):
    made, said = q.queries()[name](spark, SF).toPandas(), duck.execute(q.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(said.columns)
    assert rows(made) == rows(said)


def texts(duck):
    return duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


def encoded(name, lines):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t, [e.ids for e in t.encode_batch(lines, add_special_tokens=False)]


def test_token_records_hold_what_the_tokenizer_gives(spark, duck):
    docs = texts(duck)
    _, ids = encoded("byte_bpe_50k.json", [t for _, t in docs])
    want, start = [], 0
    for (doc, _), x in zip(docs, ids, strict=True):
        raw = np.array([*x, q.END_ID], "<u4")
        want.append((doc, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    assert sorted(map(tuple, q.op3_token_records(spark, SF).collect())) == want


def test_bpe_agrees_with_the_tokenizer(spark, duck):
    docs = texts(duck)
    t, ids = encoded("word_bpe_49k.json", [t for _, t in docs])
    want = [(d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (d, _), x in zip(docs, ids, strict=True)]
    assert sorted(map(tuple, q.op7_bpe(spark, SF).collect())) == want


def test_media_gives_back_the_padded_text(spark, duck):
    got = {r.doc_id: r for r in q.op4_media_columns(spark, SF).collect()}
    for doc, text in texts(duck):
        raw = text.encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_license_scan_finds_the_lines(spark, duck):
    got = {r.doc_id: r.n_licenses > 0 for r in q.op8_license_scan(spark, SF).collect()}
    marks = ("released under the mit license", "licensed under the apache license, version 2.0", "licensed under the gnu general public license, version 3")
    # the templates hold more than these marks (test_license_templates.py has all of them): each marked text is found
    assert {d for d, t in texts(duck) if any(m in t.lower() for m in marks)} <= {d for d, found in got.items() if found}


def test_quality_on_documents_it_was_not_fitted_on(spark):
    import pyspark.sql.functions as F

    from tesserae.llm.quality import classify_quality

    docs, labels = (q.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    out = classify_quality(docs, labels.where(~apart)).join(labels.where(apart).withColumnsRenamed({"quality": "q", "toxic": "x"}), "doc_id")
    right = out.select(F.avg(((F.col("quality") >= 0.5) == (F.col("q") == 1)).cast("int")), F.avg(((F.col("toxic") >= 0.5) == (F.col("x") == 1)).cast("int"))).first()
    assert right[0] > 0.95 and right[1] > 0.95
