"""Each stage of the pipeline on a small corpus, against rules checked here."""

import corpus_pipeline as cp
from conftest import SF


def test_stages_keep_the_columns_and_what_they_should(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding"]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    bad = {r[0] for r in duck.execute("select doc_id from labels where quality = 0 and toxic = 1").fetchall()}
    kept = {r.doc_id for r in cp.quality(spark, docs, SF).collect()}
    assert len(bad & kept) <= 0.1 * len(bad)
    lines = {r.doc_id: r for r in cp.lines(spark, docs, SF).collect()}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    had = {r.doc_id: (r.text or "") for r in docs.collect()}
    assert all(had[d].strip() for d in had.keys() - lines.keys()) and all(r.text.strip() for d, r in lines.items() if had[d].strip())


def test_lines_stage_drops_what_it_empties(spark):
    rows = [(1, "a line of some length\nanother line of some length"), (2, "Another line of some length\n a line of some length "), (3, ""), (4, None), (5, "a line of some length\nand more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in cp.lines(spark, docs, SF).collect()) == [(1, rows[0][1]), (3, ""), (4, ""), (5, "and more")]


def test_near_stage_keeps_one_of_each_group(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (4, "something else altogether that is not near"), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near(spark, docs, SF).collect()) == [1, 4, 5, 6]


def test_clean_stage_drops_what_holds_a_benchmark_item(spark, duck):
    item = duck.execute("select text from benchmark where length(text) > 100 limit 1").fetchone()[0]
    docs = spark.createDataFrame([(1, item, "en", "s", 1), (2, "nothing of that kind", "en", "s", 1), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.clean(spark, docs, SF).collect()) == [2, 3]


def test_run_is_the_stages_one_after_another(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert 0 < len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count() and len({r.doc_id for r in rows}) == len(rows)
