"""A template with words put in is found while its containment is enough."""

from tesserae.llm.license_scan import scan_licenses


def test_inserted_words_do_not_hide_a_template(spark):
    w = [f"w{i}" for i in range(170)]  # 166 shingles
    texts = [w[:85] + ["x"] * 40 + w[85:], w[:12] + ["x"] + w[12:24], w[:85] + ["x"] * 100 + w[85:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: [(x.template, x.start, x.end, round(x.containment, 6)) for x in r.licenses] for r in scan_licenses(docs, {"long": " ".join(w), "short": " ".join(w[:24])}).collect()}
    assert ("long", 0, 210, round(162 / 166, 6)) in out[0]
    assert ("short", 0, 25, 0.8) in out[1]
    assert not [x for x in out[2] if x[0] == "long"]
