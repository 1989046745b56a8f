"""The license scan against brute-force shingle containment for all templates."""

import random
import re

from conftest import SF

from tesserae.llm import queries as q
from tesserae.llm.license_scan import LEAST, TEMPLATES, scan_licenses


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower() if text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def found(text, templates, reach=lambda n: int(n / LEAST + 1e-9)):
    """(template, best containment) of each that some window of reach(n) shingles from one of its own has enough of."""
    out, w = {}, words(text)
    texts = {k: grams(w, k) for k in range(1, 6)}
    for name, body in templates.items():
        k = min(5, len(words(body)))
        whole = grams(words(body), k)
        t = set(whole)
        mine = [(i, g) for i, g in enumerate(texts[k]) if g in t]
        if len({g for _, g in mine}) >= LEAST * len(t):
            best = max(len({g for j, g in mine if i <= j < i + reach(len(whole))}) for i, _ in mine) / len(t)
            if best >= LEAST:
                out[name] = round(best, 9)
    return out


def scanned(out):
    best = {}
    for r in out.collect():
        mine = best.setdefault(r.doc_id, {})
        for x in r.licenses:
            mine[x.template] = max(mine.get(x.template, 0), round(x.containment, 9))
    return best


def test_query_finds_all_templates_that_brute_force_finds(spark, duck):
    texts = duck.execute("select doc_id, coalesce(text, '') from documents").fetchall()
    got = {r.doc_id: {x.split(":")[0] for x in r.licenses.split(",") if x} for r in q.op8_license_scan(spark, SF).collect()}
    want = {d: set(found(t, TEMPLATES)) for d, t in texts}
    assert got == want
    assert any("cc-by-nc-4.0-short" in x for x in got.values()) and any("all-rights-reserved" in x for x in got.values())


def test_texts_headers_and_notices_are_found_in_prose(spark):
    random.seed(4)
    prose = lambda n: " ".join(random.choices(["alpha", "beta", "gamma", "delta"], k=n))
    names = [n for n in TEMPLATES if len(TEMPLATES[n].split()) < 1300]
    lines = [f"{prose(20)}\n{TEMPLATES[n]}\n{prose(20)}" for n in names]
    for n in ("mit-text", "bsd-3-clause-text", "apache-2.0-text", "gpl-2.0-or-later-header"):  # words changed here and there
        w = TEMPLATES[n].split()
        for i in range(7, len(w), 60):
            w[i] = "other"
        lines.append(" ".join(w))
    lines.append(" ".join(TEMPLATES[n] for n in ("mit-text", "bsd-2-clause-text", "mit-text")))
    got = scanned(scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert got == {i: found(t, TEMPLATES) for i, t in enumerate(lines)}
    assert all(n in got[i] for i, n in enumerate(names))


def test_two_copies_are_two_places(spark):
    out = scan_licenses(spark.createDataFrame([(1, f"{TEMPLATES['mit-text']} and {TEMPLATES['mit-text']}")], "doc_id long, text string")).first()
    n = len(words(TEMPLATES["mit-text"]))
    assert [(x.start, x.end, x.containment) for x in out.licenses if x.template == "mit-text"] == [(0, n, 1.0), (n + 1, 2 * n + 1, 1.0)]
