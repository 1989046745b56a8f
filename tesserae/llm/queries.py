"""The queries of the text operators over the given tables, and what SQL says they return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts
from .common import shared_dir, stored
from .decontaminate import decontaminate
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .media import inspect_media, wrap_media
from .near_dedup import near_duplicates
from .quality import classify_quality
from .substring_dedup import dedup_substrings
from .token_records import read_tokens, write_tokens
from .url_filter import Rule, filter_urls

#: The rules of op2.
RULES = [Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block")]
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = stored(wrap_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media"))
    seen = inspect_media(media, payload=True)
    first, last = F.element_at("keyframes", 1), F.element_at("keyframes", -1)
    feature = F.concat_ws("|", "codec", "timescale", "duration", "n_samples", F.size("keyframes"), first["offset"], last["offset"] + last["size"])
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "codec", "duration", F.size("keyframes").cast("long").alias("n_keyframes"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded", keep_text=False)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["template"], x["start"], x["end"], F.format_number(x["containment"], 4))), ",")
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_licenses", found.alias("licenses"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), per_cent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_text", "p_meta", "quality", "toxic")], "keep")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_token_records, op4_media_columns, op5_decontaminate, op6_substring_dedup, op7_bpe, op8_license_scan, op9_near_dedup, op10_quality)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_WHITE})")} AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
g AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT l.*, g.first_doc IS NOT NULL AND g.first_doc <> doc_id AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op2_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
      ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS w
       FROM (SELECT item_id, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - m + 2)) AS t(s)),
dw AS (SELECT doc_id, m, s, array_to_string(ws[s:s + m - 1], ' ') AS w
       FROM d, (SELECT DISTINCT m FROM bw) AS k, unnest(range(1, len(ws) - m + 2)) AS t(s) WHERE len(ws) >= m),
h AS (SELECT doc_id, s, dw.m AS m, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, m FROM h), unnest(range(s, s + m)) AS t(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda s: {{'s': s, 'w': array_to_string(ws[s:s + 19], ' ')}})) AS v FROM d),
w AS (SELECT doc_id, v.s AS s, row_number() OVER (PARTITION BY v.w ORDER BY doc_id, v.s) AS nth FROM v),
g AS (SELECT DISTINCT doc_id, p FROM w, unnest(range(s, s + 20)) AS t(p) WHERE nth > 1),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.p IS NULL) AS kept
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.p GROUP BY e.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
