"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop lines over the threshold and put the rest together by position.

All of it is DataFrame functions. Only hashes and positions are shuffled to find repeated lines; a hash that a third of
all documents share is counted per (hash, document) first. Verdicts on hashes of more documents than lines / HOT_KEYS, of which
there can be no more than HOT_KEYS, are broadcast; the others, which are no hot keys, are joined. Each text is moved once, to meet the list of its own dropped positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, packed, stored, text_of, unpacked

#: Keys whose verdict is broadcast, at most: those that stand in more documents than lines / HOT_KEYS.
HOT_KEYS = 100_000

#: [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; lower() does the same on plain ASCII, and faster."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with repeated lines taken out of the texts, and n_lines, n_dropped (long).

    A line whose key has min_chars code points or more and is found in min_docs documents or more stays only in the
    smallest id that holds it, there as often as it stands. Null or empty text: one empty line, text "". A null id is the
    smallest id. Rows of one id are one document for the count; each row keeps its own lines, so repeated rows give
    repeated results. An empty table gives an empty table. Columns named n_lines or n_dropped are replaced, others kept.
    """
    rows = packed(docs, text_col, _id=id_key(id_col), _text=text_of(text_col))
    rows = rows.withColumn("_of", F.xxhash64("_text"))
    lines = rows.select("_id", "_of", F.posexplode_outer(F.split("_text", "\n", -1)).alias("_at", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    lines = stored(lines.select("_id", "_of", "_at", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(7), "_key").alias("_g")))
    often = max(min_docs, lines.count() // HOT_KEYS)
    repeated = stored(
        lines.groupBy("_h", "_g", "_id").agg(F.lit(1).alias("_one"))
        .groupBy("_h", "_g").agg(F.count("_one").alias("_docs"), F.min("_id").alias("_first"))
        .where(F.col("_docs") >= min_docs)
    )
    # a line that many documents share would be one task's key: its verdict goes to the lines instead, by broadcast
    hot = F.broadcast(repeated.where(F.col("_docs") > often).select("_h", "_g", "_first"))
    rest = repeated.where(F.col("_docs") <= often).select("_h", "_g", "_first")
    both_kinds = lines.join(hot, ["_h", "_g"]).unionByName(lines.join(hot, ["_h", "_g"], "left_anti").join(rest, ["_h", "_g"]))
    dropped = both_kinds.where(F.col("_id") != F.col("_first"))
    dropped = dropped.groupBy("_id", "_of").agg(F.collect_set("_at").alias("_drop"))
    both = rows.join(dropped, ["_id", "_of"], "left")
    split = F.split("_text", "\n", -1)
    total = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), total - 1), F.col("_drop"))  # by hashing, in order
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    dropped_n = F.coalesce(F.size("_drop"), F.lit(0))
    return unpacked(both, docs.columns, **{text_col: text, "n_lines": total.cast("long"), "n_dropped": F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(dropped_n).cast("long")})
