"""A corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.bpe import encode_texts
from tesserae.llm.common import stored
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.line_dedup import WHITE, dedup_lines
from tesserae.llm.near_dedup import near_duplicates
from tesserae.llm.quality import classify_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier holds for bad or toxic. Null texts are scored as empty ones, null metadata as a
    value of its own; repeated rows are judged alike; an empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_quality(docs, labels).where("keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars follows. A document all of whose text stood in earlier ones is
    left without any and goes; one that had none to begin with stays, a null text as an empty one. Repeated rows give repeated
    rows, an empty table an empty one."""
    out = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(WHITE)) == "")
    return out.where(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id (a null id is the smallest). Documents without
    words, null texts among them, are in no group and stay; an empty table gives an empty one."""
    return near_duplicates(docs, per_cent=80).where("kept").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents contaminated by the benchmark. Null and empty texts aren't; an empty table gives an empty one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).where("not contaminated").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, a row a document; null and empty texts have no ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = encode_texts(docs.select("doc_id", "text"), path, decoded_col="decoded", keep_text=False)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", clean), ("BPE encoding", tokens)]

#: SQL can't train a classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
