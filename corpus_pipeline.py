"""A corpus pipeline: each stage reads all that the one before it kept.

Null and empty texts have no words, so the quality rules reject them. Rows that repeat are judged alike: they all stay or go, but for near
duplicates, of which the rows of one doc_id stay, the smallest; rows with a null doc_id are no one's duplicates and stay. Columns besides
those of ``documents`` pass through unread, whatever their names; the last stage names its own. An empty table gives one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import clear_of, ids_crc32, row_key, written
from ledgerline.llm.line_templates import drop_templates
from ledgerline.llm.ngram_join import ngram_join
from ledgerline.llm.packing import best_fit_pack, encode_pieces
from ledgerline.llm.pii import find_pii
from ledgerline.llm.quality import quality_rules
from ledgerline.llm.spans import redacted

#: Near duplicates: words of a shingle, and per cent of the union that two documents share at least.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep."""
    judged = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = clear_of("row", docs.columns)
    kept = judged.where("kept").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(kept, key, "left_semi").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; a document with nothing left goes."""
    rows = drop_templates(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    groups = ngram_join(docs, SHINGLE_WORDS, SIMILARITY)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    key, pii = clear_of("row", docs.columns), clear_of("pii", docs.columns)
    found = find_pii(docs).where(F.size("pii") > 0).select(F.col("key").alias(key), F.col("pii").alias(pii)).dropDuplicates([key])
    rows = docs.withColumn(key, row_key()).join(written(found, "personal-data").hint("shuffle_hash"), key, "left")
    text = F.when(F.col(pii).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(pii)))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in training sequences."""
    pieces = encode_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    digests = ids_crc32(pieces, ["doc_id", "piece", "start", "length"]).drop("n_tokens")
    return best_fit_pack(written(digests, "pieces"), ["doc_id", "piece", "ids_crc32"])


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", packing)]
#: The stages train a model, join by similarity and pack: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
