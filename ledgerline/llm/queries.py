"""The registered queries of the training-data operators: each applies one to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import ids_crc32, scratch_path, written
from .html_text import extract_text
from .language import identify_language
from .language import train as train_network
from .line_templates import drop_templates
from .merkle import folded, leaf_hash, manifest_sql, merkle_manifest, proof_hash
from .neighbours import nearest_neighbours
from .ngram_join import ngram_join
from .packing import best_fit_pack, encode_pieces
from .pii import find_pii, pii_digest
from .quality import quality_rules
from .ranked_search import ranked_search, search_sql
from .secrets import BASE_RULES, find_secrets
from .spans import spelled
from .token_files import read_token_documents, write_token_blocks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose word 4-gram sets are at least 85 % alike."""
    return ngram_join(_table(spark, sf_dir, "documents"), 4, 85)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads every document back."""
    path = scratch_path(spark, "token-blocks")
    write_token_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return ids_crc32(read_token_documents(spark, path), ["doc_id", "start"])


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without those of recurring templates, as counts and a digest."""
    rows = drop_templates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces, packed."""
    pieces = encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    digests = ids_crc32(pieces, ["doc_id", "piece", "start", "length"]).drop("n_tokens")
    return best_fit_pack(written(digests, "pieces"), ["doc_id", "piece", "ids_crc32"])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts, base spans and all spans."""
    return pii_digest(find_pii(_table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts, and the spans of the base rules and of all rules."""
    found = find_secrets(_table(spark, sf_dir, "documents")).withColumn("base", F.filter("secrets", lambda m: m["order"] < len(BASE_RULES)))
    number = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(r[0]) for r in BASE_RULES), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a network that learns from three quarters of the documents."""
    docs = _table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    network = train_network(docs.where(part != 2).select("doc_id", "text", "lang"))
    return identify_language(docs, network).withColumn("held_out", F.coalesce(part == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each twentieth one."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), 20, 20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every text."""
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over all documents by source; every fifth document's text is lower-cased before its leaf is checked against the manifest."""
    fields = ("doc_id", "source", "lang", "n_chars")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(*fields, lower))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", leaf_hash(*fields, "text").alias("leaf"), tampered.alias("other"))
    rows = merkle_manifest(docs, "leaf", "source", "doc_id", ["other"])
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_bpe_roundtrip, op3_token_files, op4_line_templates, op5_best_fit_packing, op6_pii, op7_secret_scan, op8_language, op9_neighbours, op10_quality, op11_ranked_search, op12_merkle_manifest, op13_html_text)}
ORACLE_SQL: dict[str, str] = {"op11_ranked_search": search_sql(), "op12_merkle_manifest": manifest_sql()}
