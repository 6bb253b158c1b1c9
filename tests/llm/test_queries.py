"""Every registered query gives the columns and types of its contract, a row for each row of its table."""

import pytest

from ledgerline.llm import queries

from . import fixtures

LONGS = lambda *names: dict.fromkeys(names, "bigint")
CONTRACT = {
    "op2_bpe_roundtrip": LONGS("doc_id", "n_tokens") | {"ids_sha256": "string", "decoded_sha256": "string"},
    "op3_token_files": LONGS("doc_id", "start", "n_tokens", "ids_crc32"),
    "op4_line_templates": LONGS("doc_id", "n_lines", "n_dropped") | {"text_sha256": "string"},
    "op5_best_fit_packing": LONGS("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset") | {"piece": "int"},
    "op6_pii": LONGS("doc_id", "n_email", "n_ip", "n_card", "n_phone") | {"base_sha256": "string", "spans": "string"},
    "op7_secret_scan": LONGS("doc_id", "n_assign", "n_access", "n_hex") | {"base_sha256": "string", "spans": "string"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_quality": LONGS("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") | {"base_failed": "boolean", "kept": "boolean"},
    "op1_ngram_join": LONGS("doc_id", "n_shingles", "component_id"),
    "op12_merkle_manifest": LONGS("doc_id") | dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), "string") | {"verified": "boolean"},
    "op13_html_text": LONGS("page_id", "n_chars") | {"url": "string", "text": "string"},
    "op11_ranked_search": LONGS("item_id", "doc_id", "score") | {"rank": "int"},
    "op9_neighbours": LONGS("query_id", "vec_id") | {"rank": "int", "score": "double"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = fixtures.documents(spark, [t for t in fixtures.texts() if t is None or len(t) < 2000][:40], clash=True)
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)], 0) for i in range(30)], "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    spark.createDataFrame([(i, "http://a.example/%d" % i, f"<p>Text of page {i}") for i in range(docs.count())], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    docs.where("length(text) > 20").limit(3).selectExpr("doc_id AS item_id", "text").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs.count()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_contract(spark, tables, name):
    path, n = tables
    out = queries.QUERIES[name](spark, path)
    found = dict(out.dtypes)
    assert {c: found.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    if name == "op9_neighbours":
        assert {(r.query_id, r["rank"]) for r in out.collect()} == {(q, k) for q in (0, 20) for k in range(1, 21)}
    elif name == "op11_ranked_search":
        assert sorted((r.item_id, r["rank"]) for r in out.collect()) == sorted((r.item_id, k) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect() for k in range(1, 11))
    else:
        assert out.count() >= n and (name == "op5_best_fit_packing" or out.count() == n)
