"""The document of findings, as a JSON reader sees it."""

import json

from ledgerline.sinks.sarif import read_results, write_sarif


def test_one_document_in_the_rankings_order(spark, tmp_path):
    rows = [(f'py:m.f{i}"\n#exists', "doc_vs_code" if i % 2 else "doc_vs_doc", None if i % 5 == 0 else f"é{i}", float(i % 7), f"src/m{i}.py") for i in range(300)]
    df = spark.createDataFrame(rows, "fact_key string, drift_class string, code_value string, score double, path string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several parts
    try:
        write_sarif(df, str(tmp_path / "a.sarif"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    document = json.loads((tmp_path / "a.sarif").read_text(encoding="utf-8"))
    results = document["runs"][0]["results"]
    want = sorted(rows, key=lambda r: (-r[3], r[0]))
    assert document["version"] == "2.1.0" and [r["partialFingerprints"]["factKey/v1"] for r in results] == [r[0] for r in want]
    assert [(r["ruleId"], r["level"], r["properties"].get("codeValue"), r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for r in results] == [(r[1], "error" if r[1] == "doc_vs_code" else "warning", r[2], r[4]) for r in want]
    assert sorted(map(tuple, read_results(spark, str(tmp_path / "a.sarif")).collect()), key=str) == sorted(rows, key=str)
    write_sarif(df.limit(0), str(tmp_path / "b.sarif"))
    assert json.loads((tmp_path / "b.sarif").read_text())["runs"][0]["results"] == []
