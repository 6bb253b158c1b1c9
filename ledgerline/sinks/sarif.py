"""Findings as one SARIF document, written from sorted ranges without collecting them.

Each finding is a line of its own. Ranges of the ranking write their lines as parts; the document is its head, the parts in order and its
foot, copied by streams from file to file. Findings lie between commas but for the first, which the ranking's number tells.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.ordering import number_ranged, ranged
from ledgerline.scratch import scratch_path

#: The format's version and schema, and the levels of drift classes.
VERSION, SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
LEVELS = {"doc_vs_code": "error", "doc_vs_doc_vs_code": "error", "doc_vs_doc": "warning"}
HEAD = json.dumps({"$schema": SCHEMA, "version": VERSION, "runs": [{"tool": {"driver": {"name": "ledgerline", "rules": [{"id": c} for c in LEVELS]}}, "results": []}]})


def result_line() -> F.Column:
    """A finding's line, from ``fact_key``, ``drift_class``, ``code_value``, ``score`` and ``path``."""
    level = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("drift_class")]
    text = F.concat(F.col("fact_key"), F.lit(": "), F.col("drift_class"), F.coalesce(F.concat(F.lit(", the code says "), "code_value"), F.lit("")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    return F.to_json(
        F.struct(
            F.col("drift_class").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"),
            F.struct(F.col("fact_key").alias("factKey/v1")).alias("partialFingerprints"), F.struct("score", F.col("code_value").alias("codeValue")).alias("properties"),
        )
    )


def write_sarif(findings: DataFrame, path: str) -> None:
    """Writes ``findings`` by falling score and then key to the file ``path``, which must not exist."""
    spark: SparkSession = findings.sparkSession
    rows = number_ranged(ranged(findings, F.desc("score"), "fact_key"), "n")
    lines = rows.select("_at", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), result_line()).alias("line"))
    parts = scratch_path(spark, "sarif")
    lines.repartitionByRange("_at").sortWithinPartitions("_at").select("line").write.text(parts)
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, folder = fs.Path(path), fs.Path(parts)
    out = target.getFileSystem(conf).create(target, False)
    head, foot = HEAD.rsplit("[]", 1)
    try:
        out.write(bytearray(f"{head}[\n".encode()))
        source = folder.getFileSystem(conf)
        for status in sorted(source.globStatus(fs.Path(parts, "part-*")), key=lambda s: s.getPath().getName()):  # a part for each range
            part = source.open(status.getPath())
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
        out.write(bytearray(f"]{foot}\n".encode()))
    finally:
        out.close()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a document that ``write_sarif`` made, line by line: ``fact_key``, ``drift_class``, ``code_value``, ``score``, ``path``."""
    kind = "ruleId string, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>, partialFingerprints struct<`factKey/v1`:string>, properties struct<score:double,codeValue:string>"
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(r'^,?\{"ruleId"')))
    found = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), kind).alias("r"))
    return found.select(
        F.col("r.partialFingerprints.`factKey/v1`").alias("fact_key"), F.col("r.ruleId").alias("drift_class"), F.col("r.properties.codeValue").alias("code_value"), F.col("r.properties.score").alias("score"),
        F.get("r.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("path"),
    )
