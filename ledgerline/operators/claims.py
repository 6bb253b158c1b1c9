"""Claims on facts: routing, classification, ranking and the set differences between commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import PROJECTOR, authority

IDENTITY = ["fact_key", "author", "path", "value"]


def distinct_claims(claims: DataFrame) -> DataFrame:
    """One row for each identity (fact, author, path, value), with its highest confidence."""
    return claims.groupBy(*IDENTITY).agg(F.max("confidence").alias("confidence"))


def fact_summary(claims: DataFrame) -> DataFrame:
    """What each fact's claims say together; one shuffle by fact with partial aggregation."""
    doc = F.col("author") != PROJECTOR
    return claims.groupBy("fact_key").agg(
        F.count("*").alias("n_claims"),
        F.max((~doc).cast("int")).cast("boolean").alias("has_code"),
        F.max(doc.cast("int")).cast("boolean").alias("has_doc"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min(F.when(doc, F.col("value"))).alias("doc_low"),
        F.max(F.when(doc, F.col("value"))).alias("doc_high"),
        F.max(F.when(~doc, F.col("value"))).alias("code_value"),
        F.coalesce(F.max(F.when(doc, F.col("confidence") * authority(F.col("author")))), F.lit(0.0)).alias("score"),
    )


def drift_class() -> Column:
    """The class of a disputed fact, from the columns of ``fact_summary``."""
    return F.when(~F.col("has_code"), "doc_vs_doc").when(F.col("doc_low") != F.col("doc_high"), "doc_vs_doc_vs_code").otherwise("doc_vs_code")


def route_end_state(claims: DataFrame) -> DataFrame:
    """Each fact's outcome: different values contradict; without them, code and documents corroborate."""
    outcome = F.when(F.col("low") != F.col("high"), "contradict").when(~F.col("has_doc"), "undocumented").when(~F.col("has_code"), "abstain").otherwise("corroborate")
    return fact_summary(claims).select("fact_key", "n_claims", outcome.alias("outcome"), F.when(F.col("low") != F.col("high"), drift_class()).alias("drift_class"), "code_value", "score")


def drift(claims: DataFrame) -> DataFrame:
    return route_end_state(claims).where("outcome = 'contradict'").select("fact_key", "drift_class", "code_value", "score")


def corroborated(claims: DataFrame) -> DataFrame:
    """Facts whose documents all state the code's own value."""
    return fact_summary(claims).where("has_code and has_doc and doc_low = doc_high and doc_low = code_value").select("fact_key", F.col("code_value").alias("value"), "n_claims")


def difference(have: DataFrame, want: DataFrame) -> DataFrame:
    """``retract`` rows that only ``have`` holds and ``assert`` rows that only ``want`` holds, in one shuffle by identity."""
    both = have.select(*IDENTITY, F.lit(1).alias("h"), F.lit(0).alias("w")).union(want.select(*IDENTITY, F.lit(0).alias("h"), F.lit(1).alias("w")))
    sides = both.groupBy(*IDENTITY).agg(F.max("h").alias("h"), F.max("w").alias("w")).where("h <> w")
    return sides.select(*IDENTITY, F.when(F.col("h") == 1, "retract").otherwise("assert").alias("action"))


def newly_opened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Disputes of ``after`` that weren't open before."""
    return drift(after).join(drift(before).select("fact_key"), "fact_key", "left_anti")
