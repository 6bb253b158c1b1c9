"""Queries on claims and their disputes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.jobs import corpora
from ledgerline.jobs.corpora import CLAIMS_SQL, DISTINCT_SQL, SUMMARY_SQL
from ledgerline.operators import claims as C
from ledgerline.operators.ordering import queue_number
from ledgerline.scratch import scratch_path
from ledgerline.sinks.sarif import read_results, write_sarif


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_claims(corpora.claims(spark, sf_dir))


def route_end_state(spark, sf_dir):
    return C.route_end_state(_claims(spark, sf_dir)).withColumn("score", F.round("score", 6))


def drift_ranked(spark, sf_dir):
    """Open disputes with their place in the review queue, by score and then by key."""
    return queue_number(C.drift(_claims(spark, sf_dir)).withColumn("score", F.round("score", 6)), "score", "fact_key", "place").select("fact_key", "drift_class", "code_value", "score", "place")


def findings_export(spark, sf_dir):
    """All open disputes, written as one SARIF document and read from it again."""
    path = F.concat(F.lit("src/"), F.translate(F.regexp_extract("fact_key", r"^py:(.*)[.][^.#]*#", 1), ".", "/"), F.lit(".py"))
    findings = C.drift(_claims(spark, sf_dir)).withColumn("score", F.round("score", 6)).withColumn("path", path)
    target = scratch_path(spark, "findings.sarif")
    write_sarif(findings, target)
    return read_results(spark, target)


def drift_topk(spark, sf_dir):
    """The twenty findings that a reviewer sees first."""
    return C.drift(_claims(spark, sf_dir)).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "fact_key").limit(20)


def drift_by_class(spark, sf_dir):
    return C.drift(_claims(spark, sf_dir)).groupBy("drift_class").agg(F.count("*").alias("n"))


def outcome_totals(spark, sf_dir):
    return C.route_end_state(_claims(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


def corroborated_facts(spark, sf_dir):
    return C.corroborated(_claims(spark, sf_dir))


def claim_dedup(spark, sf_dir):
    return _claims(spark, sf_dir)


def author_members_exploded(spark, sf_dir):
    """Each disputed fact with each of its claims."""
    rows = _claims(spark, sf_dir)
    return rows.join(C.drift(rows).select("fact_key", "drift_class"), "fact_key").select("fact_key", "drift_class", "author", "value")


def _halves(spark, sf_dir):
    rows = corpora.claims(spark, sf_dir)
    return C.distinct_claims(rows.where("state <> 'A'")), C.distinct_claims(rows.where("state <> 'R'"))


def claims_retract_assert(spark, sf_dir):
    """What a commit retracts and asserts, from the claims before it and those it wants."""
    return C.difference(*_halves(spark, sf_dir))


def net_changes(spark, sf_dir):
    return C.difference(*_halves(spark, sf_dir)).groupBy("author", "action").agg(F.count("*").alias("n"))


def introduced_gate(spark, sf_dir):
    """Disputes that all claims have and those of lines in one state don't."""
    rows = corpora.claims(spark, sf_dir)
    return C.newly_opened(C.distinct_claims(rows.where("state = 'N'")), C.distinct_claims(rows)).select("fact_key", "drift_class", "code_value")


def coverage_ratios(spark, sf_dir):
    """Per author: its facts, and the shares of them that are verified and that can't be."""
    routed = C.route_end_state(_claims(spark, sf_dir)).select("fact_key", "outcome")
    rows = _claims(spark, sf_dir).where("author <> 'projector'").select("fact_key", "author").distinct().join(routed, "fact_key")
    share = lambda o: F.round(F.avg((F.col("outcome") == o).cast("double")), 6)
    return rows.groupBy("author").agg(F.count("*").alias("facts"), share("corroborate").alias("verified"), share("abstain").alias("abstained"), share("contradict").alias("disputed"))


QUERIES = {
    f.__name__: f
    for f in (route_end_state, drift_ranked, findings_export, drift_topk, drift_by_class, outcome_totals, corroborated_facts, claim_dedup, author_members_exploded, claims_retract_assert, net_changes, introduced_gate, coverage_ratios)
}
_HALVES = CLAIMS_SQL + """,
have AS (SELECT DISTINCT fact_key, author, path, value FROM claims WHERE state <> 'A'),
want AS (SELECT DISTINCT fact_key, author, path, value FROM claims WHERE state <> 'R'),
moves AS (SELECT *, 'retract' AS action FROM (SELECT * FROM have EXCEPT SELECT * FROM want) UNION ALL SELECT *, 'assert' AS action FROM (SELECT * FROM want EXCEPT SELECT * FROM have))"""
ORACLE_SQL = {
    "route_end_state": f"WITH {SUMMARY_SQL} SELECT fact_key, n_claims, outcome, drift_class, code_value, round(score, 6) AS score FROM routed",
    "drift_ranked": f"WITH {SUMMARY_SQL} SELECT fact_key, drift_class, code_value, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, fact_key) AS place FROM routed WHERE outcome = 'contradict'",
    "findings_export": f"""WITH {SUMMARY_SQL} SELECT fact_key, drift_class, code_value, round(score, 6) AS score, concat('src/cat/', regexp_extract(fact_key, 'cat[.](p[0-9]+)', 1), '.py') AS path FROM routed WHERE outcome = 'contradict'""",
    "drift_topk": f"WITH {SUMMARY_SQL} SELECT fact_key, drift_class, code_value, round(score, 6) AS score FROM routed WHERE outcome = 'contradict' ORDER BY round(score, 6) DESC, fact_key LIMIT 20",
    "drift_by_class": f"WITH {SUMMARY_SQL} SELECT drift_class, count(*) AS n FROM routed WHERE outcome = 'contradict' GROUP BY drift_class",
    "outcome_totals": f"WITH {SUMMARY_SQL} SELECT outcome, count(*) AS n FROM routed GROUP BY outcome",
    "corroborated_facts": f"WITH {SUMMARY_SQL} SELECT fact_key, code_value AS value, n_claims FROM summary WHERE has_code AND has_doc AND n_doc_values = 1 AND doc_value = code_value",
    "claim_dedup": f"WITH {DISTINCT_SQL} SELECT * FROM claim",
    "author_members_exploded": f"WITH {SUMMARY_SQL} SELECT fact_key, drift_class, author, value FROM claim JOIN routed USING (fact_key) WHERE outcome = 'contradict'",
    "claims_retract_assert": f"WITH {_HALVES} SELECT * FROM moves",
    "net_changes": f"WITH {_HALVES} SELECT author, action, count(*) AS n FROM moves GROUP BY author, action",
    "introduced_gate": f"""WITH {SUMMARY_SQL}, old AS (SELECT fact_key FROM claims WHERE state = 'N' GROUP BY fact_key HAVING count(DISTINCT value) > 1)
      SELECT fact_key, drift_class, code_value FROM routed WHERE outcome = 'contradict' AND fact_key NOT IN (SELECT fact_key FROM old)""",
    "coverage_ratios": f"""WITH {SUMMARY_SQL} SELECT author, count(*) AS facts, round(avg(CASE WHEN outcome = 'corroborate' THEN 1.0e0 ELSE 0 END), 6) AS verified,
      round(avg(CASE WHEN outcome = 'abstain' THEN 1.0e0 ELSE 0 END), 6) AS abstained, round(avg(CASE WHEN outcome = 'contradict' THEN 1.0e0 ELSE 0 END), 6) AS disputed
      FROM (SELECT DISTINCT fact_key, author FROM claim WHERE author <> 'projector') JOIN routed USING (fact_key) GROUP BY author""",
}
