"""All queries over the given tables, with their SQL."""

from __future__ import annotations

from ledgerline.jobs import engine, evaluation, knowledge, reads, reconcile, scalar_jobs, timeline

QUERIES = {**reads.QUERIES, **reconcile.QUERIES, **timeline.QUERIES, **scalar_jobs.QUERIES, **engine.QUERIES, **evaluation.QUERIES, **knowledge.QUERIES}
ORACLE_SQL = {**reads.ORACLE_SQL, **reconcile.ORACLE_SQL, **timeline.ORACLE_SQL, **scalar_jobs.ORACLE_SQL, **engine.ORACLE_SQL, **evaluation.ORACLE_SQL, **knowledge.ORACLE_SQL}
FLAGSHIP = "drift_end_to_end"
