"""Inputs of the engine that Spark derives from the given tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Claims of several authors on the size of parts, from orders' lines.
CLAIMS_SQL = """
claims AS (
  SELECT DISTINCT concat('py:cat.p', p_partkey, '.f#param.size.default') AS fact_key,
    author, concat('src/cat/p', p_partkey, '.py') AS path,
    CAST(CASE WHEN author = 'projector' THEN p_size
      ELSE p_size + CASE WHEN p_partkey % 4 = 0 AND l_orderkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 6 = 0 AND l_orderkey % 13 = 0 THEN 2 ELSE 0 END END AS VARCHAR) AS value,
    CASE author WHEN 'projector' THEN 1.0e0 WHEN 'docstring' THEN 0.95e0 ELSE 0.7e0 END AS confidence,
    state
  FROM (SELECT l_orderkey, p_partkey, p_size, l_returnflag AS state,
      CASE WHEN p_partkey % 9 = 1 THEN 'projector' ELSE CASE l_linenumber % 5 WHEN 0 THEN 'docstring' WHEN 1 THEN 'readme' WHEN 2 THEN 'docs' WHEN 3 THEN 'changelog'
        ELSE CASE WHEN p_partkey % 5 = 0 THEN 'wiki' ELSE 'projector' END END END AS author
    FROM lineitem JOIN part ON l_partkey = p_partkey))"""
DISTINCT_SQL = CLAIMS_SQL + """,
claim AS (SELECT fact_key, author, path, value, max(confidence) AS confidence FROM claims GROUP BY ALL)"""
SUMMARY_SQL = DISTINCT_SQL + """,
weighed AS (SELECT *, CASE author WHEN 'docstring' THEN 0.9e0 WHEN 'docs' THEN 0.8e0 WHEN 'readme' THEN 0.8e0 WHEN 'changelog' THEN 0.7e0 WHEN 'projector' THEN 1.0e0 ELSE 0.5e0 END AS weight FROM claim),
summary AS (
  SELECT fact_key, count(*) AS n_claims, count(DISTINCT value) AS n_values, bool_or(author = 'projector') AS has_code, bool_or(author <> 'projector') AS has_doc,
    count(DISTINCT CASE WHEN author <> 'projector' THEN value END) AS n_doc_values, max(CASE WHEN author = 'projector' THEN value END) AS code_value,
    max(CASE WHEN author <> 'projector' THEN value END) AS doc_value,
    coalesce(max(CASE WHEN author <> 'projector' THEN confidence * weight END), 0.0e0) AS score
  FROM weighed GROUP BY fact_key),
routed AS (
  SELECT fact_key, n_claims, code_value, score,
    CASE WHEN n_values > 1 THEN 'contradict' WHEN NOT has_doc THEN 'undocumented' WHEN NOT has_code THEN 'abstain' ELSE 'corroborate' END AS outcome,
    CASE WHEN n_values > 1 THEN CASE WHEN NOT has_code THEN 'doc_vs_doc' WHEN n_doc_values > 1 THEN 'doc_vs_doc_vs_code' ELSE 'doc_vs_code' END END AS drift_class
  FROM summary)"""
#: History of one field of each user, from events.
HISTORY_SQL = """
facts AS (SELECT user_id AS key, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS value, ts AS moment, event_id AS tie FROM events),
stated AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM facts WINDOW w AS (PARTITION BY key ORDER BY moment, tie)),
changed AS (SELECT * FROM stated WHERE (n = 1 AND value IS NOT NULL) OR (n > 1 AND value IS DISTINCT FROM before)),
edges AS (SELECT *, lead(moment) OVER w AS valid_to, lag(value) OVER w AS supersedes FROM changed WINDOW w AS (PARTITION BY key ORDER BY moment, tie)),
history AS (SELECT key, value, moment AS valid_from, valid_to, supersedes, tie FROM edges WHERE value IS NOT NULL)"""
#: Commits, from orders.
COMMITS_SQL = """
commits AS (SELECT o_orderkey AS seq, o_orderdate AS committed_at, epoch_us(o_orderdate) AS micros FROM orders),
changes AS (SELECT DISTINCT l_orderkey AS seq, concat('src/cat/p', l_partkey, '.py') AS path FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_symbol(key) -> F.Column:
    return F.concat(F.lit("py:cat.p"), F.col(key).cast("string"), F.lit(".f"))


def part_path(key) -> F.Column:
    return F.concat(F.lit("src/cat/p"), F.col(key).cast("string"), F.lit(".py"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on the size of every part, one for each line of an order; ``state`` is the line's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("state"))
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    n, k = F.col("l_linenumber") % 5, F.col("p_partkey")
    last = F.when(k % 5 == 0, "wiki").otherwise("projector")
    author = F.when(k % 9 == 1, "projector").when(n == 0, "docstring").when(n == 1, "readme").when(n == 2, "docs").when(n == 3, "changelog").otherwise(last)
    off = F.when((k % 4 == 0) & (F.col("l_orderkey") % 11 == 0), 1).otherwise(0) + F.when((k % 6 == 0) & (F.col("l_orderkey") % 13 == 0), 2).otherwise(0)
    rows = rows.withColumn("author", author)
    code = F.col("author") == "projector"
    return rows.select(
        F.concat(part_symbol("p_partkey"), F.lit("#param.size.default")).alias("fact_key"),
        "author",
        part_path("p_partkey").alias("path"),
        F.when(code, F.col("p_size")).otherwise(F.col("p_size") + off).cast("string").alias("value"),
        F.when(code, 1.0).when(F.col("author") == "docstring", 0.95).otherwise(0.7).alias("confidence"),
        "state",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 17 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), value.alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), at.alias("committed_at"), F.unix_micros(at.cast("timestamp")).alias("micros"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), part_path("l_partkey").alias("path")).distinct()
