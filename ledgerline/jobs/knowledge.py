"""Queries on who owns a key, what documents outside the code claim, and what was known when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.jobs import corpora
from ledgerline.jobs.engine import reconcile
from ledgerline.operators.ownership import own_keys, path_events
from ledgerline.scratch import shuffled, written

#: What each of a key's four paths defines: by the path's number.
KINDS = ("attribute", "function", "class", "module")


def _claimed_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Definitions and versions: a commit for each order; each part's key is claimed by up to four paths.

    A line that was neither returned nor accepted writes the key in its supplier's path; an accepted one writes the path without the key, a
    returned one deletes the path.
    """
    lines = corpora.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 4).cast("int").alias("v"), "l_returnflag")
    status = F.min(F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)).alias("status")
    rows = lines.groupBy(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("k"), "v").agg(status)
    rows = rows.withColumn("path", F.concat(F.lit("src/k"), "k", F.lit("/v"), "v", F.lit(".py")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("v") + 1)
    fields = F.array(F.struct(F.lit("kind").alias("aspect"), kind.alias("value")))
    there = rows.where("status = 0").select(corpora.part_symbol("k").alias("symbol_key"), "seq", "path", kind.alias("kind"), fields.alias("fields"))
    return there, rows.select("seq", "path", F.when(F.col("status") == 2, "deleted").otherwise("analyzed").alias("status"))


def key_handover(spark, sf_dir):
    """Every change of a key's owner or state, with the way it came about, and how many paths were refused."""
    there, versions = _claimed_keys(spark, sf_dir)
    none = F.array().cast("array<struct<aspect:string,value:string>>")
    out = own_keys(path_events(there, versions), "docstring", F.col("fields"), none)
    return out.select("symbol_key", "seq", "path", "present", "way", F.size("refused").alias("refused"))


def _documented_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part; modules that hand hundred names on under others, twice; then a page for each part that orders have; then
    modules written anew without their function, where lines of the part were returned in quantity. Pages name what they document by
    the second of its new names, and those of parts sold at the highest discount are wrong about its default.
    """
    k, size = F.col("k"), F.col("size").cast("string")
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").endswith("3").alias("open"), F.expr("p_partkey div 100").cast("string").alias("g"))
    lines = corpora.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_discount") >= 0.1).alias("wrong"), F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("lost"))
    sold = part.join(shuffled(lines), "k")
    head = F.when(F.col("open"), "from vendor import *\n").otherwise("")
    code = F.concat(head, F.lit("def f(size: int = "), size, F.lit("):\n    return size\n"))
    handed = lambda line: F.array_join(F.array_sort(F.collect_list(line)), "")  # noqa: E731  a hundred parts at most
    groups = part.groupBy("g").agg(
        handed(F.concat(F.lit("from cat.p"), k, F.lit(" import f as f"), k, F.lit("\n"))).alias("api"), handed(F.concat(F.lit("from .api"), F.col("g"), F.lit(" import f"), k, F.lit(" as g"), k, F.lit("\n"))).alias("hub")
    )
    page = F.concat(
        F.lit("# `cat.hub"), F.col("g"), F.lit(".g"), k, F.lit("`\n\n| Parameter | Type | Default |\n| --- | --- | --- |\n| `size` | `int` | `"), (F.col("size") + F.col("wrong").cast("int")).cast("string"), F.lit("` |\n"),
    )
    at = lambda rows, seq, path, content: rows.select(F.lit(seq).cast("long").alias("seq"), path.alias("path"), content.alias("content"))
    files = at(part, 1, corpora.part_path("k"), code)
    for name in ("api", "hub"):
        files = files.union(at(groups, 1, F.concat(F.lit(f"src/cat/{name}"), "g", F.lit(".py")), F.col(name)))
    files = files.union(at(sold, 2, F.concat(F.lit("docs/p"), "k", F.lit(".md")), page))
    return files.union(at(sold.where("lost"), 3, corpora.part_path("k"), F.concat(head, F.lit("x = 1\n"))))


def document_drift(spark, sf_dir):
    """Pages against code: names resolved over two hops of imports, defaults compared, missing symbols proven by closed modules."""
    return reconcile(written(_documented_library(spark, sf_dir), "library")).select("symbol_key", "aspect", "outcome", "code_value", "doc_value", "opened_seq", "deferred")


QUERIES = {f.__name__: f for f in (key_handover, document_drift)}
ORACLE_SQL = {
    "document_drift": """WITH lines AS (SELECT l_partkey AS k, bool_or(l_discount >= 0.1) AS wrong, bool_or(l_returnflag = 'R' AND l_quantity >= 49) AS lost FROM lineitem GROUP BY 1),
      p AS (SELECT concat('py:cat.p', k, '.f') AS symbol_key, p_size AS size, p_brand LIKE '%3' AS open, wrong, lost FROM lines JOIN part ON p_partkey = k)
      SELECT symbol_key, aspect, outcome, CASE WHEN outcome <> 'abstain' THEN code END AS code_value, doc AS doc_value, CAST(CASE WHEN outcome = 'contradict' THEN opened END AS BIGINT) AS opened_seq, CAST(deferred AS BIGINT) AS deferred FROM (
        SELECT symbol_key, 'exists' AS aspect, CASE WHEN NOT lost THEN 'corroborate' WHEN open THEN 'abstain' ELSE 'contradict' END AS outcome, CASE WHEN lost THEN 'false' ELSE 'true' END AS code, 'true' AS doc, 3 AS opened, 0 AS deferred FROM p
        UNION ALL SELECT symbol_key, unnest(['param.size.exists', 'param.size.type']), CASE WHEN lost THEN 'abstain' ELSE 'corroborate' END, unnest(['true', 'int']), unnest(['true', 'int']), NULL, 0 FROM p
        UNION ALL SELECT symbol_key, 'param.size.default', CASE WHEN wrong THEN 'contradict' WHEN lost THEN 'abstain' ELSE 'corroborate' END, CAST(size AS VARCHAR), CAST(size + CASE WHEN wrong THEN 1 ELSE 0 END AS VARCHAR), 2, CASE WHEN wrong AND lost THEN 1 ELSE 0 END FROM p)""",
    "key_handover": """WITH RECURSIVE rows AS (SELECT l_partkey AS k, l_orderkey AS seq, l_suppkey % 4 AS v, min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS st FROM lineitem GROUP BY ALL),
      following AS (SELECT k, v, st, lead(seq) OVER w AS seq, lead(st) OVER w AS next FROM rows WINDOW w AS (PARTITION BY k, v ORDER BY seq)),
      gone AS (SELECT k, seq, sum(CASE WHEN next = 2 THEN 1 << v ELSE 0 END) AS deleted, sum(CASE WHEN next = 1 THEN 1 << v ELSE 0 END) AS silent FROM following WHERE st = 0 AND next > 0 GROUP BY ALL),
      emits AS (SELECT k, seq, arg_min(v, CASE v WHEN 0 THEN 30 WHEN 3 THEN 13 ELSE 20 + v END) AS best, count(*) - 1 AS others FROM rows WHERE st = 0 GROUP BY ALL),
      commits AS (SELECT k, seq, best, coalesce(others, 0) AS others, CAST(coalesce(deleted, 0) AS BIGINT) AS deleted, CAST(coalesce(silent, 0) AS BIGINT) AS silent, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM emits FULL JOIN gone USING (k, seq)),
      run AS (
        SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS owner, false AS present, CAST(NULL AS VARCHAR) AS way, CAST(0 AS BIGINT) AS refused, false AS news FROM commits
        UNION ALL
        SELECT k, n, seq, CASE WHEN way IS NULL THEN owner ELSE best END, CASE WHEN best IS NULL THEN present AND NOT lost ELSE present OR way IS NOT NULL END, way, CASE WHEN best IS NULL THEN 0 ELSE others + CASE WHEN way IS NULL THEN 1 ELSE 0 END END,
          CASE WHEN best IS NULL THEN present AND lost ELSE way IS NOT NULL AND (owner IS DISTINCT FROM best OR NOT present) END
        FROM (SELECT c.k, c.n, c.seq, c.best, c.others, r.owner, r.present, owner IS NOT NULL AND ((c.deleted | c.silent) >> owner) & 1 = 1 AS lost,
            CASE WHEN c.best IS NULL THEN NULL WHEN r.owner IS NULL THEN 'free' WHEN r.owner = c.best THEN 'owner' WHEN NOT r.present THEN 'removed' WHEN (c.deleted >> r.owner) & 1 = 1 THEN 'deleted' WHEN (c.silent >> r.owner) & 1 = 1 THEN 'silent'
              WHEN CASE c.best WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END > CASE r.owner WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END THEN 'rank' END AS way
          FROM run r JOIN commits c ON c.k = r.k AND c.n = r.n + 1))
      SELECT concat('py:cat.p', k, '.f') AS symbol_key, seq, concat('src/k', k, '/v', owner, '.py') AS path, CASE WHEN news THEN present END AS present, CASE WHEN news OR way <> 'owner' THEN way END AS way, CAST(refused AS INTEGER) AS refused
      FROM run WHERE n > 0 AND (news OR refused > 0)""",
}
