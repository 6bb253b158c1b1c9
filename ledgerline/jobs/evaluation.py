"""Evaluation on injected drift: known edits, what the engine reports, and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.jobs import corpora
from ledgerline.jobs.engine import events, sources
from ledgerline.operators.seeding import seeded_edits
from ledgerline.operators.slots import fold_slots
from ledgerline.scratch import written


#: Edits, each with the aspect that it makes wrong; a control has none.
CATEGORIES = {
    "default": "param.size.default", "type": "param.size.type", "control_comment": None, "control_statement": None,
    "rename": "param.size.exists", "returns": "returns.type", "optional": "param.size.type", "narrowed": "param.size.type",
}


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for each part that the documentation doesn't follow, or a control that changes no fact."""
    k = F.col("p_partkey")
    category = F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (k % len(CATEGORIES) + 1).cast("int"))
    return corpora.table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_size").alias("size"), category.alias("category"), (k % 9 == 0).alias("opaque"))


def _sources(edits: DataFrame) -> DataFrame:
    """The modules before (commit 1) and after their edit (commit 2)."""
    both = edits.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")))
    edited = F.col("seq") == 2
    of = lambda c: edited & (F.col("category") == c)
    content = F.concat(
        F.when(F.col("opaque"), "from vendor import opaque\n\n\n@opaque\n").otherwise(""),
        F.lit("def f("), F.when(of("rename"), "width").otherwise("size"), F.lit(": "),
        F.when(of("type"), "bytes").when(of("optional"), "int | None").when(of("narrowed"), "bool").otherwise("int"), F.lit(" = "), F.when(of("default"), F.col("size") + 7).otherwise(F.col("size")).cast("string"),
        F.lit(") -> "), F.when(of("returns"), "str").otherwise("int"),
        F.lit(':\n    """Return the size.\n\n    Args:\n        size (int): Size. Defaults to '), F.col("size").cast("string"), F.lit('.\n\n    Returns:\n        int: The size.\n    """\n'),
        F.when(of("control_comment"), "    # a comment\n").otherwise(""), F.when(of("control_statement"), "    size = size\n").otherwise(""), F.lit("    return size\n"),
    )
    return both.select("seq", corpora.part_path("k").alias("path"), content.alias("content"))


def injection_judge(spark, sf_dir):
    """The verdict on each edit: found, abstained or missed; for a control, clean or a false positive."""
    edits = plan(spark, sf_dir)
    slots = fold_slots(events(_sources(edits)))
    per = slots.groupBy("symbol_key").agg(
        F.collect_set(F.when((F.col("outcome") == "contradict") & (F.col("opened_seq") == 2), F.col("aspect"))).alias("opened"), F.collect_set(F.when(F.col("outcome") == "abstain", F.col("aspect"))).alias("unsure")
    )  # at most a few aspects of one symbol
    aspect = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[F.col("category")]
    rows = edits.withColumn("symbol_key", corpora.part_symbol("k")).join(per, "symbol_key", "left")
    injected = F.when(F.array_contains("opened", aspect), "found").when(F.array_contains("unsure", aspect), "abstained").otherwise("missed")
    verdict = F.when(F.col("category").startswith("control"), F.when(F.size("opened") > 0, "false_positive").otherwise("clean")).otherwise(injected)
    return rows.select("k", "category", verdict.alias("verdict"))


def recall_table(spark, sf_dir):
    """Per category: edits, and the share of those not abstained from that was found; null where all were."""
    v = F.col("verdict")
    n = lambda *names: F.sum(v.isin(*names).cast("long"))
    return injection_judge(spark, sf_dir).groupBy("category").agg(F.count("*").alias("edits"), n("found", "clean").alias("right"), n("abstained").alias("abstained"), F.round(F.try_divide(n("found", "clean"), n("found", "clean", "missed", "false_positive")), 6).alias("recall"))


#: Of so many parts one function for each category of seeded edits.
SEEDED_SHARE = 40


def seeded_verdicts(spark, sf_dir):
    """Seeded edits of each part's module: for each category and verdict, how many, in how many different functions."""
    files = sources(spark, sf_dir).where("seq = 1").select("path", "content")
    per = corpora.table(spark, sf_dir, "part").count() // SEEDED_SHARE
    verdicts = seeded_edits(written(files, "sources"), per)
    return verdicts.groupBy("category", "kind", "verdict").agg(F.count("*").alias("edits"), F.count_distinct("unit").alias("functions"), F.sum("extra").cast("long").alias("extra"))


def rename_hint(spark, sf_dir):
    """Removed and added symbols of one commit whose signatures agree and are nobody else's."""
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.concat_ws("|", "p_type", "p_brand", "p_size").alias("signature"))
    gone = part.where("size <= 40").select(corpora.part_symbol("k").alias("removed"), "signature")
    new = part.where("size > 10").select(F.concat(F.lit("py:new.q"), "k", F.lit(".f")).alias("added"), "signature")
    single = lambda df, c: df.groupBy("signature").agg(F.min(c).alias(c), F.count("*").alias("n")).where("n = 1").drop("n")
    return single(gone, "removed").join(single(new, "added"), "signature").select("removed", "added")


def half_life(spark, sf_dir):
    """Per priority, how long disputes stay open: orders' dates stand for when, their lines' last shipping for until."""
    until = corpora.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    rows = corpora.table(spark, sf_dir, "orders").join(until, "o_orderkey").select("o_orderpriority", F.date_diff("closed", "o_orderdate").alias("days"))
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("disputes"), F.percentile("days", F.lit(0.5)).alias("median_days"))


QUERIES = {f.__name__: f for f in (injection_judge, recall_table, seeded_verdicts, rename_hint, half_life)}
_VERDICTS = """verdicts AS (SELECT p_partkey AS k, ['default', 'type', 'control_comment', 'control_statement', 'rename', 'returns', 'optional', 'narrowed'][p_partkey % 8 + 1] AS category,
  CASE WHEN p_partkey % 8 IN (2, 3) THEN 'clean' WHEN p_partkey % 9 = 0 OR p_partkey % 8 = 7 THEN 'abstained' ELSE 'found' END AS verdict FROM part)"""
ORACLE_SQL = {
    "injection_judge": f"WITH {_VERDICTS} SELECT k, category, verdict FROM verdicts",
    "recall_table": f"""WITH {_VERDICTS} SELECT category, count(*) AS edits, CAST(count(*) FILTER (verdict IN ('found', 'clean')) AS BIGINT) AS "right", CAST(count(*) FILTER (verdict = 'abstained') AS BIGINT) AS abstained, CASE WHEN category <> 'narrowed' THEN 1.0e0 END AS recall FROM verdicts GROUP BY category""",
    # what the modules document and annotate leaves no room for the other categories
    "seeded_verdicts": f"""SELECT category, kind, verdict, count(*) AS edits, count(*) AS functions, CAST(0 AS BIGINT) AS extra
      FROM (VALUES ('code_default', 'inject', 'found'), ('code_param_type', 'inject', 'found'), ('code_param_renamed', 'inject', 'found'), ('docs_default', 'inject', 'found'), ('docs_param_type', 'inject', 'found'), ('docs_param_invented', 'inject', 'found'),
        ('docs_deprecated', 'inject', 'found'), ('comment_added', 'control', 'clean'), ('statement_added', 'control', 'clean'), ('function_added', 'control', 'clean'), ('summary_reworded', 'control', 'clean')) v(category, kind, verdict)
      JOIN (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () // {SEEDED_SHARE} AS per FROM part) WHERE n <= per) ON true GROUP BY ALL""",
    "rename_hint": """WITH p AS (SELECT p_partkey AS k, p_size, concat_ws('|', p_type, p_brand, p_size) AS signature FROM part), gone AS (SELECT signature, min(k) AS k FROM p WHERE p_size <= 40 GROUP BY signature HAVING count(*) = 1),
      new AS (SELECT signature, min(k) AS k FROM p WHERE p_size > 10 GROUP BY signature HAVING count(*) = 1) SELECT concat('py:cat.p', gone.k, '.f') AS removed, concat('py:new.q', new.k, '.f') AS added FROM gone JOIN new USING (signature)""",
    "half_life": """SELECT o_orderpriority AS priority, count(*) AS disputes, quantile_cont(date_diff('day', CAST(o_orderdate AS DATE), CAST(closed AS DATE)), 0.5) AS median_days
      FROM orders JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY l_orderkey) USING (o_orderkey) GROUP BY o_orderpriority""",
}
