"""Queries that read the knowledge base: facts, claims, owners and fields, as a user asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions.types import canonical_literal, canonical_type
from ledgerline.jobs import corpora
from ledgerline.jobs.corpora import DISTINCT_SQL, SUMMARY_SQL
from ledgerline.jobs.engine import events, sources
from ledgerline.operators import claims as C
from ledgerline.operators.signature import signatures

#: Findings that a summary shows of each class, and commits that a run takes at most.
SHOWN, COMMITS = 3, 100


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_claims(corpora.claims(spark, sf_dir))


def _part(spark, sf_dir):
    return corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


def fact_parts(spark, sf_dir):
    """Every fact's symbol and aspect, and whether the code could speak for it."""
    key = F.col("fact_key")
    at = F.instr(key, "#")
    aspect = F.substring(key, at + 1, F.length(key))
    open_to_code = aspect.isin("exists", "returns.type", "deprecated") | aspect.startswith("param.") | aspect.startswith("raises.")
    extra = F.when(F.col("k") % 3 == 0, "added_in").when(F.col("k") % 3 == 1, "raises.E#1").otherwise("deprecated")
    stated = _claims(spark, sf_dir).select("fact_key").union(_part(spark, sf_dir).select(F.concat(corpora.part_symbol("k"), F.lit("#"), extra))).distinct()
    return stated.select("fact_key", F.substring(key, F.lit(1), at - 1).alias("symbol_key"), aspect.alias("aspect"), open_to_code.alias("projectable"))


def claims_on_fact(spark, sf_dir):
    """All that is said of each fact, the code first and then by author."""
    author = F.when(F.col("author") == S.PROJECTOR, "code").otherwise(F.regexp_replace("author", "^plumb-", ""))
    said = F.struct((F.col("author") != S.PROJECTOR).alias("later"), author.alias("author"), "value")
    shown = F.transform(F.sort_array(F.collect_set(said)), lambda c: F.concat(c["author"], F.lit("="), c["value"]))
    return _claims(spark, sf_dir).groupBy("fact_key").agg(F.array_join(shown, ", ").alias("shown"))


def claims_by_author_paths(spark, sf_dir):
    """Claims of one author on a set of paths."""
    paths = _part(spark, sf_dir).where("size <= 10").select(corpora.part_path("k").alias("path"))
    return _claims(spark, sf_dir).where("author = 'docstring'").join(paths, "path", "left_semi").select("fact_key", "path", "value")


def facts_about_symbol(spark, sf_dir):
    """Per symbol, its facts and how many claims they have."""
    return _claims(spark, sf_dir).groupBy(F.substring_index("fact_key", "#", 1).alias("symbol_key")).agg(F.count_distinct("fact_key").alias("facts"), F.count("*").alias("claims"))


def _writes(spark, sf_dir):
    """Who writes a part's key, in the order of commits, with the rank of what each defines."""
    lines = corpora.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("module", "class", "function", "attribute", "method"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return lines.select(corpora.part_symbol("l_partkey").alias("symbol_key"), F.concat(F.lit("src/v"), F.col("l_suppkey"), F.lit(".py")).alias("path"), F.col("l_orderkey").alias("seq"), S.kind_rank(kind).alias("rank")).distinct()


def ownership_over_time(spark, sf_dir):
    """Writes of each key, whether its owner then accepts them: the first path of the highest rank so far owns it; in one commit, the first by name."""
    per = Window.partitionBy("symbol_key").orderBy("seq", F.desc("rank"), "path").rowsBetween(Window.unboundedPreceding, 0)
    rows = _writes(spark, sf_dir).withColumn("top", F.max("rank").over(per))
    owner = F.min_by("path", F.struct(-F.col("rank"), "seq", "path")).over(per)
    return rows.withColumn("owner", owner).select("symbol_key", "seq", "path", "owner", (F.col("path") == F.col("owner")).alias("accepted"))


def symbols_by_path(spark, sf_dir):
    """Per path, the keys that it owns after all commits."""
    best = F.min_by("path", F.struct(-F.col("rank"), "seq", "path")).alias("path")
    return _writes(spark, sf_dir).groupBy("symbol_key").agg(best).groupBy("path").agg(F.count("*").alias("symbols"), F.min("symbol_key").alias("first"))


def affected_facts(spark, sf_dir):
    """Facts that a change of namespaces touches: what lies beneath each, by an equi-join on exploded ancestors."""
    symbol = F.concat(F.lit("py:cat.b"), F.regexp_replace("brand", "[^0-9]", ""), F.lit(".s"), F.col("size"), F.lit(".p"), F.col("k"))
    rows = _part(spark, sf_dir).select("k", "size", symbol.alias("symbol_key"))
    changed = rows.where("size <= 5").select(F.regexp_replace("symbol_key", r"\.p[0-9]+$", "").alias("namespace")).distinct()
    beneath = rows.select("k", F.explode(S.ancestors(F.col("symbol_key"))).alias("namespace")).join(changed, "namespace", "left_semi")
    return beneath.select("k").distinct()


def projection_path(spark, sf_dir):
    """The path of a projected claim: the symbol's own, else that of the first ancestor that has one."""
    k = F.col("k")
    chain = F.array(F.when(k % 3 != 0, F.concat(F.lit("own"), k)), F.when(k % 5 != 0, F.concat(F.lit("class"), k)), F.when(k % 7 != 0, F.concat(F.lit("module"), k)))
    return _part(spark, sf_dir).select("k", F.get(F.filter(chain, lambda p: p.isNotNull()), F.lit(0)).alias("path"))


def findings_and_more(spark, sf_dir):
    """The first findings of each class, and how many more there are."""
    ranked = C.drift(_claims(spark, sf_dir)).withColumn("score", F.round("score", 6)).withColumn("n", F.row_number().over(Window.partitionBy("drift_class").orderBy(F.desc("score"), "fact_key"))).where(F.col("n") <= SHOWN)
    totals = C.drift(_claims(spark, sf_dir)).groupBy("drift_class").agg(F.greatest(F.count("*") - SHOWN, F.lit(0)).alias("more"))
    return ranked.join(F.broadcast(totals), "drift_class").select("drift_class", "n", "fact_key", "more")  # a row for each class


def commits_of_a_run(spark, sf_dir):
    """The first commits of the history, as many as one run takes."""
    return corpora.commits(spark, sf_dir).orderBy("seq").limit(COMMITS).select("seq", "micros")


def value_shapes(spark, sf_dir):
    """Whether a claimed value has the form that its aspect asks for."""
    k, size = F.col("k"), F.col("size").cast("string")
    aspect = F.element_at(F.array(*(F.lit(a) for a in ("exists", "added_in", "param_names", "param.a.default", "param.a.type"))), (k % 5 + 1).cast("int"))
    good = F.when(k % 5 == 0, "true").when(k % 5 == 1, F.concat(size, F.lit(".1"))).when(k % 5 == 2, F.concat(F.lit('["p'), size, F.lit('"]'))).when(k % 5 == 3, size).otherwise("None | int")
    bad = F.when(k % 5 == 0, "yes").when(k % 5 == 1, "latest").when(k % 5 == 2, "p, q").when(k % 5 == 3, F.concat(size, F.lit(".0"))).otherwise("Optional[int]")
    rows = _part(spark, sf_dir).select("k", aspect.alias("aspect"), F.when(k % 2 == 0, good).otherwise(bad).alias("value"))
    v, tail = F.col("value"), F.substring_index("aspect", ".", -1)
    shape = (
        F.when(F.col("aspect").isin("exists", "deprecated") | (tail == "exists"), v.isin("true", "false"))
        .when(F.col("aspect").isin("added_in", "removed_in"), S.canonical_version(v).eqNullSafe(v))
        .when(F.col("aspect") == "param_names", F.from_json(v, "array<string>").isNotNull())
        .when(tail == "default", canonical_literal(v).eqNullSafe(v))
        .when(tail == "type", canonical_type(v).eqNullSafe(v))
    )
    return rows.select("k", "aspect", "value", F.coalesce(shape, F.lit(False)).alias("fits"))


def symbol_fields(spark, sf_dir):
    """What the code states of each symbol that is still there after the last commit, but for its kind."""
    states = events(sources(spark, sf_dir)).where("present is not null")
    last = states.groupBy("symbol_key").agg(F.max_by(F.struct("fields", "present"), "seq").alias("s")).where("s.present")
    return last.select("symbol_key", F.inline("s.fields")).where("aspect <> 'kind'")


def signature_of_claims(spark, sf_dir):
    """Each part's signature from its aspects, or what is wrong with them."""
    k, size = F.col("k"), F.col("size").cast("string")
    pair = lambda a, v: F.struct(F.lit(a).alias("aspect"), v.alias("value"))
    aspects = F.array(
        F.when(k % 5 != 1, pair("param_names", F.lit('["b","a","*rest"]'))), pair("param.a.exists", F.lit("true")), F.when(k % 5 != 2, pair("param.b.exists", F.lit("true"))), pair("param.a.default", size), pair("param.a.type", F.lit("int")),
        F.when(k % 5 == 3, pair("param.a", size)), F.when(k % 5 == 4, pair("param.a.type", F.lit("str"))), F.when(k % 2 == 0, pair("returns.type", F.lit("int"))), F.when(k % 3 == 0, pair("raises.ValueError", F.lit("true"))),
    )
    rows = _part(spark, sf_dir).select(k.cast("string").alias("symbol_key"), F.explode(F.array_compact(aspects)).alias("f")).select("symbol_key", "f.*")
    return signatures(rows).select(F.col("symbol_key").cast("long").alias("k"), "signature", "error")


QUERIES = {
    f.__name__: f
    for f in (fact_parts, claims_on_fact, claims_by_author_paths, facts_about_symbol, ownership_over_time, symbols_by_path, affected_facts, projection_path, findings_and_more, commits_of_a_run, value_shapes, symbol_fields, signature_of_claims)
}
_WRITES = """writes AS (SELECT DISTINCT concat('py:cat.p', l_partkey, '.f') AS symbol_key, concat('src/v', l_suppkey, '.py') AS path, l_orderkey AS seq, CASE l_suppkey % 5 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS rank FROM lineitem)"""
ORACLE_SQL = {
    "fact_parts": f"""WITH {DISTINCT_SQL}, stated AS (SELECT fact_key FROM claim UNION SELECT concat('py:cat.p', p_partkey, '.f#', CASE p_partkey % 3 WHEN 0 THEN 'added_in' WHEN 1 THEN 'raises.E#1' ELSE 'deprecated' END) FROM part)
      SELECT fact_key, fact_key[:strpos(fact_key, '#') - 1] AS symbol_key, fact_key[strpos(fact_key, '#') + 1:] AS aspect, NOT ends_with(fact_key, '#added_in') AS projectable FROM stated""",
    "claims_on_fact": f"""WITH {DISTINCT_SQL} SELECT fact_key, string_agg(said, ', ' ORDER BY later, said) AS shown FROM (SELECT DISTINCT fact_key, author <> 'projector' AS later, concat(CASE author WHEN 'projector' THEN 'code' ELSE author END, '=', value) AS said FROM claim) GROUP BY fact_key""",
    "claims_by_author_paths": f"WITH {DISTINCT_SQL} SELECT fact_key, path, value FROM claim WHERE author = 'docstring' AND path IN (SELECT concat('src/cat/p', p_partkey, '.py') FROM part WHERE p_size <= 10)",
    "facts_about_symbol": f"WITH {DISTINCT_SQL} SELECT string_split(fact_key, '#')[1] AS symbol_key, count(DISTINCT fact_key) AS facts, count(*) AS claims FROM claim GROUP BY 1",
    "ownership_over_time": f"""WITH {_WRITES}, o AS (SELECT *, first_value(path) OVER (PARTITION BY symbol_key, top ORDER BY here DESC, seq, path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS owner FROM (
        SELECT *, rank = top AS here FROM (SELECT *, max(rank) OVER (PARTITION BY symbol_key ORDER BY seq, rank DESC, path ROWS UNBOUNDED PRECEDING) AS top FROM writes)))
      SELECT symbol_key, seq, path, owner, path = owner AS accepted FROM o""",
    "symbols_by_path": f"WITH {_WRITES} SELECT path, count(*) AS symbols, min(symbol_key) AS first FROM (SELECT symbol_key, path FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY rank DESC, seq, path) AS n FROM writes) WHERE n = 1) GROUP BY path",
    "affected_facts": "SELECT DISTINCT a.p_partkey AS k FROM part a JOIN part b ON a.p_size = b.p_size AND regexp_replace(a.p_brand, '[^0-9]', '', 'g') = regexp_replace(b.p_brand, '[^0-9]', '', 'g') WHERE b.p_size <= 5",
    "projection_path": "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN concat('own', p_partkey) WHEN p_partkey % 5 <> 0 THEN concat('class', p_partkey) WHEN p_partkey % 7 <> 0 THEN concat('module', p_partkey) END AS path FROM part",
    "findings_and_more": f"""WITH {SUMMARY_SQL}, n AS (SELECT drift_class, fact_key, row_number() OVER (PARTITION BY drift_class ORDER BY round(score, 6) DESC, fact_key) AS n, count(*) OVER (PARTITION BY drift_class) AS total FROM routed WHERE outcome = 'contradict')
      SELECT drift_class, CAST(n AS INTEGER) AS n, fact_key, greatest(total - {SHOWN}, 0) AS more FROM n WHERE n <= {SHOWN}""",
    "commits_of_a_run": f"SELECT o_orderkey AS seq, epoch_us(o_orderdate) AS micros FROM orders ORDER BY o_orderkey LIMIT {COMMITS}",
    "value_shapes": """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'exists' WHEN 1 THEN 'added_in' WHEN 2 THEN 'param_names' WHEN 3 THEN 'param.a.default' ELSE 'param.a.type' END AS aspect, CASE WHEN p_partkey % 2 = 0
        THEN CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN concat(p_size, '.1') WHEN 2 THEN concat('["p', p_size, '"]') WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE 'None | int' END
        ELSE CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'latest' WHEN 2 THEN 'p, q' WHEN 3 THEN concat(p_size, '.0') ELSE 'Optional[int]' END END AS value, p_partkey % 2 = 0 AS fits FROM part""",
    "symbol_fields": """WITH every AS (SELECT p_partkey AS k, p_size AS size, concat('py:cat.p', p_partkey) AS module FROM part), p AS (SELECT * FROM every WHERE k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0), late AS (SELECT * FROM every WHERE k % 23 = 0 AND k % 19 <> 0)
      SELECT module AS symbol_key, unnest(['exists', 'namespace_closed']) AS aspect, unnest(['true', 'true']) AS value FROM (SELECT module FROM p UNION ALL SELECT module FROM late)
      UNION ALL SELECT concat(module, '.g'), unnest(['exists', 'deprecated', 'param_names']), unnest(['true', 'false', '[]']) FROM late
      UNION ALL SELECT concat(module, '.f'), 'exists', 'true' FROM p UNION ALL SELECT concat(module, '.f'), 'deprecated', 'false' FROM p WHERE k % 13 <> 0
      UNION ALL SELECT concat(module, '.f'), unnest(['param_names', 'param.size.exists', 'param.size.default', 'param.size.type']),
        unnest([CASE WHEN k % 11 = 0 THEN '["size","**kw"]' ELSE '["size"]' END, 'true', CAST(size AS VARCHAR), CASE WHEN k % 5 = 0 THEN 'str' ELSE 'int' END]) FROM p WHERE k % 13 <> 0
      UNION ALL SELECT concat(module, '.opaque'), 'exists', 'true' FROM p WHERE k % 13 = 0
      UNION ALL SELECT concat(module, '.Box'), unnest(['exists', 'namespace_closed', 'deprecated']), unnest(['true', 'true', CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END]) FROM p WHERE k % 4 = 0
      UNION ALL SELECT concat(module, '.Box.__init__'), unnest(['exists', 'deprecated', 'param_names']), unnest(['true', CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END, '[]']) FROM p WHERE k % 4 = 0
      UNION ALL SELECT concat(module, '.Box.size'), 'exists', 'true' FROM p WHERE k % 4 = 0""",
    "signature_of_claims": """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN concat('{"param_names":["b","a","*rest"],"params":{"a":{"default":"', p_size, '","type":"int"}}', CASE WHEN p_partkey % 3 = 0 THEN ',"raises":["ValueError"]' ELSE '' END,
        CASE WHEN p_partkey % 2 = 0 THEN ',"returns":"int"' ELSE '' END, ',"v":1}') END AS signature,
      CASE p_partkey % 5 WHEN 1 THEN 'parameters without names' WHEN 2 THEN 'other parameters than named' WHEN 3 THEN 'unknown aspect' WHEN 4 THEN 'repeated aspect' END AS error FROM part""",
}
