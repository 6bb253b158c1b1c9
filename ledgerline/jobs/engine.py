"""Extraction and reconciliation of source files, end to end, over a module for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import types as Ty
from ledgerline.jobs import corpora
from ledgerline.operators.extraction import code_facts, doc_claims, symbol_events, symbols
from ledgerline.operators.ownership import path_events
from ledgerline.operators.resolution import document_claims, import_edges, resolve
from ledgerline.operators.slots import fold_slots
from ledgerline.scratch import shuffled, written
from ledgerline.sources.markup import document_author, read_references
from ledgerline.sources.python_source import read_definitions


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part over three commits, in three docstring styles; null content: the path is deleted.

    The second commit has every seventh module again, with its documentation
    corrected where the number is even. The third deletes some modules and
    writes others anew without what they had. Every fourth module also has a class that its docstring calls deprecated.
    """
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    at = lambda rows, seq: rows.withColumn("seq", F.lit(seq).cast("long"))
    rows = at(part, 1).union(at(part.where("k % 7 = 0"), 2)).union(at(part.where("k % 19 = 0 or k % 23 = 0"), 3))
    k, size = F.col("k"), F.col("size").cast("string")
    wrong = (k % 7 == 0) & ~((F.col("seq") == 2) & (k % 14 == 0))
    documented = F.when(wrong, F.col("size") + 1).otherwise(F.col("size")).cast("string")
    ghost = lambda text: F.when(k % 11 == 0, text).otherwise("")
    google = F.concat(F.lit("    Args:\n        size (int): Size of the item. Defaults to "), documented, F.lit(".\n"), ghost("        ghost: An undeclared option.\n"))
    numpy = F.concat(F.lit("    Parameters\n    ----------\n    size : int\n        Size of the item.\n        Defaults to "), documented, F.lit(".\n"), ghost("    ghost\n        An undeclared option.\n"))
    sphinx = F.concat(F.lit("    :param size: Size of the item.\n        Defaults to "), documented, F.lit(".\n    :type size: int\n"), ghost("    :param ghost: An undeclared option.\n"))
    box = F.concat(
        F.lit('\n\nclass Box:\n    """A box.\n\n    .. deprecated:: 2.0\n       Use f.\n    """\n\n    def __init__(self):\n        import warnings\n'),
        F.when(k % 8 == 0, '        warnings.warn("no longer kept", DeprecationWarning)\n').otherwise(""), F.lit("        self.size = "), size, F.lit("\n"),
    )
    good = F.concat(
        F.when(k % 13 == 0, "from vendor import opaque\n\n\n@opaque\n").otherwise(""),
        F.lit("def f(size: "), F.when(k % 5 == 0, "str").otherwise("int"), F.lit(" = "), size, F.when(k % 11 == 0, ", **kw").otherwise(""),
        F.lit('):\n    """Return the shelf size.\n\n'), F.when(k % 3 == 0, google).when(k % 3 == 1, numpy).otherwise(sphinx),
        F.lit('    """\n    return size\n'), F.when(k % 4 == 0, box).otherwise(""),
    )
    third = F.when(k % 19 != 0, "def g():\n    pass\n")
    content = F.when(F.col("seq") == 3, third).when(k % 17 == 0, F.lit("def f(:\n")).otherwise(good)
    return rows.select("seq", corpora.part_path("k").alias("path"), content.alias("content"))


def extract_code_facts(spark, sf_dir):
    return code_facts(read_definitions(sources(spark, sf_dir))).select("seq", "path", "symbol_key", "aspect", "value")


def extract_doc_claims(spark, sf_dir):
    return doc_claims(read_definitions(sources(spark, sf_dir))).select("seq", "path", "symbol_key", "aspect", "value", "confidence")


def events(files: DataFrame) -> DataFrame:
    """What each commit changes of each symbol, from files (``seq``, ``path``, ``content``, null where deleted).

    Contents are parsed where they lie, equal ones once in a worker, so that only definitions are dealt out.
    """
    found = written(read_definitions(files.where("content is not null")), "definitions")
    return symbol_events(found, files.select("seq", "path"))


def document_events(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """What pages of ``files`` claim of symbols, by commit: all that a page states once it is written, nothing more once it is gone or silent."""
    pages = files.withColumn("author", document_author(F.col("path"))).where("author is not null")
    references = written(read_references(pages), "references")
    resolved = resolve(references, symbols(definitions).select("symbol_key"), import_edges(definitions))
    there = written(document_claims(references, written(resolved, "resolved")), "document-claims")
    status = F.when(F.col("content").isNull(), "deleted").otherwise("analyzed")
    all_ = path_events(there.drop("author").withColumn("kind", F.lit(None).cast("string")), pages.select("seq", "path", status.alias("status")))
    none = F.array().cast("array<struct<aspect:string,value:string>>")
    return all_.select("symbol_key", "seq", document_author(F.col("path")).alias("author"), "path", F.coalesce("claims", none).alias("claims"))


def reconcile(files: DataFrame) -> DataFrame:
    """Slots of code, docstrings and documents after all commits of ``files`` (``seq``, ``path``, ``content``, null where deleted)."""
    code = files.where(F.col("path").endswith(".py"))
    found = written(read_definitions(code.where("content is not null")), "definitions")
    return fold_slots(symbol_events(found, code.select("seq", "path")), claims=document_events(files, found))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each order that changes the modules of its parts, or deletes those that were returned.

    The default in the code moves from commit to commit. Documentation follows, but in every seventh module, where it never does.
    """
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    lines = corpora.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("k")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("gone"))
    code = F.col("size") + F.col("seq") % 3
    documented = F.when(F.col("k") % 7 == 0, F.col("size") + 5).otherwise(code)
    content = F.concat(F.lit("def f(size: int = "), code.cast("string"), F.lit('):\n    """F.\n\n    Args:\n        size (int): Size. Defaults to '), documented.cast("string"), F.lit('.\n    """\n'))
    return lines.join(shuffled(part), "k").select("seq", corpora.part_path("k").alias("path"), F.when(F.col("gone") == 0, content).alias("content"))


def ingest_history(spark, sf_dir):
    """From a long history of changes and deletions to the slots it leaves."""
    return fold_slots(events(history(spark, sf_dir))).select("symbol_key", "aspect", "outcome", "code_value", "doc_value", "opened_seq")


def drift_end_to_end(spark, sf_dir):
    """Sources to slots: definitions, facts and claims, removals, then the fold of each symbol's commits."""
    return fold_slots(events(sources(spark, sf_dir)))


def dispute_resolution(spark, sf_dir):
    """As end to end, with the disputed defaults of every third part resolved for the code."""
    part = corpora.table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    after = F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1).cast("long")
    resolved = part.select(corpora.part_symbol("p_partkey").alias("symbol_key"), after.alias("seq"), F.lit("param.size.default").alias("aspect"), F.col("p_size").cast("string").alias("value"))
    return fold_slots(events(sources(spark, sf_dir)), resolved).where("aspect = 'param.size.default'")


def removal_events(spark, sf_dir):
    """Symbols that a commit removes: what a path's next readable version lacks, or what goes with the path."""
    return events(sources(spark, sf_dir)).where("not present").select("symbol_key", "seq", "path")


def drift_totals(spark, sf_dir):
    return drift_end_to_end(spark, sf_dir).groupBy("aspect", "outcome").agg(F.count("*").alias("n"))


#: Pairs of a code's type and a documented one, and whether they provably differ.
TYPE_PAIRS = (
    ("int", "int", False), ("int", "str", True), ("int", "float", False), ("int | None", "int", True), ("list[int]", "Sequence[int]", False), ("list[int]", "list[str]", True),
    ("list", "list[int]", False), ("Path", "str", False), ("Literal['a', 'b']", "str", False), ("dict", "Mapping", False), ("bool", "int", False), ("object", "int", False), ("int", "Any", False), ("str", "bytes", True),
)


def type_provable(spark, sf_dir):
    """The pairs, a row for each part, judged once for each distinct pair."""
    pairs = spark.createDataFrame([(i, c, d) for i, (c, d, _) in enumerate(TYPE_PAIRS)], "n long, code string, doc string")
    judged = pairs.withColumn("differs", Ty.provable_difference("code", "doc", F.lit(False)))
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % len(TYPE_PAIRS)).alias("n"))
    return part.join(F.broadcast(judged), "n").select("k", "code", "doc", "differs")


#: Names that are neither above nor below each other.
UNRELATED = ("bytes", "dict", "list", "set")


def type_unions(spark, sf_dir):
    """Unions of unrelated names, with and without None, as parts' sizes and keys pick them: judged once for each distinct pair."""

    def union(n, none):
        names = F.array_compact(F.array(F.when(none, "None"), *(F.when(F.getbit(n, F.lit(i)) == 1, x) for i, x in enumerate(UNRELATED))))
        return F.array_join(names, " | ")

    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    code, doc = union(1 + F.col("size") % 15, F.col("size") > 25), union(1 + F.col("k") % 15, F.col("k") % 4 == 0)
    rows = part.select("k", code.alias("code"), doc.alias("doc"))
    judged = rows.select("code", "doc").distinct().withColumn("differs", Ty.provable_difference("code", "doc", F.lit(False)))
    return rows.join(judged, ["code", "doc"]).select("k", "code", "doc", "differs")


#: Types as written and their canonical text.
TYPES = (("Optional[int]", "None | int"), ("typing.List[str]", "list[str]"), ("Union[str, int, str]", "int | str"), ("int|None", "None | int"), ("Dict[str, 'List[int]']", "dict[str, list[int]]"), ("Literal['b', 'a']", "Literal['b', 'a']"), ("a list  of ints", "a list of ints"))


def canonical_types(spark, sf_dir):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TYPES)], "n long, written string").withColumn("canonical", Ty.canonical_type("written"))
    part = corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % len(TYPES)).alias("n"))
    return part.join(F.broadcast(rows), "n").select("k", "written", "canonical")


def canonical_literals(spark, sf_dir):
    """Sizes written as floats, texts and other things, canonical once for each distinct text."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    written = F.when(k % 4 == 0, F.concat(size, F.lit(".0"))).when(k % 4 == 1, F.concat(F.lit('"'), size, F.lit('"'))).when(k % 4 == 2, F.concat(size, F.lit(".5"))).otherwise(F.concat(F.lit("f("), size, F.lit(")")))
    rows = corpora.table(spark, sf_dir, "part").select(k.alias("k"), written.alias("written"))
    texts = rows.select("written").distinct().withColumn("canonical", Ty.canonical_literal("written"))
    return rows.join(texts, "written").select("k", "written", "canonical")


QUERIES = {f.__name__: f for f in (extract_code_facts, extract_doc_claims, drift_end_to_end, dispute_resolution, removal_events, ingest_history, drift_totals, type_provable, type_unions, canonical_types, canonical_literals)}
_P = """every AS (SELECT p_partkey AS k, p_size AS size, concat('src/cat/p', p_partkey, '.py') AS path, concat('py:cat.p', p_partkey) AS module, concat('py:cat.p', p_partkey, '.f') AS symbol_key FROM part),
p AS (SELECT *, 1 AS seq FROM every WHERE k % 17 <> 0 UNION ALL SELECT *, 2 FROM every WHERE k % 17 <> 0 AND k % 7 = 0),
late AS (SELECT * FROM every WHERE k % 23 = 0 AND k % 19 <> 0)"""
_SLOTS = """every AS (SELECT p_partkey AS k, p_size AS size, concat('py:cat.p', p_partkey) AS module, p_partkey % 19 = 0 OR p_partkey % 23 = 0 AS gone FROM part WHERE p_partkey % 17 <> 0),
p AS (SELECT *, concat(module, '.f') AS symbol_key FROM every),
latest AS (
  SELECT symbol_key, gone, 'param.size.default' AS aspect, CASE WHEN k % 13 = 0 THEN 'abstain' WHEN k % 7 = 0 THEN 'contradict' ELSE 'corroborate' END AS outcome,
    CASE WHEN k % 13 <> 0 THEN CAST(size AS VARCHAR) END AS code_value, CAST(CASE WHEN k % 13 = 0 AND k % 14 = 0 THEN size WHEN k % 7 = 0 THEN size + 1 ELSE size END AS VARCHAR) AS doc_value,
    CASE WHEN k % 13 <> 0 AND k % 7 = 0 THEN 1 END AS opened_seq, CASE WHEN k % 13 <> 0 AND k % 14 = 0 THEN 1 ELSE 0 END AS deferred FROM p
  UNION ALL SELECT symbol_key, gone, 'param.size.type', CASE WHEN k % 13 = 0 THEN 'abstain' WHEN k % 5 = 0 THEN 'contradict' ELSE 'corroborate' END, CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'str' ELSE 'int' END END, 'int',
    CASE WHEN k % 13 <> 0 AND k % 5 = 0 THEN 1 END, 0 FROM p
  UNION ALL SELECT symbol_key, gone, 'param.size.exists', CASE WHEN k % 13 = 0 THEN 'abstain' ELSE 'corroborate' END, CASE WHEN k % 13 <> 0 THEN 'true' END, 'true', NULL, 0 FROM p
  UNION ALL SELECT symbol_key, gone, 'param.ghost.exists', 'abstain', NULL, 'true', NULL, 0 FROM p WHERE k % 11 = 0
  UNION ALL SELECT concat(module, '.Box'), gone, 'deprecated', CASE WHEN k % 8 = 0 THEN 'corroborate' ELSE 'contradict' END, CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END, 'true', CASE WHEN k % 8 <> 0 THEN 1 END, 0 FROM p WHERE k % 4 = 0),
slots AS (SELECT symbol_key, gone, aspect, outcome, code_value, doc_value, opened_seq, deferred + CASE WHEN gone THEN 2 ELSE 0 END AS deferred FROM latest WHERE NOT gone OR outcome = 'contradict')"""
ORACLE_SQL = {
    "extract_code_facts": f"""WITH {_P} SELECT CAST(seq AS BIGINT) AS seq, path, symbol_key, aspect, value FROM (
      SELECT seq, path, module AS symbol_key, unnest(['exists', 'kind', 'namespace_closed']) AS aspect, unnest(['true', 'module', 'true']) AS value FROM p
      UNION ALL SELECT seq, path, symbol_key, unnest(['exists', 'kind']), unnest(['true', 'function']) FROM p
      UNION ALL SELECT seq, path, symbol_key, 'deprecated', 'false' FROM p WHERE k % 13 <> 0
      UNION ALL SELECT seq, path, symbol_key, unnest(['param_names', 'param.size.exists', 'param.size.default', 'param.size.type']),
        unnest([CASE WHEN k % 11 = 0 THEN '["size","**kw"]' ELSE '["size"]' END, 'true', CAST(size AS VARCHAR), CASE WHEN k % 5 = 0 THEN 'str' ELSE 'int' END]) FROM p WHERE k % 13 <> 0
      UNION ALL SELECT seq, path, concat(module, '.opaque'), unnest(['exists', 'kind']), unnest(['true', 'attribute']) FROM p WHERE k % 13 = 0
      UNION ALL SELECT seq, path, concat(module, '.Box'), unnest(['exists', 'kind', 'namespace_closed', 'deprecated']), unnest(['true', 'class', 'true', CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END]) FROM p WHERE k % 4 = 0
      UNION ALL SELECT seq, path, concat(module, '.Box.__init__'), unnest(['exists', 'kind', 'deprecated', 'param_names']), unnest(['true', 'method', CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END, '[]']) FROM p WHERE k % 4 = 0
      UNION ALL SELECT seq, path, concat(module, '.Box.size'), unnest(['exists', 'kind']), unnest(['true', 'attribute']) FROM p WHERE k % 4 = 0
      UNION ALL SELECT 3, path, module, unnest(['exists', 'kind', 'namespace_closed']), unnest(['true', 'module', 'true']) FROM late
      UNION ALL SELECT 3, path, concat(module, '.g'), unnest(['exists', 'kind', 'deprecated', 'param_names']), unnest(['true', 'function', 'false', '[]']) FROM late)""",
    "extract_doc_claims": f"""WITH {_P} SELECT CAST(seq AS BIGINT) AS seq, path, symbol_key, unnest(['param.size.exists', 'param.size.type', 'param.size.default']) AS aspect,
        unnest(['true', 'int', CAST(CASE WHEN k % 7 = 0 AND NOT (seq = 2 AND k % 14 = 0) THEN size + 1 ELSE size END AS VARCHAR)]) AS value, unnest([0.95e0, 0.95e0, 0.7e0]) AS confidence FROM p
      UNION ALL SELECT seq, path, symbol_key, 'param.ghost.exists', 'true', 0.95e0 FROM p WHERE k % 11 = 0
      UNION ALL SELECT seq, path, concat(module, '.Box'), 'deprecated', 'true', 0.95e0 FROM p WHERE k % 4 = 0""",
    "drift_end_to_end": f"WITH {_SLOTS} SELECT symbol_key, aspect, outcome, code_value, doc_value, CAST(opened_seq AS BIGINT) AS opened_seq, CAST(deferred AS BIGINT) AS deferred FROM slots",
    "dispute_resolution": f"""WITH {_SLOTS} SELECT symbol_key, aspect, CASE WHEN closed THEN 'undocumented' ELSE outcome END AS outcome, code_value, CASE WHEN NOT closed THEN doc_value END AS doc_value,
      CASE WHEN NOT closed THEN CAST(opened_seq AS BIGINT) END AS opened_seq, CAST(deferred AS BIGINT) AS deferred
      FROM (SELECT *, outcome = 'contradict' AND CAST(regexp_extract(symbol_key, 'p([0-9]+)[.]f', 1) AS BIGINT) % 3 = 0 AS closed FROM slots WHERE aspect = 'param.size.default') WHERE NOT (closed AND gone)""",
    "removal_events": f"""WITH {_P}, had AS (SELECT * FROM every WHERE k % 17 <> 0 AND (k % 19 = 0 OR k % 23 = 0))
      SELECT CAST(3 AS BIGINT) AS seq, path, symbol_key FROM (SELECT path, symbol_key FROM had UNION ALL SELECT path, module FROM had WHERE k % 19 = 0
        UNION ALL SELECT path, concat(module, '.opaque') FROM had WHERE k % 13 = 0 UNION ALL SELECT path, unnest([concat(module, '.Box'), concat(module, '.Box.__init__'), concat(module, '.Box.size')]) FROM had WHERE k % 4 = 0)""",
    "ingest_history": """WITH lines AS (SELECT l_orderkey AS seq, l_partkey AS k, bool_or(l_returnflag = 'R') AS gone FROM lineitem GROUP BY ALL),
      per AS (SELECT k, min(seq) FILTER (NOT gone) AS first, max(seq) AS last, arg_max(gone, seq) AS is_gone FROM lines GROUP BY k),
      p AS (SELECT k, first, last, is_gone, p_size AS size, concat('py:cat.p', k, '.f') AS symbol_key FROM per JOIN part ON k = p_partkey WHERE first IS NOT NULL)
      SELECT symbol_key, 'param.size.default' AS aspect, CASE WHEN k % 7 = 0 THEN 'contradict' ELSE 'corroborate' END AS outcome, CAST(size + CASE WHEN k % 7 = 0 THEN first ELSE last END % 3 AS VARCHAR) AS code_value,
        CAST(CASE WHEN k % 7 = 0 THEN size + 5 ELSE size + last % 3 END AS VARCHAR) AS doc_value, CASE WHEN k % 7 = 0 THEN first END AS opened_seq FROM p WHERE k % 7 = 0 OR NOT is_gone
      UNION ALL SELECT symbol_key, unnest(['param.size.exists', 'param.size.type']), 'corroborate', unnest(['true', 'int']), unnest(['true', 'int']), NULL FROM p WHERE NOT is_gone""",
    "drift_totals": f"WITH {_SLOTS} SELECT aspect, outcome, count(*) AS n FROM slots GROUP BY ALL",
    "type_provable": "SELECT p_partkey AS k, code, doc, differs FROM part JOIN (VALUES "
    + ", ".join("({}, '{}', '{}', {})".format(i, c.replace("'", "''"), d.replace("'", "''"), x) for i, (c, d, x) in enumerate(TYPE_PAIRS))
    + f") v(n, code, doc, differs) ON p_partkey % {len(TYPE_PAIRS)} = n",
    "type_unions": """WITH p AS (SELECT p_partkey AS k, 1 + p_size % 15 AS c, 1 + p_partkey % 15 AS d, p_size > 25 AS nc, p_partkey % 4 = 0 AS nd FROM part),
      w AS (SELECT *, list_filter(['bytes', 'dict', 'list', 'set'], lambda x, i: (c >> (i - 1)) & 1 = 1) AS cs, list_filter(['bytes', 'dict', 'list', 'set'], lambda x, i: (d >> (i - 1)) & 1 = 1) AS ds FROM p)
      SELECT k, array_to_string(CASE WHEN nc THEN list_prepend('None', cs) ELSE cs END, ' | ') AS code, array_to_string(CASE WHEN nd THEN list_prepend('None', ds) ELSE ds END, ' | ') AS doc,
        CASE WHEN d & ~c = 0 THEN nc AND NOT nd ELSE true END AS differs FROM w""",
    "canonical_types": "SELECT p_partkey AS k, written, canonical FROM part JOIN (VALUES " + ", ".join("({}, '{}', '{}')".format(i, a.replace("'", "''"), b.replace("'", "''")) for i, (a, b) in enumerate(TYPES)) + f") v(n, written, canonical) ON p_partkey % {len(TYPES)} = n",
    "canonical_literals": """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '.0') WHEN 1 THEN concat('"', p_size, '"') WHEN 2 THEN concat(p_size, '.5') ELSE concat('f(', p_size, ')') END AS written,
      CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat('''', p_size, '''') WHEN 2 THEN concat(p_size, '.5') END AS canonical FROM part""",
}
