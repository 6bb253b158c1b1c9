"""Queries on keys, anchors, versions, paths, aspects and the projection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.jobs import corpora
from ledgerline.operators import projection as P


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))


def _anchors(spark, sf_dir):
    """Anchors of documents, every ninth one malformed, some by symbol."""
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("n"))
    sha = F.md5(F.col("doc_id").cast("string"))
    bad = F.when(F.col("doc_id") % 9 == 0, F.upper(sha)).otherwise(sha)
    place = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("sym=py:doc.d"), F.col("doc_id"))).otherwise(F.concat(F.lit("L1-L"), F.col("n") + 1))
    return d.select("doc_id", F.concat(F.lit("repo://"), "source", F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("@"), bad, F.lit("/doc/"), "doc_id", F.lit(".md#"), place).alias("uri"))


def anchor_parse(spark, sf_dir):
    names = ("scheme", "owner", "repo", "sha", "path", "first_line", "last_line", "symbol")
    return _anchors(spark, sf_dir).select("doc_id", *(S.anchor_part(F.col("uri"), i).alias(n) for i, n in enumerate(names, 1)))


def anchor_render(spark, sf_dir):
    parsed = anchor_parse(spark, sf_dir).where("sha is not null")
    return parsed.select("doc_id", S.render_anchor(*(F.col(c) for c in ("scheme", "owner", "repo", "sha", "path", "first_line", "last_line", "symbol"))).alias("uri"))


def module_names(spark, sf_dir):
    k = F.col("k").cast("string")
    path = F.when(F.col("k") % 5 == 0, F.concat(F.lit("lib/src/cat/p"), k, F.lit("/__init__.py"))).when(F.col("k") % 5 == 1, F.concat(F.lit("src/cat/"), k, F.lit(".py"))).when(F.col("k") % 5 == 2, F.concat(F.lit("docs/p"), k, F.lit(".md"))).when(F.col("k") % 5 == 3, F.concat(F.lit("cat/p"), k, F.lit(".py"))).otherwise(F.concat(F.lit("src/a/src/p"), k, F.lit(".py")))
    return _parts(spark, sf_dir).select("k", path.alias("path"), S.module_name(path).alias("module"))


def path_filter(spark, sf_dir):
    k = F.col("k").cast("string")
    path = F.concat(F.when(F.col("k") % 3 == 0, "vendor/deep/").when(F.col("k") % 3 == 1, "src/").otherwise("tests/"), F.lit("p"), k, F.when(F.col("k") % 4 == 0, ".py").when(F.col("k") % 4 == 1, ".rst").when(F.col("k") % 4 == 2, ".txt").otherwise(".toml"))
    return _parts(spark, sf_dir).select("k", path.alias("path")).where(S.is_relevant(F.col("path"), ["vendor/*.py", "tests/p1*"]))


def canonical_versions(spark, sf_dir):
    text = F.concat(F.when(F.col("k") % 4 == 0, " v").when(F.col("k") % 4 == 1, "").when(F.col("k") % 4 == 2, "release ").otherwise("v"), F.col("size"), F.lit("."), F.col("k") % 10, F.when(F.col("k") % 3 == 0, "-rc1").when(F.col("k") % 3 == 1, " ").otherwise("+local"))
    return _parts(spark, sf_dir).select("k", text.alias("text"), S.canonical_version(text).alias("version"))


def aspect_templates(spark, sf_dir):
    word = F.concat(F.lit("p"), F.col("k").cast("string"))
    m = F.col("k") % 6
    aspect = F.when(m == 0, "exists").when(m == 1, F.concat(F.lit("param."), word, F.lit(".default"))).when(m == 2, F.concat(F.lit("raises.err."), word)).when(m == 3, F.concat(F.lit("param."), word)).when(m == 4, "deprecated").otherwise(F.concat(F.lit("param."), word, F.lit(".type")))
    return _parts(spark, sf_dir).select("k", aspect.alias("aspect"), S.aspect_template(aspect).alias("template"))


def default_phrases(spark, sf_dir):
    size = F.col("size").cast("string")
    m = F.col("k") % 6
    sentence = (
        F.when(m == 0, F.concat(F.lit("Size of the item. Defaults to "), size, F.lit(".")))
        .when(m == 1, F.concat(F.lit("Size; default: `"), size, F.lit("`, in boxes")))
        .when(m == 2, F.concat(F.lit('Either "default" or '), size))
        .when(m == 3, F.concat(F.lit("Size (default="), size, F.lit(")")))
        .when(m == 4, F.lit("No such phrase here."))
        .otherwise(F.concat(F.lit("The Default is '"), size, F.lit("' boxes")))
    )
    return _parts(spark, sf_dir).select("k", S.default_phrase(sentence).alias("value"))


def _symbols(spark, sf_dir):
    """Dotted keys of four levels from parts: brand, size, part, function."""
    return _parts(spark, sf_dir).select("k", F.concat(F.lit("py:cat.b"), F.regexp_replace("brand", "[^0-9]", ""), F.lit(".s"), F.col("size"), F.lit(".p"), F.col("k")).alias("symbol_key"))


def ancestor_chain(spark, sf_dir):
    return _symbols(spark, sf_dir).select("k", F.posexplode(S.ancestors(F.col("symbol_key"))).alias("place", "ancestor"))


def facts_under_namespace(spark, sf_dir):
    """How many symbols lie under each namespace: an equi-join on exploded ancestors, pre-aggregated."""
    return _symbols(spark, sf_dir).select(F.explode(S.ancestors(F.col("symbol_key"))).alias("namespace")).groupBy("namespace").agg(F.count("*").alias("n"))


def _emissions(spark, sf_dir):
    """Which files emit a part's key in an order, and as what."""
    lines = corpora.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("module", "class", "function", "attribute", "method"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return lines.select(corpora.part_symbol("l_partkey").alias("symbol_key"), F.concat(F.lit("src/v"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), kind.alias("kind"))


def ownership_winner(spark, sf_dir):
    """The file and kind that own a key: the highest rank, then the first path."""
    best = F.min_by(F.struct("path", "kind"), F.struct(-S.kind_rank(F.col("kind")), "path", "kind"))
    return _emissions(spark, sf_dir).groupBy("symbol_key").agg(best.alias("b")).select("symbol_key", "b.path", "b.kind")


def ownership_conflicts(spark, sf_dir):
    """Files that emit a key and don't own it."""
    rows = _emissions(spark, sf_dir).select("symbol_key", "path").distinct()
    return rows.join(ownership_winner(spark, sf_dir).select("symbol_key", F.col("path").alias("owner")), "symbol_key").where("path <> owner").select("symbol_key", "path")


def assemble_fields(spark, sf_dir):
    """Facts of a symbol, a row for each aspect, put together as fields."""
    parts = _parts(spark, sf_dir)
    rows = parts.select("k", F.explode(F.create_map(F.lit("exists"), F.lit("true"), F.lit("kind"), F.when(F.col("k") % 3 == 0, "class").otherwise("function"), F.lit("deprecated"), F.when(F.col("k") % 4 == 0, "true"), F.lit("returns.type"), F.when(F.col("k") % 3 != 0, "int"))).alias("aspect", "value")).where("value is not null")
    pick = lambda a, n: F.max(F.when(F.col("aspect") == a, F.col("value"))).alias(n)
    return rows.groupBy("k").agg(pick("exists", "present"), pick("kind", "kind"), pick("deprecated", "is_deprecated"), pick("returns.type", "returns_type"))


def _names():
    starred = F.when(F.col("k") % 11 == 0, F.array(F.lit("size"), F.lit("**kw"))).when(F.col("k") % 7 == 0, F.array(F.lit("*ghost"))).when(F.col("k") % 5 == 0, F.lit(None)).otherwise(F.array(F.lit("size"), F.lit("unit")))
    return starred


def signature_explode(spark, sf_dir):
    """Signatures as rows of aspect and value."""
    rows = _parts(spark, sf_dir).withColumn("names", _names()).where("names is not null")
    named = rows.select("k", "size", F.explode(F.filter("names", lambda n: ~n.startswith("*"))).alias("p"))
    facts = F.array(F.struct(F.concat(F.lit("param."), "p", F.lit(".exists")).alias("aspect"), F.lit("true").alias("value")), F.struct(F.concat(F.lit("param."), "p", F.lit(".default")).alias("aspect"), F.col("size").cast("string").alias("value")))
    return named.select("k", F.explode(facts).alias("f")).select("k", "f.aspect", "f.value")


def signature_json(spark, sf_dir):
    """The canonical text of a signature: sorted keys, no spaces."""
    names = _names()
    quoted = F.concat(F.lit("["), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ","), F.lit("]"))
    params = F.array_join(F.transform(F.array_sort(F.filter("names", lambda n: ~n.startswith("*"))), lambda n: F.concat(F.lit('"'), n, F.lit('":{"default":"'), F.col("size"), F.lit('"}'))), ",")
    body = F.concat(F.lit('{"param_names":'), quoted, F.when(params != "", F.concat(F.lit(',"params":{'), params, F.lit("}"))).otherwise(""), F.lit(',"v":1}'))
    return _parts(spark, sf_dir).withColumn("names", names).where("names is not null").select("k", body.alias("signature"))


def exists_projection(spark, sf_dir):
    k = F.col("k")
    flag = lambda m: F.when(k % m == 0, F.lit(None)).otherwise(k % 2 == 0)
    chain = F.array(F.struct(F.lit("class").alias("kind"), flag(3).alias("present"), flag(5).alias("closed")), F.struct(F.when(k % 7 == 0, "class").otherwise("module").alias("kind"), F.lit(True).alias("present"), (k % 4 != 1).alias("closed")))
    present = F.when(k % 10 == 0, True).when(k % 10 < 8, False)
    return _parts(spark, sf_dir).select("k", P.exists_value(present, k % 10 == 9, chain).alias("value"))


def deprecated_projection(spark, sf_dir):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "function").when(k % 4 == 1, "class").when(k % 4 == 2, "module").otherwise("method")
    return _parts(spark, sf_dir).select("k", P.deprecated_value(k % 9 != 0, kind, F.when(k % 5 != 0, k % 2 == 0)).alias("value"))


def param_projection(spark, sf_dir):
    names = _names()
    return _parts(spark, sf_dir).select("k", *(P.param_exists_value(names, F.lit(p)).alias(p) for p in ("size", "ghost", "other")))


def default_sentinel(spark, sf_dir):
    """Where a code default of None withholds a documented default."""
    k = F.col("k")
    code = F.when(k % 3 == 0, "None").otherwise(F.col("size").cast("string"))
    documented = F.array(F.when(k % 4 == 0, "None").otherwise(F.col("size").cast("string")), F.lit("None"))
    return _parts(spark, sf_dir).select("k", P.default_withheld(code, documented).alias("withheld"))


QUERIES = {
    f.__name__: f
    for f in (
        anchor_parse, anchor_render, module_names, path_filter, canonical_versions, aspect_templates, default_phrases, ancestor_chain, facts_under_namespace,
        ownership_winner, ownership_conflicts, assemble_fields, signature_explode, signature_json, exists_projection, deprecated_projection, param_projection, default_sentinel,
    )
}
_ANCHORS = """anchors AS (SELECT doc_id, concat('repo://', source, '/', coalesce(lang, 'xx'), '@', CASE WHEN doc_id % 9 = 0 THEN upper(md5(CAST(doc_id AS VARCHAR))) ELSE md5(CAST(doc_id AS VARCHAR)) END,
  '/doc/', doc_id, '.md#', CASE WHEN doc_id % 5 = 0 THEN concat('sym=py:doc.d', doc_id) ELSE concat('L1-L', n_chars + 1) END) AS uri FROM documents)"""
_RX = "^(repo|wiki)://([^/]+)/([^@]+)@([0-9a-f]{7,40})/([^#]+)#(?:L([0-9]+)-L([0-9]+)|sym=(.+))$"
_SYMBOLS = "symbols AS (SELECT p_partkey AS k, concat('py:cat.b', regexp_replace(p_brand, '[^0-9]', '', 'g'), '.s', p_size, '.p', p_partkey) AS symbol_key FROM part)"
_CHAIN = _SYMBOLS + ", parts AS (SELECT k, string_split(symbol_key, '.') AS x FROM symbols), chain AS (SELECT k, unnest(range(1, len(x))) AS n, x FROM parts)"
_EMITTED = "emitted AS (SELECT concat('py:cat.p', l_partkey, '.f') AS symbol_key, concat('src/v', l_suppkey, '.py') AS path, CASE l_linenumber % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'class' WHEN 2 THEN 'function' WHEN 3 THEN 'attribute' ELSE 'method' END AS kind, CASE l_linenumber % 5 WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS rank FROM lineitem), winner AS (SELECT symbol_key, path, kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key ORDER BY rank DESC, path, kind) AS n FROM emitted) WHERE n = 1)"
_NAMES = "CASE WHEN p_partkey % 11 = 0 THEN ['size', '**kw'] WHEN p_partkey % 7 = 0 THEN ['*ghost'] WHEN p_partkey % 5 = 0 THEN NULL ELSE ['size', 'unit'] END"
_SIGNED = f"signed AS (SELECT p_partkey AS k, p_size AS size, {_NAMES} AS names FROM part), named AS (SELECT k, size, unnest(list_filter(names, lambda n: NOT starts_with(n, '*'))) AS p FROM signed)"
ORACLE_SQL = {
    "anchor_parse": f"WITH {_ANCHORS} SELECT doc_id, " + ", ".join(f"nullif(regexp_extract(uri, '{_RX}', {i}), '') AS {n}" for i, n in enumerate(("scheme", "owner", "repo", "sha", "path", "first_line", "last_line", "symbol"), 1)) + " FROM anchors",
    "anchor_render": f"WITH {_ANCHORS} SELECT doc_id, uri FROM anchors WHERE doc_id % 9 <> 0 OR regexp_matches(uri, '{_RX}')",
    "module_names": """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN concat('lib/src/cat/p', p_partkey, '/__init__.py') WHEN 1 THEN concat('src/cat/', p_partkey, '.py') WHEN 2 THEN concat('docs/p', p_partkey, '.md') WHEN 3 THEN concat('cat/p', p_partkey, '.py') ELSE concat('src/a/src/p', p_partkey, '.py') END AS path,
      CASE p_partkey % 5 WHEN 0 THEN concat('cat.p', p_partkey) WHEN 3 THEN concat('cat.p', p_partkey) WHEN 4 THEN concat('a.src.p', p_partkey) END AS module FROM part""",
    "path_filter": """SELECT k, path FROM (SELECT p_partkey AS k, concat(CASE p_partkey % 3 WHEN 0 THEN 'vendor/deep/' WHEN 1 THEN 'src/' ELSE 'tests/' END, 'p', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rst' WHEN 2 THEN '.txt' ELSE '.toml' END) AS path FROM part)
      WHERE NOT ends_with(path, '.txt') AND NOT (starts_with(path, 'vendor/') AND ends_with(path, '.py')) AND NOT starts_with(path, 'tests/p1')""",
    "canonical_versions": """SELECT k, text, CASE WHEN k % 4 <> 2 THEN concat(p_size, '.', k % 10, CASE k % 3 WHEN 0 THEN '-rc1' WHEN 1 THEN '' ELSE '+local' END) END AS version FROM (SELECT p_partkey AS k, p_size,
      concat(CASE p_partkey % 4 WHEN 0 THEN ' v' WHEN 1 THEN '' WHEN 2 THEN 'release ' ELSE 'v' END, p_size, '.', p_partkey % 10, CASE p_partkey % 3 WHEN 0 THEN '-rc1' WHEN 1 THEN ' ' ELSE '+local' END) AS text FROM part)""",
    "aspect_templates": """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'exists' WHEN 1 THEN concat('param.p', p_partkey, '.default') WHEN 2 THEN concat('raises.err.p', p_partkey) WHEN 3 THEN concat('param.p', p_partkey) WHEN 4 THEN 'deprecated' ELSE concat('param.p', p_partkey, '.type') END AS aspect,
      CASE p_partkey % 6 WHEN 0 THEN 'exists' WHEN 1 THEN 'param.<p>.default' WHEN 2 THEN 'raises.<Exc>' WHEN 4 THEN 'deprecated' WHEN 5 THEN 'param.<p>.type' END AS template FROM part""",
    "default_phrases": "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN concat('''', p_size, '''') ELSE CAST(p_size AS VARCHAR) END AS value FROM part",
    "ancestor_chain": f"WITH {_CHAIN} SELECT k, CAST(len(x) - 1 - n AS INTEGER) AS place, array_to_string(x[1:n], '.') AS ancestor FROM chain",
    "facts_under_namespace": f"WITH {_CHAIN} SELECT array_to_string(x[1:n], '.') AS namespace, count(*) AS n FROM chain GROUP BY 1",
    "ownership_winner": f"WITH {_EMITTED} SELECT * FROM winner",
    "ownership_conflicts": f"WITH {_EMITTED} SELECT DISTINCT e.symbol_key, e.path FROM emitted e JOIN winner w ON e.symbol_key = w.symbol_key WHERE e.path <> w.path",
    "assemble_fields": "SELECT p_partkey AS k, 'true' AS present, CASE WHEN p_partkey % 3 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'true' END AS is_deprecated, CASE WHEN p_partkey % 3 <> 0 THEN 'int' END AS returns_type FROM part",
    "signature_explode": f"WITH {_SIGNED} SELECT k, concat('param.', p, '.exists') AS aspect, 'true' AS value FROM named UNION ALL SELECT k, concat('param.', p, '.default'), CAST(size AS VARCHAR) FROM named",
    "signature_json": """SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN concat('{"param_names":["size","**kw"],"params":{"size":{"default":"', p_size, '"}},"v":1}') WHEN p_partkey % 7 = 0 THEN '{"param_names":["*ghost"],"v":1}'
      ELSE concat('{"param_names":["size","unit"],"params":{"size":{"default":"', p_size, '"},"unit":{"default":"', p_size, '"}},"v":1}') END AS signature FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 <> 0""",
    "exists_projection": """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'true' WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 7 <> 0 AND p_partkey % 4 <> 1 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'false' END AS value FROM part""",
    "deprecated_projection": "SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 4 <> 2 AND p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM part",
    "param_projection": f"""WITH n AS (SELECT p_partkey AS k, {_NAMES} AS names FROM part) SELECT k, CASE WHEN names IS NULL THEN NULL WHEN list_contains(names, 'size') THEN 'true' END AS size,
      CASE WHEN names IS NULL THEN NULL WHEN list_contains(names, '*ghost') THEN 'true' WHEN list_contains(names, '**kw') THEN NULL ELSE 'false' END AS ghost,
      CASE WHEN names IS NULL OR list_contains(names, '**kw') OR list_contains(names, '*ghost') THEN NULL ELSE 'false' END AS other FROM n""",
    "default_sentinel": "SELECT p_partkey AS k, p_partkey % 3 = 0 AND p_partkey % 4 <> 0 AS withheld FROM part",
}
