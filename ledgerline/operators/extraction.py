"""Facts of the code and claims of its documentation, from definitions: column expressions, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import DOCSTRING, module_name
from ledgerline.operators.ownership import own_keys, path_events
from ledgerline.scratch import shuffled
from ledgerline.sources.python_source import FORWARDING

#: Decorators that leave a signature as written, that read like attributes, and that can't deprecate.
SAFE = ["staticmethod", "classmethod", "abstractmethod", "property", "getter", "setter", "deleter", "final", "override", "deprecated", "cache", "lru_cache", "cached_property"]
PROPERTIES = ["property", "cached_property", "getter", "setter", "deleter"]
NEUTRAL = ["staticmethod", "classmethod", "abstractmethod", "property", "getter", "setter", "deleter", "final", "override", "cache", "lru_cache", "cached_property", "overload", "dataclass", "total_ordering", "runtime_checkable", "type_check_only"]
_PAIRS = "array<struct<aspect:string,value:string>>"


def _array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _within(names: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(names, _array(allowed))) == 0


def symbols(definitions: DataFrame) -> DataFrame:
    """Analyzed definitions with their ``symbol_key``; private ones go."""
    module = module_name(F.col("path"))
    key = F.concat(F.lit("py:"), module, F.when(F.col("name") != "", F.concat(F.lit("."), "name")).otherwise(""))
    hidden = F.exists(F.split("name", r"\."), lambda p: p.startswith("_") & ~p.rlike("^__.*__$"))
    return definitions.where("analyzed").where(module.isNotNull()).withColumn("symbol_key", key).where(~hidden)


def fact_pairs() -> Column:
    """All provable facts of a definition as pairs of aspect and value; of an ambiguous or bound name only that it exists and its kind."""
    plain = F.col("kind").isin("ambiguous", "attribute")
    trusted = F.col("names").isNotNull() & _within(F.col("decorators"), [*SAFE, FORWARDING]) & (F.size(F.array_intersect("decorators", _array(PROPERTIES))) == 0)
    noticed = F.array_contains("decorators", "deprecated") | F.coalesce("leading_notice", F.lit(False))
    clean = _within(F.col("decorators"), NEUTRAL) & (F.coalesce("notices", F.lit(0)) == 0)
    pair = lambda a, v: F.struct((F.lit(a) if isinstance(a, str) else a).alias("aspect"), v.alias("value"))
    none = F.array().cast(_PAIRS)
    params = F.filter(F.arrays_zip("names", "defaults", "types"), lambda p: ~p["names"].startswith("*"))
    facet = lambda part, v: F.transform(params, lambda p: pair(F.concat(F.lit("param."), p["names"], F.lit(f".{part}")), v(p)))
    listed = F.concat(F.lit("["), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ","), F.lit("]"))
    facts = F.concat(
        F.array(pair("exists", F.lit("true")), pair("kind", F.col("kind"))),
        F.array(pair("namespace_closed", F.when(F.col("kind").isin("module", "class"), F.col("closed").cast("string")))),
        F.array(pair("deprecated", F.when(~plain & (F.col("kind") != "module"), F.when(noticed, "true").when(clean, "false")))),
        F.when(trusted, F.concat(F.array(pair("param_names", listed), pair("returns.type", F.col("returns"))), facet("exists", lambda p: F.lit("true")), facet("default", lambda p: p["defaults"]), facet("type", lambda p: p["types"]))).otherwise(none),
        F.when(trusted, F.transform("raises", lambda e: pair(F.concat(F.lit("raises."), e), F.lit("true")))).otherwise(none),
    )
    return F.array_sort(F.filter(facts, lambda f: f["value"].isNotNull()))


def code_facts(definitions: DataFrame) -> DataFrame:
    """``seq``, ``path``, ``symbol_key``, ``aspect``, ``value`` of every provable fact, a row for each."""
    return symbols(definitions).select("seq", "path", "symbol_key", F.inline(fact_pairs()))


def doc_claims(definitions: DataFrame) -> DataFrame:
    """``seq``, ``path``, ``symbol_key``, ``aspect``, ``value``, ``confidence`` of what docstrings claim, a row for each."""
    return symbols(definitions).select("seq", "path", "symbol_key", F.inline("claims"))


def version_status(definitions: DataFrame, versions: DataFrame) -> DataFrame:
    """``versions`` (``seq``, ``path``) with ``status``: analyzed, unreadable, or deleted where there was nothing to read."""
    known = definitions.groupBy("seq", "path").agg(F.max("analyzed").alias("analyzed"))
    status = F.when(F.col("analyzed").isNull(), "deleted").when(F.col("analyzed"), "analyzed").otherwise("unreadable")
    return versions.select("seq", "path").distinct().join(shuffled(known), ["seq", "path"], "left").select("seq", "path", status.alias("status"))


def symbol_events(definitions: DataFrame, versions: DataFrame) -> DataFrame:
    """What each commit changes of each symbol, one row for each: its state by the path that owns its key, and what its docstrings claim.

    ``versions`` has every ``seq`` and ``path`` that a commit changed; ``definitions`` those that had content. Columns as of
    ``ownership.own_keys``. A version that can't be parsed says nothing: what was there before it stays.
    """
    claims = F.coalesce("claims", F.array().cast("array<struct<aspect:string,value:string,confidence:double>>"))
    said = F.array_sort(F.transform(claims, lambda c: F.struct(c["aspect"].alias("aspect"), c["value"].alias("value"))))
    return own_keys(path_events(symbols(definitions), version_status(definitions, versions)), DOCSTRING, fact_pairs(), said)
