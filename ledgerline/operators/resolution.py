"""Which symbols the names in documents mean: through imports and re-exports, and by unambiguous endings.

An import makes an alias of a name elsewhere; aliases of aliases are followed in rounds of joins that double the hops each alias takes, so
chains of any length end after few rounds. Aliases that only lead to each other are dropped: they name nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import ancestors, module_name
from ledgerline.scratch import shuffled, written

#: Segments of a name beyond which an alias only leads around in circles.
DEEPEST = 64
#: Rounds that a name takes over aliases that are followed to their ends already: an alias may end below another one's package.
TURNS = 8
#: Packages up to which they are broadcast; more are shuffled.
FEW_PACKAGES = 4096


def import_edges(definitions: DataFrame) -> DataFrame:
    """``alias`` and ``target`` (symbol keys) of what modules import, as of the last commit that imports the alias.

    ``definitions`` as of ``sources.python_source``. An import of what lies below the alias itself (a package that lifts a name out of a
    module called the same) doesn't make the module an alias.
    """
    module, package = module_name(F.col("path")), F.col("path").endswith("__init__.py")
    rows = definitions.where("analyzed and name = '' and imports is not null").select("seq", module.alias("module"), package.alias("package"), F.explode("imports").alias("i")).where("module is not null")
    parts = F.split("module", r"\.")
    kept = F.size(parts) - F.col("i.level") + F.when(F.col("package"), 1).otherwise(0)
    base = F.when(F.col("i.level") == 0, F.array().cast("array<string>")).when(kept > 0, F.slice(parts, F.lit(1), F.greatest(kept, F.lit(1))))
    target = F.concat(F.lit("py:"), F.array_join(F.array_compact(F.concat(base, F.array("i.module", "i.attr"))), "."))
    edges = rows.select(F.concat(F.lit("py:"), "module", F.lit("."), "i.name").alias("alias"), target.alias("target"), "seq").where("target is not null")
    last = edges.groupBy("alias").agg(F.max_by("target", F.struct("seq", "target")).alias("target"))
    return last.where((F.col("alias") != F.col("target")) & ~F.col("target").startswith(F.concat("alias", F.lit("."))))


def _step(names: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """``names`` with ``then``: the name with its longest aliased beginning replaced by the alias's target; null where there is none."""
    values = names.select(F.col(column).alias("now")).distinct()
    heads = values.select("now", F.posexplode(F.concat(F.array("now"), ancestors(F.col("now")))).alias("place", "alias")).join(shuffled(edges), "alias")
    moved = heads.groupBy("now").agg(F.min_by(F.struct("alias", "target"), "place").alias("e")).select("now", F.concat("e.target", F.expr("substr(now, length(e.alias) + 1)")).alias("then"))
    return names.join(shuffled(moved.withColumnRenamed("now", column)), column, "left")


def _deep(name: Column) -> Column:
    return F.size(F.split(name, r"\.")) > DEEPEST


def followed(edges: DataFrame) -> DataFrame:
    """``edges`` with targets that are no aliases themselves. Aliases of nothing but aliases are dropped."""
    edges = written(edges.select("alias", "target"), "aliases")
    rounds = 2 + math.ceil(math.log2(max(2, edges.count())))
    for _ in range(rounds):
        stepped = written(_step(edges, "target", edges), "aliases")
        if stepped.where("then is not null").isEmpty():
            break
        edges = written(stepped.select("alias", F.coalesce("then", "target").alias("target")).where(~_deep(F.col("target")) & (F.col("alias") != F.col("target"))), "aliases")
    return written(_step(edges, "target", edges).where("then is null").select("alias", "target"), "aliases")


def canonical(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``name`` with ``key``, the name after all aliases in it are followed; ``edges`` as ``followed`` gives them."""
    rows = names.select("name").distinct().withColumn("key", F.col("name"))
    for _ in range(TURNS):
        stepped = written(_step(rows, "key", edges), "names")
        rows = stepped.select("name", F.coalesce("then", "key").alias("key")).where(~_deep(F.col("key")))
        if stepped.where("then is not null").isEmpty():
            return rows
    return written(_step(rows, "key", edges).where("then is null").select("name", "key"), "names")


def resolve(references: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``ref`` with ``symbol_key`` and ``how``: exact, ending, member, missing; ambiguous, hidden and unknown mean no symbol.

    A reference is a known symbol's whole name, else the ending of one symbol's name (several symbols that are one by their imports count
    as one), else a name directly below such an ending, else, if its first segment is one of the packages, a symbol that is missing.
    ``symbols`` (``symbol_key``) are all that the history ever had, so that what was removed is still found; an alias of what isn't among
    them, as of another library, stands for itself. Endings are counted in one
    aggregation over all symbols, of which a reference meets one row.
    """
    edges = written(followed(edges).join(shuffled(symbols.select(F.col("symbol_key").alias("target")).distinct()), "target", "left_semi"), "aliases")
    refs = written(references.select("ref").distinct(), "references")
    whole = refs.select(F.concat(F.lit("py:"), "ref").alias("name"))
    known = symbols.select(F.col("symbol_key").alias("name")).union(edges.select("alias")).distinct()
    keys = written(canonical(known.union(whole), edges), "canonical")
    names = keys.join(shuffled(known), "name", "left_semi")
    segments = F.split(F.substr("name", F.lit(4)), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, -n, n), "."))
    above = F.when(F.col("ref").contains("."), F.regexp_replace("ref", r"\.[^.]*$", ""))
    asked = refs.select(F.col("ref").alias("end")).union(refs.select(above).where(above.isNotNull())).distinct()
    counted = names.select(F.explode(ends).alias("end"), "key").groupBy("end").agg(F.min("key").alias("least"), F.max("key").alias("most")).join(shuffled(asked), "end")
    found = written(counted.select("end", "least", (F.col("least") == F.col("most")).alias("one")), "endings")
    packages = written(known.select(F.regexp_extract("name", r"^py:([^.]*)", 1).alias("first")).distinct(), "packages")
    packages = (F.broadcast if packages.count() <= FEW_PACKAGES else shuffled)(packages.withColumn("package", F.lit(True)))
    exact = names.select(F.substr("name", F.lit(4)).alias("ref"), F.col("key").alias("exact"))
    absent = keys.select(F.substr("name", F.lit(4)).alias("ref"), F.col("key").alias("absent"))
    rows = refs.withColumns({"above": above, "first": F.regexp_extract("ref", r"^[^.]*", 0)}).join(shuffled(exact), "ref", "left").join(shuffled(absent), "ref", "left")
    rows = rows.join(shuffled(found.select(F.col("end").alias("ref"), F.col("least").alias("ending"), "one")), "ref", "left").join(packages, "first", "left")
    rows = rows.join(shuffled(found.select(F.col("end").alias("above"), F.col("least").alias("owner"), F.col("one").alias("owned"))), "above", "left")
    hidden = F.exists(F.split("ref", r"\."), lambda p: p.startswith("_") & ~p.rlike("^__.*__$"))
    how = (
        F.when(hidden, "hidden").when(F.col("exact").isNotNull(), "exact").when(F.col("one"), "ending").when(F.col("one").isNotNull(), "ambiguous")
        .when(F.col("package") & F.col("above").isNotNull(), "missing").when(F.col("owned"), "member").when(F.col("owned").isNotNull(), "ambiguous").otherwise("unknown")
    )
    member = F.concat("owner", F.regexp_extract("ref", r"\.[^.]*$", 0))
    key = F.when(how == "exact", F.col("exact")).when(how == "ending", F.col("ending")).when(how == "missing", F.col("absent")).when(how == "member", member)
    return rows.select("ref", key.alias("symbol_key"), how.alias("how"))


def document_claims(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """``symbol_key``, ``seq``, ``author``, ``path`` and ``claims``: what each page states of each symbol in each commit that has it.

    Of an aspect that a page states with several values, nothing is claimed.
    """
    said = references.join(shuffled(resolved.where("symbol_key is not null")), "ref").groupBy("symbol_key", "seq", "author", "path", "aspect").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    pair = F.struct("aspect", "value")
    agreed = said.where(F.col("value") == F.col("other"))
    return agreed.groupBy("symbol_key", "seq", "author", "path").agg(F.array_sort(F.collect_list(pair)).alias("claims"))  # a page's own claims of one symbol
