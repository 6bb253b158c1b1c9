"""Signatures as rows of aspect and value: whether they make one, and its canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import aspect_template

#: The aspects that a signature is made of.
PARTS = ("param_names", "param.<p>.exists", "param.<p>.default", "param.<p>.type", "returns.type", "raises.<Exc>")


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def signatures(rows: DataFrame) -> DataFrame:
    """``symbol_key``, ``signature`` (canonical text) and ``error`` from ``symbol_key``, ``aspect``, ``value``; one of the two is null.

    An aspect that no signature has, one that is stated twice, a parameter's fact without
    the list of names, and named parameters that aren't those with an exists fact are errors.
    """
    template = aspect_template(F.col("aspect"))
    param = F.nullif(F.regexp_extract("aspect", r"^param\.([^.]+)\.(exists|default|type)$", 1), F.lit(""))
    facet = F.regexp_extract("aspect", r"^param\.([^.]+)\.(exists|default|type)$", 2)
    part = rows.withColumn("known", F.coalesce(template.isin(*PARTS), F.lit(False))).withColumn("param", param).withColumn("facet", facet)
    pick = lambda c, v: F.collect_list(F.when(c, v))  # noqa: E731 - a symbol's own aspects
    per = part.groupBy("symbol_key").agg(
        F.bool_or(~F.col("known")).alias("unknown"),
        (F.count("*") > F.count_distinct("aspect")).alias("twice"),
        F.max(F.when(F.col("aspect") == "param_names", F.col("value"))).alias("names"),
        F.max(F.when(F.col("aspect") == "returns.type", F.col("value"))).alias("returns"),
        F.sort_array(pick(F.col("aspect").startswith("raises."), F.substring("aspect", 8, 1 << 20))).alias("raises"),
        F.sort_array(pick(F.col("facet") == "exists", F.col("param"))).alias("there"),
        F.sort_array(pick(F.col("facet").isin("default", "type"), F.struct("param", "facet", "value"))).alias("facts"),
    )
    listed = F.from_json("names", "array<string>")
    named = F.sort_array(F.filter(listed, lambda n: ~n.startswith("*")))
    error = (
        F.when(F.col("unknown"), "unknown aspect")
        .when(F.col("twice"), "repeated aspect")
        .when(F.col("names").isNull() & ((F.size("there") > 0) | (F.size("facts") > 0)), "parameters without names")
        .when(F.col("names").isNotNull() & listed.isNull(), "malformed names")
        .when(F.col("names").isNotNull() & (named != F.col("there")), "other parameters than named")
    )
    of = lambda p: F.concat(_quoted(p), F.lit(":{"), F.array_join(F.transform(F.filter("facts", lambda f: f["param"] == p), lambda f: F.concat(_quoted(f["facet"]), F.lit(":"), F.to_json(F.array(f["value"])).substr(F.lit(2), F.length(F.to_json(F.array(f["value"]))) - 2))), ","), F.lit("}"))
    owners = F.array_sort(F.array_distinct(F.transform("facts", lambda f: f["param"])))
    text = F.concat(
        F.lit('{"param_names":'), F.coalesce("names", F.lit("[]")),
        F.when(F.size("facts") > 0, F.concat(F.lit(',"params":{'), F.array_join(F.transform(owners, of), ","), F.lit("}"))).otherwise(""),
        F.when(F.size("raises") > 0, F.concat(F.lit(',"raises":'), F.to_json("raises"))).otherwise(""),
        F.coalesce(F.concat(F.lit(',"returns":'), _quoted(F.col("returns"))), F.lit("")), F.lit(',"v":1}'),
    )
    return per.withColumn("error", error).select("symbol_key", F.when(F.col("error").isNull(), text).alias("signature"), "error")
