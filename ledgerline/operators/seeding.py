"""Seeded edits of real sources: which functions get which, and what the engine makes of each.

An edit is injected drift (it must be found), a control (nothing may open) or one that the engine is blind to by design. Candidates are
what docstrings and code agree on. Every category gets its number of functions by a seeded order, no function twice, injections first: in
each round every category that lacks some asks for its next functions, a function that several ask for goes to the first of them, and the
edits are tried; what doesn't apply is not asked for again. A round tries as many as are lacking, the next ones of its kind four times
as many for each that is lacking, so that a category that suits hardly anything runs out of candidates after few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.functions.types import provable_difference
from ledgerline.operators.extraction import symbol_events, symbols
from ledgerline.operators.slots import fold_slots
from ledgerline.scratch import shuffled, written
from ledgerline.sources.edits import edit
from ledgerline.sources.python_source import read_definitions

#: The categories of each kind, with the facets of the aspects that they start from (None: any).
INJECTED = {
    "code_default": "default", "code_param_type": "type", "code_return_type": "returns.type", "code_param_renamed": "exists",
    "docs_default": "default", "docs_param_type": "type", "docs_return_type": "returns.type", "docs_param_invented": "exists", "docs_deprecated": "exists",
}
CONTROLS = {
    "comment_added": None, "statement_added": None, "function_added": None, "summary_reworded": None, "undocumented_default_changed": None, "undocumented_type_changed": None,
}
BY_DESIGN = {"raise_removed": "raises"}
KINDS = {**dict.fromkeys(INJECTED, "inject"), **dict.fromkeys(CONTROLS, "control"), **dict.fromkeys(BY_DESIGN, "by_design")}
PROPOSAL = "category string, unit string, symbol_key string, path string, name string, aspect string, value string, claimed array<string>, place long"
EDITED = "category string, unit string, symbol_key string, path string, name string, at string, code string, docs string, before string, after string, ghost string, place long"


def _snapshot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and slots of files (``path``, ``content``) taken as one commit."""
    at = files.select(F.lit(1).cast("long").alias("seq"), "path", "content")
    found = written(read_definitions(at), "definitions")
    return found, written(fold_slots(symbol_events(found, at.select("seq", "path"))), "slots")


def proposals(found: DataFrame, slots: DataFrame, seed: int) -> DataFrame:
    """Every category with every function that it may suit, each in the category's seeded order."""
    there = symbols(found).where("kind in ('function', 'method')").select("symbol_key", "path", "name", F.transform(F.coalesce("claims", F.array().cast("array<struct<aspect:string,value:string,confidence:double>>")), lambda c: c["aspect"]).alias("claimed"))
    agreed = slots.where("outcome = 'corroborate'").select("symbol_key", "aspect", F.col("code_value").alias("value")).join(shuffled(there), "symbol_key")
    facets = {**INJECTED, **CONTROLS, **BY_DESIGN}
    a = F.col("aspect")
    suits = lambda f: F.lit(True) if f is None else a == f if "." in f else a.startswith(f"{f}.") if f == "raises" else a.startswith("param.") & a.endswith(f".{f}")
    rows = agreed.withColumn("category", F.explode(F.array_compact(F.array(*(F.when(suits(f), c) for c, f in facets.items())))))
    unit = F.when(F.col("category") == "function_added", F.concat(F.lit("new "), "path")).otherwise(F.concat("path", F.lit("::"), "name"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "category", "symbol_key", "aspect")), 1, 15), 16, 10).cast("long")
    return rows.select("category", unit.alias("unit"), "symbol_key", "path", "name", "aspect", "value", "claimed", place.alias("place"))


def _tried(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """The edits made; ``after`` is null where one doesn't apply."""
    schema = StructType.fromDDL(EDITED)
    kinds = to_arrow_schema(schema)
    names = ["category", "unit", "symbol_key", "path", "name", "place", "aspect", "value", "claimed", "ghost", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["content"].decode("utf-8", "strict") if isinstance(r["content"], bytes) else r["content"]
                done = edit(text, r["name"], r["category"], r["aspect"], r["value"], set(r["claimed"]), r["ghost"]) or {}
                rows.append({k: r[k] for k in names[:6]} | {"at": done.get("aspect"), "code": done.get("code"), "docs": done.get("docs"), "before": text, "after": done.get("content"), "ghost": r["ghost"]})
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in rows], f.type) for f in kinds], kinds.names)

    ghost = F.concat(F.lit("seeded_"), F.substring(F.md5(F.concat_ws("|", "category", "unit")), 1, 10))
    return chosen.withColumn("ghost", ghost).join(shuffled(files.select("path", "content")), "path").select(*names).mapInArrow(run, schema)


def plan_edits(files: DataFrame, found: DataFrame, slots: DataFrame, per_category: int, seed: int = 0) -> DataFrame:
    """``EDITED`` rows: ``per_category`` edits of each category, or as many as apply; no ``unit`` (a function, or a file's new one) twice."""
    open_ = written(proposals(found, slots, seed), "proposals")
    done, tried, counts = None, None, {}
    for group in (INJECTED, CONTROLS, BY_DESIGN):
        wider = 1
        while needs := {c: per_category - counts.get(c, 0) for c in group if counts.get(c, 0) < per_category}:
            left = open_.where(F.col("category").isin(*needs))
            if done is not None:
                left = left.join(shuffled(done.select("unit")), "unit", "left_anti")
            if tried is not None:
                left = left.join(shuffled(tried), ["category", "unit"], "left_anti")
            left = left.withColumn("n", F.row_number().over(Window.partitionBy("category", "unit").orderBy("place", "aspect"))).where("n = 1")
            need = F.create_map(*(F.lit(x) for kv in needs.items() for x in kv))[F.col("category")]
            asked = left.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("place", "unit"))).where(F.col("n") <= need * wider)
            chosen = written(asked.groupBy("unit").agg(F.min_by(F.struct(*(c for c in asked.columns if c not in ("unit", "n"))), F.struct("n", "category")).alias("p")).select("unit", "p.*"), "chosen")
            if chosen.isEmpty():
                break
            made = written(_tried(chosen, files), "edits")
            fit = made.where("after is not null").withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("place", "unit"))).where(F.col("n") <= need).drop("n")
            fit, wider = written(fit, "edits"), wider * 4
            done = fit if done is None else done.unionByName(fit)
            again = chosen.select("category", "unit")
            tried = again if tried is None else tried.unionByName(again)
            for r in fit.groupBy("category").count().collect():  # a row for each category
                counts[r["category"]] = counts.get(r["category"], 0) + r["count"]
    return files.sparkSession.createDataFrame([], EDITED) if done is None else done


def judge_edits(edits: DataFrame) -> DataFrame:
    """Each edit with its ``verdict`` and how many disputes it opened besides (``extra``).

    Every edit has a history of its own: the file before it, then after it, in a package of the edit's name, all in one run. Found means
    that the aspect's dispute opens with the values expected; what can't be proven to differ is abstained from, not missed.
    """
    edits = written(edits.withColumn("package", F.concat(F.lit("e"), F.md5(F.concat_ws("|", "category", "unit")))), "edits")
    inner = F.regexp_replace("path", "^(?:.*?/)??src/", "")
    steps = F.array(F.struct(F.lit(1).cast("long").alias("seq"), F.col("before").alias("content")), F.struct(F.lit(2).cast("long").alias("seq"), F.col("after").alias("content")))
    files = edits.select(F.concat(F.lit("src/"), "package", F.lit("/"), inner).alias("path"), F.inline(steps))
    found = written(read_definitions(files, "seq"), "definitions")
    slots = fold_slots(symbol_events(found, files.select("seq", "path"))).where("outcome = 'contradict' and opened_seq = 2")
    opened = slots.select(F.regexp_extract("symbol_key", r"^py:([^.]*)", 1).alias("package"), F.regexp_extract("symbol_key", r"^py:[^.]*\.(.*)$", 1).alias("of"), "aspect", "code_value", "doc_value")
    rows = edits.withColumn("expected", F.regexp_replace("symbol_key", "^py:", "")).join(shuffled(opened), "package", "left")
    hit = (F.col("of") == F.col("expected")) & (F.col("aspect") == F.col("at"))
    right = hit & F.col("code_value").eqNullSafe(F.col("code")) & F.array_contains(F.split("doc_value", ","), F.col("docs"))
    per = rows.groupBy("category", "unit", "path", "name", "at", "code", "docs").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"), F.max(F.coalesce(right, F.lit(False))).alias("right"), F.sum((F.col("of").isNotNull() & ~F.coalesce(hit, F.lit(False))).cast("int")).alias("extra"))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("category")]
    sure = per.withColumn("differs", F.when(F.col("at").endswith(".type"), provable_difference(F.coalesce("code", F.lit("")), F.coalesce("docs", F.lit("")), F.lit(False))).when(F.col("at").endswith(".default"), (F.col("code") != "None") | (F.col("docs") == "None")).otherwise(F.lit(True)))
    injected = F.when(F.col("right"), "found").when(F.col("hit"), "found_wrong_values").when(F.col("differs"), "missed").otherwise("abstained")
    quiet = (F.col("extra") == 0) & ~F.col("hit")
    verdict = F.when(kind == "inject", injected).when(kind == "control", F.when(quiet, "clean").otherwise("false_positive")).otherwise(F.when(quiet, "silent").otherwise("surprising"))
    return sure.select("category", kind.alias("kind"), "unit", "path", "name", F.col("at").alias("aspect"), "code", "docs", verdict.alias("verdict"), "extra")


def seeded_edits(files: DataFrame, per_category: int, seed: int = 0) -> DataFrame:
    """Plans, makes and judges edits of ``files`` (``path``, ``content``)."""
    found, slots = _snapshot(files)
    return judge_edits(plan_edits(files, found, slots, per_category, seed))
