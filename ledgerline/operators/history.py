"""The superseding layer: windows of values over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_ranged, ranged, running_max_ranged

ORDER = ["at", "tie"]


def windows(facts: DataFrame) -> DataFrame:
    """``valid_from`` and ``valid_to`` of each value of a key; a repeated value opens no window.

    ``facts`` has ``key``, ``value`` (null: withdrawn), ``at`` and ``tie``. One
    shuffle by key serves both window steps. A withdrawn value closes the window
    before it and is none itself.
    """
    per = Window.partitionBy("key").orderBy(*ORDER)
    changed = facts.withColumn("_before", F.lag("value").over(per)).withColumn("_n", F.row_number().over(per))
    changed = changed.where(~F.col("value").eqNullSafe(F.col("_before")) | ((F.col("_n") == 1) & F.col("value").isNotNull()))
    out = changed.withColumn("valid_to", F.lead("at").over(per)).withColumn("supersedes", F.lag("value").over(per))
    return out.where(F.col("value").isNotNull()).select("key", "value", F.col("at").alias("valid_from"), "valid_to", "supersedes", "tie")


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The windows that hold at one time."""
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def as_of_many(history: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` (``key``, ``at``, ``ask_id``), the value that held: a union by key and the last value before."""
    values = history.select("key", F.col("valid_from").alias("at"), F.col("tie"), F.lit(None).cast("long").alias("ask_id"), F.struct("value").alias("v"), F.lit(0).alias("side"))
    times = asked.select("key", "at", F.lit(None).cast("long").alias("tie"), "ask_id", F.lit(None).cast("struct<value:string>").alias("v"), F.lit(1).alias("side"))
    seen = Window.partitionBy("key").orderBy("at", "side", "tie", "ask_id").rowsBetween(Window.unboundedPreceding, 0)
    return values.unionByName(times).withColumn("v", F.last("v", ignorenulls=True).over(seen)).where("side = 1").select("ask_id", "key", "at", F.col("v.value").alias("value"))


def current(facts: DataFrame) -> DataFrame:
    """The last value of each key: one aggregation, no window."""
    return facts.groupBy("key").agg(F.max_by("value", F.struct(*ORDER)).alias("value"), F.max("at").alias("at"))


def clamp_clock(commits: DataFrame, seq: str, micros: str) -> DataFrame:
    """``commits`` with ``clamped``: no commit's time is less than a microsecond after the one before."""
    shifted = number_ranged(ranged(commits, seq), "_rn").withColumn("_shifted", F.col(micros) - F.col("_rn"))
    return running_max_ranged(shifted, "_shifted", "_top").withColumn("clamped", F.col("_top") + F.col("_rn")).drop("_shifted", "_top", "_rn", "_range", "_at")


def out_of_order(facts: DataFrame) -> DataFrame:
    """Rows older than a row of their key that came before them by ``tie``."""
    before = Window.partitionBy("key").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("newest", F.max("at").over(before)).where(F.col("at") < F.col("newest"))


def after(commits: DataFrame, seq: str, stop: int) -> DataFrame:
    """The commits after the one that a run stopped at; one that isn't known is an error."""
    if commits.where(F.col(seq) == stop).isEmpty():
        raise ValueError(f"commit {stop} isn't in the history")
    return commits.where(F.col(seq) > stop)


def bitemporal_windows(facts: DataFrame) -> DataFrame:
    """``windows`` with a second axis: when each was known.

    ``facts`` also has ``known``, when it was asserted. Assertions are recorded in order: one that claims to be older than what its key
    had before counts as known with that. A window is open while the next value isn't known, and known to be closed from then on: a row for
    each, with ``known_from`` and ``known_to`` (null: until now). One shuffle by key serves all steps.
    """
    per = Window.partitionBy("key").orderBy(*ORDER)
    rows = facts.withColumn("_known", F.max("known").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_before", F.lag("value").over(per)).withColumn("_n", F.row_number().over(per))
    rows = rows.where(~F.col("value").eqNullSafe(F.col("_before")) | ((F.col("_n") == 1) & F.col("value").isNotNull()))
    rows = rows.withColumn("_to", F.lead("at").over(per)).withColumn("_closed", F.lead("_known").over(per)).where("value is not null")
    open_ = F.struct(F.lit(None).cast(facts.schema["at"].dataType).alias("valid_to"), F.col("_known").alias("known_from"), F.col("_closed").alias("known_to"))
    closed = F.struct(F.col("_to").alias("valid_to"), F.col("_closed").alias("known_from"), F.lit(None).cast(facts.schema["known"].dataType).alias("known_to"))
    both = F.array_compact(F.array(F.when(F.col("_closed").isNull() | (F.col("_known") < F.col("_closed")), open_), F.when(F.col("_closed").isNotNull(), closed)))
    return rows.select("key", "value", F.col("at").alias("valid_from"), F.explode(both).alias("w"), "tie").select("key", "value", "valid_from", "w.*", "tie")


def known_about(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` (``ask_id``, ``key``, ``known``, ``at``), the value of ``at`` as it was known at ``known``.

    A key's facts rise in both times, so what is known by one and what holds by the other are beginnings of the same order: the value is
    that of the shorter one. Two as-of joins find their lengths, each a union by key and one window.
    """
    per = Window.partitionBy("key").orderBy(*ORDER)
    rows = facts.withColumn("known", F.max("known").over(per.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(per))
    asks = asked.select("ask_id", "key", "known", "at")
    for time, name in (("known", "_by_known"), ("at", "_by_at")):
        seen = Window.partitionBy("key").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
        both = rows.select("key", time, F.col("n").alias("_n"), F.lit(0).alias("_side")).unionByName(asks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        asks = both.withColumn(name, F.max("_n").over(seen)).where("_side = 1").drop("_side", "_n")
    asks = asks.withColumn("n", F.least("_by_known", "_by_at")).where("_by_known is not null and _by_at is not null")
    return asked.select("ask_id", "key").join(asks.join(rows.select("key", "n", "value"), ["key", "n"]).select("ask_id", "value"), "ask_id", "left").select("ask_id", "key", "value")
