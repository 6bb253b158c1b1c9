"""Numbers and running values over one global order, without taking all rows to one task.

Ranges of the order deal the rows out; each range is put in order and numbered where it lies, and written, so that what is read later is
what was numbered. What the ranges before one contribute comes from a table with a row for each range. Keys may be sparse, share long
beginnings or be very uneven: ranges follow the rows, not the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import written


def _before(of: Column) -> Column:
    """``of`` over the ranges before, in a table with a row for each range."""
    return of.over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``_range`` and ``_at``, numbers that rise with the order.

    Rows that tie in all of ``order`` share a range: end it with something unique where very many may tie.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(rows, "ranges").withColumn("_range", F.shiftright("_at", 33))


def number_ranged(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ``ranged`` with ``name``: 1, 2, ... in their order."""
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    base = sizes.select("_range", (F.coalesce(_before(F.sum("_n")), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return rows.join(base, "_range").withColumn(name, F.col("_at") + F.col("_base")).drop("_base")


def running_max_ranged(rows: DataFrame, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Rows of ``ranged`` with ``name``: the largest ``value`` up to each row (or before it)."""
    base = rows.groupBy("_range").agg(F.max(value).alias("_m")).select("_range", _before(F.max("_m")).alias("_base"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.max(value).over(inside)).join(base, "_range").withColumn(name, F.greatest(name, "_base")).drop("_base")


def dense_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of the unique ``key``."""
    return number_ranged(ranged(df, key), name).drop("_range", "_at")


def running_max(df: DataFrame, key: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` up to each row (or before it) in the order of ``key``."""
    return running_max_ranged(ranged(df, key), value, name, inclusive).drop("_range", "_at")


def queue_number(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by falling ``score`` and then by the unique text ``key``."""
    return number_ranged(ranged(df, F.desc(score), key), name).drop("_range", "_at")


def range_number(df: DataFrame, within: str, order: list[Column | str], name: str, total: str) -> DataFrame:
    """``df`` with ``name``, 0, 1, ... in ``order`` among the rows of each ``within`` (never null), and ``total``, their number.

    A value of ``within`` that has most rows spans many ranges.
    """
    rows = ranged(df, within, *order)
    sizes = rows.groupBy(within, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(within, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(Window.partitionBy(within)).alias(total))
    return rows.join(written(base, "range-sizes"), [within, "_range"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_range", "_base")
