"""What reviewers ask of a history and decide on disputes: where a value comes from, and which disputes are waived when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import written

#: Dispositions that make a waiver, and the one that suppresses a claim for good.
WAIVES, SUPPRESSES = ("code_defect", "intentional_simplification"), "extraction_error"
ORDER = ["at", "tie"]


def supersessions(facts: DataFrame) -> DataFrame:
    """``key``, ``id``, ``up`` (the assertion that it superseded; null: none), ``value``, ``at`` and ``last`` of every assertion that counts.

    ``facts`` as of ``history.windows``; ``tie`` is an assertion's id. What follows a withdrawal supersedes nothing.
    """
    per = Window.partitionBy("key").orderBy(*ORDER)
    rows = facts.withColumn("_before", F.lag("value").over(per)).withColumn("_n", F.row_number().over(per))
    rows = rows.where(~F.col("value").eqNullSafe(F.col("_before")) | ((F.col("_n") == 1) & F.col("value").isNotNull()))
    rows = rows.withColumn("up", F.when(F.lag("value").over(per).isNotNull(), F.lag("tie").over(per))).withColumn("last", F.lead("tie").over(per).isNull())
    return rows.where("value is not null").select("key", F.col("tie").alias("id"), "up", "value", "at", "last")


def roots(links: DataFrame) -> DataFrame:
    """``id``, ``root`` and ``depth`` of every row of ``links`` (``id``, ``up``): the end of its chain and how many steps it is away.

    Each round doubles the steps that a row has taken, so a chain of n takes log n rounds; only rows that are still on their way are
    joined. Links must not lead in circles, and a row's ``up`` must be a row.
    """
    at = written(links.select("id", F.coalesce("up", "id").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "chains")
    ended = at.where("done")
    moving = at.where("not done")
    while not moving.isEmpty():
        ahead = ended.unionByName(moving).select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("done").alias("there"))
        stepped = written(moving.join(ahead, "root").select("id", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done")), "chains")
        ended, moving = ended.unionByName(stepped.where("done")), stepped.where("not done")
    return ended.select("id", "root", "depth")


def explain(facts: DataFrame) -> DataFrame:
    """Of each key's open value: how often it was superseded since it was first stated (``depth``), when that was and by which assertion."""
    links = written(supersessions(facts), "supersessions")
    found = links.where("last").join(roots(links), "id")
    first = links.select(F.col("id").alias("root"), F.col("at").alias("first_at"), F.col("value").alias("first_value"))
    return found.join(first, "root").select("key", "value", "depth", F.col("root").alias("first_id"), "first_value", "first_at", F.col("id").alias("last_id"), F.col("at").alias("last_at"))


def covers(waivers: DataFrame, disputes: DataFrame) -> DataFrame:
    """``id``, ``start`` and ``end`` (null: for good) for which waivers cover disputes.

    ``disputes`` has ``id``, ``key``, ``value`` (the code's, ended where it changes), ``start`` and ``end``; ``waivers`` has ``key``,
    ``disposition``, ``granted`` and ``expires``. A waiver is of the value that the code had when it was granted, so it ends with that
    value's dispute at the latest; one granted while nothing is disputed covers nothing. A suppression covers all disputes of its key
    that have this value, whenever they open. Waivers meet their disputes in an as-of join by key: a union and one window.
    """
    sides = disputes.select("key", F.col("start").alias("t"), F.lit(0).alias("side"), F.struct("id", "value", "start", "end").alias("d")).unionByName(
        waivers.where(F.col("disposition").isin(*WAIVES, SUPPRESSES)).select("key", F.col("granted").alias("t"), F.lit(1).alias("side"), "disposition", "expires"), allowMissingColumns=True
    )
    last = F.last("d", ignorenulls=True).over(Window.partitionBy("key").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    met = sides.withColumn("d", last).where("side = 1 and d is not null and (d.end is null or t < d.end)")
    waived = met.where(F.col("disposition") != SUPPRESSES).select("d.id", F.col("t").alias("start"), F.when(F.col("d.end").isNull(), F.col("expires")).otherwise(F.least("expires", "d.end")).alias("end"))
    hushed = met.where(F.col("disposition") == SUPPRESSES).select("key", "d.value").distinct().join(disputes, ["key", "value"]).select("id", "start", "end")
    return waived.where("start < end").unionByName(hushed)


def open_intervals(disputes: DataFrame, covered: DataFrame) -> DataFrame:
    """``id``, ``start`` and ``end`` (null: still) of the times for which a dispute is open and not covered; ``covered`` as of ``covers``.

    Intervals are subtracted in one window by dispute: a gap begins where all before it have ended and ends where the next begins.
    """
    edge = disputes.select("id", F.col("end").alias("t"), F.lit(None).cast(disputes.schema["end"].dataType).alias("until"), F.lit(True).alias("edge"), F.lit(False).alias("forever"), F.col("start").alias("base"))
    spans = covered.join(disputes.select("id", F.col("start").alias("base")), "id").select("id", F.col("start").alias("t"), F.col("end").alias("until"), F.lit(False).alias("edge"), F.col("end").isNull().alias("forever"), "base")
    before = Window.partitionBy("id").orderBy("edge", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.unionByName(edge).withColumn("from", F.greatest("base", F.coalesce(F.max("until").over(before), F.col("base")))).withColumn("shut", F.coalesce(F.max("forever").over(before), F.lit(False)))
    return rows.where(~F.col("shut") & (F.col("t").isNull() | (F.col("from") < F.col("t")))).select("id", F.col("from").alias("start"), F.col("t").alias("end"))
