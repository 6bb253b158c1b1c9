"""Connected components of a links table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node`` and ``label`` for every node in ``links`` (``a``, ``b``); label is the smallest node of its component.

    Each round gives every root the smallest label next to its tree and then
    lets nodes skip to their label's label, so the depth halves. With
    ``rounds``, it stops after so many: equal labels then still mean that nodes
    are connected, but a component may have several. Links of a node with
    itself are allowed; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    done = 0
    while rounds is None or done < rounds:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("near"))
        roots = hooked.groupBy("label").agg(F.min("near").alias("root"))  # what any node of a tree can reach
        step = written(hooked.join(roots, "label").select("node", F.col("label").alias("was"), F.least("near", "root").alias("label")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(step.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), "labels")
        done += 1
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            break
    return labels
