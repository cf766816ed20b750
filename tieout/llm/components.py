"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout.llm.common import pin


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that can be reached.

    Every round takes the smallest label among the neighbours and then follows the label of that label, so the number
    of rounds grows with the logarithm of the longest path. Labels are written out after each round. A node with very
    many links is pre-aggregated where the links are read. Links with a null end are left out; no links, no rows.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both = pin(both)
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    total = _sum(labels)
    while total is not None:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("seen"))
        near = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", F.least("component", "seen").alias("component"))
        further = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        labels = pin(near.join(further, F.col("component") == F.col("via"), "left").select("node", F.least("component", "further").alias("component")))
        now = _sum(labels)
        if now == total:
            break
        total = now
    return labels


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
