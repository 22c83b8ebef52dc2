"""Connected components of a graph of links, by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, settled


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches.

    links: a, b. Each round takes the smallest label among neighbours, then the label of
    that label, so chains shorten by half; rounds end when no label changes. Labels are
    written between rounds. A node of very many links is split by Spark's skew joins and
    summed before shuffles.
    """
    edges = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settled(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    before = None
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = settled(labels.select("node", "label").unionByName(near).groupBy("node").agg(F.min("label").alias("label")))
        to = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settled(least.join(to, "label").select("node", F.col("next").alias("label")))
        discard(labels, least)
        # labels only fall, so an equal sum means that none changed
        total = new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            discard(edges)
            return new
        labels, before = new, total
