"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.frames import joined, saved, written


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node of its component.

    Each round takes the least label among a node's neighbours, and for a label that was given up the one that came in its
    place, then the label of that label.  So the rounds grow with the logarithm of the longest path.  Every round is cut by
    files in the shared folder (see written()).  Aggregations combine before their shuffle, and the joins deal the rows of a
    node with very many links, or of a large component, over salts (see joined()).  No links: no rows."""
    ways = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).toDF("a", "b").distinct())
    labels = written(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.col("node").alias("was")))
    none = F.lit(None).cast("long").alias("was")
    while labels.where("label < was").limit(1).count():
        near = joined(ways, labels.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", none)
        left = labels.where("label < was").select(F.col("was").alias("node"), "label", none)
        least = saved(near.union(left).union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        far = least.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = written(joined(least, far, "label").select("node", F.least("label", "beyond").alias("label"), "was"))
    return labels.select("node", "label")
