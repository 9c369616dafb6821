"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwise.llm.base import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node with a link.

    Labels go from neighbour to neighbour and from label to label, so the rounds grow with the
    logarithm of a component's width. Each round is a written table. Minima are taken before the
    shuffle; a node with very many links is a skewed join key, which is split at run time.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other").distinct())
    label = materialize(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        seen = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        to = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = materialize(seen.join(to, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.where("old != component").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label
