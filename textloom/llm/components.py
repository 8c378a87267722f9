"""Connected components of a table of links, by hooking to least neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import drop_tables, write_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the least node that it reaches.

    In each round every node takes the least of itself and its neighbours as parent, parents are followed twice, and
    links between different parents go to the next round. A round leaves at most the local minima of the one before,
    so rounds are few; each is written to the shared folder. Least values are found by partial sums; joins on a node
    with very many links are plain sort-merge joins, which adaptive execution splits.

    Links with a null end are dropped; repeated links and links of a node with itself do no harm; no links, no rows.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = write_table(edges, "links")
    labels = None
    while labels is None or edges.where("a <> b").limit(1).count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooked = write_table(ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("parent")), "hooked")
        parents = hooked
        for _ in range(2):
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parents = parents.join(up, "parent").select("node", F.col("grand").alias("parent"))
        parents = write_table(parents, "parents")
        to = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}2"))
        left = write_table(edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "links")
        moved = parents.withColumnRenamed("parent", "component")
        if labels is not None:
            met = labels.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left")
            moved = met.select("node", F.coalesce("parent", "component").alias("component"))
        moved = write_table(moved, "labels")
        drop_tables(edges, hooked, parents, *([labels] if labels is not None else []))
        edges, labels = left, moved
    drop_tables(edges)
    return labels
