"""Directed graphs as two tables: vertices (ordinal, ...) and edges (from_ord, to_ord, weight)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.tables import drop_tables, write_table

NO_EDGE = 2147483647.0


class CycleError(ValueError):
    """An edge would close a cycle."""


@dataclass(frozen=True)
class Dag:
    """A graph that has at most one root and no cycle. Changes give a new graph; tables keep the order of insertion in ordinal.

    vertices: ordinal long, label string, depth int, is_root boolean, and any more. edges: from_ord, to_ord long, weight double.
    """

    vertices: DataFrame
    edges: DataFrame

    # Changes

    def add_vertices(self, more: DataFrame) -> Dag:
        """With more vertices; those of an ordinal that is there already change nothing."""
        new = more.dropDuplicates(["ordinal"]).join(self.vertices.select("ordinal"), "ordinal", "left_anti")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True))

    def set_root(self, ordinal: int) -> Dag:
        return replace(self, vertices=self.vertices.withColumn("is_root", F.col("ordinal") == ordinal))

    def add_edges(self, more: DataFrame, check: bool = True) -> Dag:
        """With more edges between its vertices; repeated ones count once, those to unknown vertices are dropped.

        With check, an edge that closes a cycle raises CycleError; this graph is as it was.
        """
        ends = self.vertices.select("ordinal")
        known = more.join(ends.withColumnRenamed("ordinal", "from_ord"), "from_ord", "left_semi").join(ends.withColumnRenamed("ordinal", "to_ord"), "to_ord", "left_semi")
        new = known.dropDuplicates(["from_ord", "to_ord"]).join(self.edges.select("from_ord", "to_ord"), ["from_ord", "to_ord"], "left_anti")
        out = replace(self, edges=self.edges.unionByName(new))
        if check and out.has_cycle():
            raise CycleError("an edge closes a cycle")
        return out

    def remove_edges(self, gone: DataFrame) -> Dag:
        return replace(self, edges=self.edges.join(gone.select("from_ord", "to_ord"), ["from_ord", "to_ord"], "left_anti"))

    def remove_vertices(self, gone: DataFrame) -> Dag:
        """Without the vertices and the edges that touch them. With the root gone there is none."""
        ids = gone.select("ordinal")
        edges = self.edges.join(ids.withColumnRenamed("ordinal", "from_ord"), "from_ord", "left_anti").join(ids.withColumnRenamed("ordinal", "to_ord"), "to_ord", "left_anti")
        return Dag(self.vertices.join(ids, "ordinal", "left_anti"), edges.select("from_ord", "to_ord", "weight"))

    def marked(self, marks: DataFrame) -> Dag:
        """With the marks (ordinal, mark) of some vertices, 0 for those without one so far; a mark below 0 is an error."""
        if marks.where("mark < 0").limit(1).count():
            raise ValueError("marks begin at 0")
        own = F.col("own") if "mark" in self.vertices.columns else F.lit(0)
        old = self.vertices.withColumnRenamed("mark", "own")
        met = old.join(marks.select("ordinal", "mark").dropDuplicates(["ordinal"]), "ordinal", "left").withColumn("mark", F.coalesce("mark", own).cast("int"))
        return replace(self, vertices=met.drop("own"))

    # Look-ups

    def contains_vertices(self, asked: DataFrame) -> DataFrame:
        return asked.join(self.vertices.select("ordinal"), "ordinal", "left_semi")

    def contains_edges(self, asked: DataFrame) -> DataFrame:
        return asked.join(self.edges.select("from_ord", "to_ord"), ["from_ord", "to_ord"], "left_semi")

    def size(self) -> int:
        """The number of edges."""
        return self.edges.count()

    def root(self) -> DataFrame:
        return self.vertices.where("is_root")

    def by_label(self, label: str) -> DataFrame:
        """The vertex first inserted with the label."""
        return self.vertices.where(F.col("label") == label).orderBy("ordinal").limit(1)

    def at(self, ordinal: int) -> DataFrame:
        return self.vertices.where(F.col("ordinal") == ordinal)

    def find_edge(self, source: int, target: int) -> DataFrame:
        """An edge that touches source and ends in target; for source = target, any edge that comes in."""
        return self.edges.where(((F.col("from_ord") == source) | (F.col("to_ord") == source)) & (F.col("to_ord") == target)).orderBy("from_ord").limit(1)

    def has_cycle(self) -> bool:
        return has_cycle(self.edges)

    def rendered(self) -> DataFrame:
        """Vertices by depth, then by order of insertion."""
        return self.vertices.orderBy("depth", "ordinal").select("ordinal", "label", "depth")


def edge(from_ord: Column, to_ord: Column, weight: Column | float = 0.0) -> Column:
    return F.struct(from_ord.cast("long").alias("from_ord"), to_ord.cast("long").alias("to_ord"), (weight if isinstance(weight, Column) else F.lit(weight)).cast("double").alias("weight"))


def incoming(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return edges.join(asked.select(F.col("ordinal").alias("to_ord")), "to_ord", "left_semi")


def outgoing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return edges.join(asked.select(F.col("ordinal").alias("from_ord")), "from_ord", "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """ordinal, from_ord, to_ord: each edge at both of its ends, once if they are the same."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_ord", "to_ord"))).alias("ordinal"), "from_ord", "to_ord")
    return ends.distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """ordinal, in_degree, out_degree, 0 where there is no edge."""
    ends = edges.select(F.col("to_ord").alias("ordinal"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("from_ord").alias("ordinal"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    every = ends.unionByName(vertices.select("ordinal", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("ordinal").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def is_descendant(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (child, parent) with is_descendant: is there an edge from parent to child? Ancestors further up do not count."""
    direct = edges.select(F.col("from_ord").alias("parent"), F.col("to_ord").alias("child"), F.lit(True).alias("direct")).distinct()
    return pairs.join(direct, ["parent", "child"], "left").select("child", "parent", F.coalesce("direct", F.lit(False)).alias("is_descendant"))


def edge_weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (from_ord, to_ord) with weight: 0 from a vertex to itself, the largest int where there is no edge."""
    met = pairs.join(edges.select("from_ord", "to_ord", F.col("weight").alias("own")), ["from_ord", "to_ord"], "left")
    return met.select("from_ord", "to_ord", F.when(F.col("from_ord") == F.col("to_ord"), 0.0).otherwise(F.coalesce("own", F.lit(NO_EDGE))).alias("weight"))


def has_cycle(edges: DataFrame) -> bool:
    """Is there a way from a vertex back to it?

    In each round vertices without a way in or without a way on go, and then those with one way in become one with the
    vertex that it comes from (in every other round, those with one way on with the vertex that it leads to). Pointers
    to it are followed in doubling steps, so chains and trees of any length take as many steps as their length has
    binary digits. Each step is written to the shared folder.
    """
    left = write_table(edges.select(F.col("from_ord").alias("a"), F.col("to_ord").alias("b")).distinct(), "edges")
    while True:
        n = left.count()
        if not n or left.where("a = b").limit(1).count():
            drop_tables(left)
            return bool(n)
        inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        inner = write_table(inner.select("a", "b"), "edges")
        drop_tables(left)
        up = inner.groupBy("b").agg(F.count("*").alias("ways"), F.min("a").alias("up")).where("ways = 1").select(F.col("b").alias("v"), "up")
        up = write_table(up, "pointers")
        pointers, closed = up.count(), False
        for _ in range(pointers.bit_length()):
            on = up.select(F.col("v").alias("up"), F.col("up").alias("further"))
            further = write_table(up.join(on, "up", "left").select("v", F.coalesce("further", "up").alias("up")), "pointers")
            drop_tables(up)
            up = further
        if pointers:  # by now every pointer has come to its end, or has none
            closed = bool(up.join(up.select(F.col("v").alias("up")), "up", "left_semi").limit(1).count())
        many = inner.join(up.select(F.col("v").alias("b")), "b", "left_anti")
        merged = many.join(up.select(F.col("v").alias("a"), "up"), "a", "left").select(F.col("b").alias("a"), F.coalesce("up", "a").alias("b")).distinct()
        left = write_table(merged, "edges")  # turned round, for the next round
        drop_tables(inner, up)
        if closed or (left.count() == n and not pointers):
            drop_tables(left)
            return True


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges on a cycle or between cycles: what is left once edges that end in a vertex without a way on, or start in one
    without a way in, are dropped again and again. As many rounds as the longest way that is on no cycle has edges; each
    round is written to the shared folder. Whether there are any is told by has_cycle() in far fewer."""
    left = write_table(edges.select("from_ord", "to_ord").distinct(), "edges")
    n = left.count()
    while n:
        on = left.join(left.select(F.col("from_ord").alias("to_ord")).distinct(), "to_ord", "left_semi")
        both = write_table(on.join(on.select(F.col("to_ord").alias("from_ord")).distinct(), "from_ord", "left_semi").select("from_ord", "to_ord"), "edges")
        kept = both.count()
        if kept == n:
            break
        drop_tables(left)
        left, n = both, kept
    return left if n else left.limit(0)
