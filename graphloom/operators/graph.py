"""Graphs as edge tables, and their views."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import ends


def normalise(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges without loops or nulls, as src and dst."""
    return edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src <> dst").distinct()


class Graph:
    """A directed graph; `edges` (src, dst) must be normalised."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    @classmethod
    def of(cls, edges: DataFrame, src: str = "src", dst: str = "dst") -> Graph:
        return cls(normalise(edges, src, dst))

    @cached_property
    def oriented(self) -> DataFrame:
        """Each undirected edge once, s < d."""
        s, d = ends("src", "dst")
        return self.edges.select(s.alias("s"), d.alias("d")).distinct()

    @cached_property
    def symmetric(self) -> DataFrame:
        """Each undirected edge in both directions, as src and dst."""
        f = self.oriented
        return f.select(F.col("s").alias("src"), F.col("d").alias("dst")).unionByName(f.select(F.col("d").alias("src"), F.col("s").alias("dst")))

    def adjacency(self) -> DataFrame:
        """node and the sorted array of its targets."""
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))

    def degrees(self) -> DataFrame:
        """Targets of each node that has any."""
        return self.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))

    def total_degrees(self) -> DataFrame:
        """Edges at each node, in either direction."""
        node = F.explode(F.array("src", "dst")).alias("node")
        return self.edges.select(node).groupBy("node").agg(F.count("*").alias("degree"))

    def smaller_neighbours(self) -> DataFrame:
        """For each node of an edge, how many of its undirected neighbours have a smaller number."""
        return self.symmetric.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("dst") < F.col("src")).alias("n"))

    def sources(self) -> DataFrame:
        """How many nodes have a target."""
        return self.edges.agg(F.count_distinct("src").alias("n"))

    def fragment(self, index: int, parts: int) -> DataFrame:
        """The edges of one of `parts` fragments."""
        return self.edges.where(F.pmod("src", F.lit(parts)) == index)

    def ranked(self) -> DataFrame:
        """Each undirected edge once, from the node with fewer edges to the one with more (low, high), ties by number; high_deg is the degree of high.

        No node has more than sqrt(2m) edges out, however large a hub is, so what is built from them stays bounded.
        """
        degree = self.symmetric.groupBy("src").agg(F.count("*").alias("deg"))
        f = self.oriented.join(degree.withColumnsRenamed({"src": "s", "deg": "ds"}), "s").join(degree.withColumnsRenamed({"src": "d", "deg": "dd"}), "d")
        up = F.struct("ds", "s") < F.struct("dd", "d")
        return f.select(F.when(up, F.col("s")).otherwise(F.col("d")).alias("low"), F.when(up, F.col("d")).otherwise(F.col("s")).alias("high"), F.greatest("ds", "dd").alias("high_deg"))

    def upward(self) -> DataFrame:
        """node and the array of its neighbours that rank above it, in the order of ranks."""
        grouped = self.ranked().groupBy(F.col("low").alias("node")).agg(F.array_sort(F.collect_list(F.struct("high_deg", "high"))).alias("up"))
        return grouped.select("node", F.col("up.high").alias("up"))

    def relabelled_by_degree(self) -> DataFrame:
        """node and its rank (from 0) by total degree, then number.

        Ranks follow from the nodes' counts by degree (one row for each degree) and their order within a degree, so no task sees all nodes.
        """
        total = self.total_degrees()
        before = total.groupBy("degree").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("degree")) - F.col("n")).drop("n")
        # nodes of one degree are numbered by blocks of their hash-free order: block counts first, then within the block
        block = (F.col("node") / 4096).cast("long")
        blocks = total.groupBy("degree", block.alias("block")).agg(F.count("*").alias("n"))
        blocks = blocks.withColumn("skip", F.sum("n").over(Window.partitionBy("degree").orderBy("block")) - F.col("n")).drop("n")
        within = F.row_number().over(Window.partitionBy("degree", "block").orderBy("node")) - 1
        numbered = total.withColumn("block", block).withColumn("within", within)
        return numbered.join(blocks, ["degree", "block"]).join(before, "degree").select("node", (F.col("start") + F.col("skip") + F.col("within")).alias("rank"))

    def layout(self) -> DataFrame:
        """The undirected edges between ranks by degree, lesser rank first, distinct."""
        rank = self.relabelled_by_degree()
        both = self.edges.join(rank.withColumnsRenamed({"node": "src", "rank": "rs"}), "src").join(rank.withColumnsRenamed({"node": "dst", "rank": "rd"}), "dst")
        s, d = ends("rs", "rd")
        return both.select(s.alias("src"), d.alias("dst")).distinct()
