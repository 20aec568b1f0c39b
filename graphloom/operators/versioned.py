"""Edges that change: a log of signed changes, its snapshots, effective changes and intervals of validity.

The log has rows (src, dst, t, w). The weights of an edge's rows in one epoch are added; a positive sum inserts the edge, a negative one deletes it, and 0 does nothing. Relations are sets: inserting
a present edge or deleting an absent one changes nothing, in whatever number. So an edge is present as of an epoch if the last of its sums other than 0 is positive. Batches,
snapshots, merged bases and streams all follow this one rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import materialize

SCHEMA = "src long, dst long, t int, w int"
FOREVER = 2**31 - 1


def consolidate(rows: DataFrame, weight: str = "w", keep_positive: bool = False) -> DataFrame:
    """Equal rows in one, weights added; rows of weight 0 (or, with `keep_positive`, up to 0) are dropped."""
    keys = [c for c in rows.columns if c != weight]
    out = rows.groupBy(*keys).agg(F.sum(weight).cast("long").alias(weight))
    return out.where(F.col(weight) > 0 if keep_positive else F.col(weight) != 0)


def net_changes(log: DataFrame) -> DataFrame:
    """(src, dst, t, w): the sum of an edge's weights in each epoch, where it isn't 0."""
    return log.groupBy("src", "dst", "t").agg(F.sum("w").alias("w")).where("w <> 0")


def history(log: DataFrame) -> DataFrame:
    """(src, dst, t, before, now): whether an edge was and is present, for each epoch that inserts or deletes it.

    One shuffle by edge; everything else about versions follows from this table.
    """
    edge = Window.partitionBy("src", "dst").orderBy("t")
    return net_changes(log).select("src", "dst", "t", F.coalesce(F.lag("w").over(edge) > 0, F.lit(False)).alias("before"), (F.col("w") > 0).alias("now"))


def held_edges(log: DataFrame) -> DataFrame:
    """The edges present after all epochs of the log: one aggregation, without an order."""
    return net_changes(log).groupBy("src", "dst").agg(F.max_by("w", "t").alias("w")).where("w > 0").select("src", "dst")


def turns(log: DataFrame) -> DataFrame:
    """(src, dst, t, now, until): each epoch in which an edge appears (now) or goes, and the epoch of its next turn. Both `changes_of` and `held_in` follow from it without another shuffle."""
    edge = Window.partitionBy("src", "dst").orderBy("t")
    return history(log).where("before <> now").select("src", "dst", "t", "now", F.coalesce(F.lead("t").over(edge), F.lit(FOREVER)).alias("until"))


def changes_of(turned: DataFrame) -> DataFrame:
    """(src, dst, t, w): w is 1 where an edge appears and -1 where it goes."""
    return turned.select("src", "dst", "t", F.when(F.col("now"), 1).otherwise(-1).alias("w"))


def held_in(turned: DataFrame) -> DataFrame:
    """(src, dst, since, until): the edge is present at epochs since <= t < until."""
    return turned.where("now").select("src", "dst", F.col("t").alias("since"), "until")


def effective_changes(log: DataFrame) -> DataFrame:
    """(src, dst, t, w): w is 1 where an edge appears and -1 where it goes."""
    return changes_of(history(log).where("before <> now"))


def undirected(log: DataFrame) -> DataFrame:
    """The log (src < dst, t, w) of edges without direction: one is present while an edge either way is."""
    turns = effective_changes(log).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "t").agg(F.sum("w").alias("w"))
    ways = F.sum("w").over(Window.partitionBy("src", "dst").orderBy("t"))
    counted = turns.withColumn("now", ways).where((F.col("now") > 0) != (F.col("now") - F.col("w") > 0))
    return counted.select("src", "dst", "t", F.when(F.col("now") > 0, 1).otherwise(-1).alias("w"))


def intervals(log: DataFrame) -> DataFrame:
    """(src, dst, since, until): the edge is present at epochs since <= t < until."""
    return held_in(turns(log))


class VersionedEdges:
    """A base of edges and the log of changes since, as the multiversion index that joins read."""

    def __init__(self, log: DataFrame):
        self.log = log.select(*(F.col(c).cast(k) for c, k in (x.split() for x in SCHEMA.split(", "))))

    @classmethod
    def initial(cls, edges: DataFrame) -> VersionedEdges:
        """Edges that are present from the outset."""
        return cls(edges.select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w")).where("src <> dst").distinct())

    @classmethod
    def empty(cls, spark: SparkSession) -> VersionedEdges:
        return cls(spark.createDataFrame([], SCHEMA))

    def update(self, changes: DataFrame, t: int | None = None) -> VersionedEdges:
        """With more changes; `t` is their epoch if they have none."""
        rows = changes.withColumn("t", F.lit(t)) if t is not None else changes
        return VersionedEdges(self.log.unionByName(rows.select("src", "dst", F.col("t").cast("int"), F.col("w").cast("int"))))

    def as_of(self, t: int, strict: bool = False) -> DataFrame:
        """The edges present at epoch t, or with `strict` just before it."""
        return held_edges(self.log.where(F.col("t") < t if strict else F.col("t") <= t))

    def merge_to(self, t: int) -> VersionedEdges:
        """Folds all changes up to t into the base: what held at t holds from t on, and history before is forgotten. No snapshot or change after t differs. The result is written as a table."""
        later = self.log.where(F.col("t") > t)
        return VersionedEdges(materialize(self.as_of(t).select("src", "dst", F.lit(t).alias("t"), F.lit(1).alias("w")).unionByName(later), "base"))

    def first_change_after(self, t: int) -> DataFrame:
        """The earliest epoch of a change after t, as one row."""
        return self.log.where(F.col("t") > t).agg(F.min("t").alias("t"))
