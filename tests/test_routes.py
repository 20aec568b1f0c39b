"""How rows are dealt: routes in place of key hashes, and hot keys spread over tasks."""

import statistics

import brute
import pytest
from pyspark.sql import functions as F
from test_match import rows

from graphloom.operators.join import ALL_KEYS, Extender, Index, extend
from graphloom.plans.pattern import Motif


@pytest.mark.parametrize(("route", "spread"), [(None, 3), (lambda k: k % 2, None), (lambda k: F.floor(k / 3), 2)], ids=["spread", "route", "both"])
@pytest.mark.parametrize("strategy", ["generic", "native"])
def test_the_result_is_the_same(spark, route, spread, strategy):
    edges = brute.random_edges(3, 7, 22) | {(0, i) for i in range(1, 7)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    sides = [Extender(x, Index.forward(frame), route=route, spread=spread) for x in ("x0", "x1")]
    assert rows(extend(frame.toDF("x0", "x1"), sides, "x2", strategy)) == brute.matches(Motif.clique(3), edges)
    assert spark.conf.get(ALL_KEYS) == "true"


def test_a_composite_key_and_an_epoch(spark):
    held = spark.createDataFrame([(1, 2, 3, 0, 5), (1, 2, 4, 3, 9)], "k1 long, k2 long, val long, since int, until int")
    prefix = spark.createDataFrame([(1, 2, t) for t in range(6)], "a long, b long, t int")
    side = Extender(("a", "b"), Index(held, ("k1", "k2"), versioned=True), "new", route=lambda a, b: a + b, spread=2)
    assert rows(side.propose(prefix, "c")) == {(1, 2, t, v) for t in range(6) for v in (3, 4) if (v == 3 and t < 5) or (v == 4 and t >= 3)}


def test_a_hub_of_100000_leaves_is_spread(spark):
    """Every prefix has the hub for its key: dealt by the key alone, one task would read all of them."""
    edges = spark.range(1, 100_001).selectExpr("0L AS src", "id AS dst").unionByName(spark.range(1, 3001).selectExpr("id AS src", "id + 1 AS dst"))
    side = Extender("src", Index.forward(edges), spread=1000)
    assert {(r["_h0"], r["_parts"]) for r in side.hot_keys(edges).collect()} == {(0, 100)}
    left, right, _ = side._salted(edges, side.index.degrees().select(F.col("key").alias("_d_key"), "n"), "_d_", F.lit(True))

    def loads(df, *keys):
        return sorted(r["count"] for r in df.repartition(16, *keys).groupBy(F.spark_partition_id()).count().collect())

    alone, spread = loads(edges, "src"), loads(left, "src", "_salt")
    assert alone[-1] > 50 * statistics.median(alone) and spread[-1] < 4 * statistics.median(spread)
    assert right.where("_d_key = 0").count() == 100 and right.where("_d_key = 5").count() == 1
    counted = side.count(edges, "n")
    assert counted.count() == edges.count() and counted.where("src = 0 and n <> 100000").count() == 0
