"""The multiway join in one exchange, and joins on indexes that lie by their keys."""

import brute
import pytest
from test_match import random_log, rows

from graphloom.operators.match import match, raw_changes, track
from graphloom.operators.shares import ALL_KEYS, SharedJoin, match_by_shares, shares
from graphloom.plans.pattern import Motif
from graphloom.storage import bucketed


def exchanges(plan):
    """(a node's name, the names of all nodes above it) of an executed plan."""
    out, todo = [], [(plan, ())]
    while todo:
        node, above = todo.pop()
        name = node.nodeName()
        out.append((name, above))
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        below += [node.children().apply(i) for i in range(node.children().size())]
        todo += [(b, (name, *above)) for b in below]
    return out


@pytest.mark.parametrize("motif", [Motif.clique(3), Motif.cycle(3), Motif.clique(4), Motif.cycle(4), Motif.of((0, 1), (1, 2)), Motif.of((0, 1), (1, 0), (1, 2)), Motif.of((0, 1))], ids=str)
def test_shares_give_what_match_gives(spark, motif):
    edges = brute.random_edges(3, 8, 28)
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = [tuple(r) for r in match_by_shares(motif, frame, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.matches(motif, edges)
    assert spark.conf.get(ALL_KEYS) == "true"


def test_shares_of_nothing(spark):
    assert match_by_shares(Motif.clique(3), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rows_sent(spark):
    """Of a triangle with 64 cells, each relation is copied four times; the 4-clique's six relations go to two other coordinates each."""
    assert shares(Motif.clique(3), 64) == (4, 4, 4)
    assert sorted(shares(Motif.clique(4), 64)) == [2, 2, 4, 4]
    edges = spark.range(2000).selectExpr("id % 100 AS src", "(id * 37 + id div 100) % 1000 AS dst").where("src <> dst").distinct()
    join = SharedJoin(Motif.clique(3), edges, 64)
    n = join.edges.count()
    assert join.hot == [] and join.cells == 64
    assert [join.sent(i).count() for i in range(3)] == [4 * n] * 3  # edges x cells^(1/3)
    assert rows(join.matches()) == rows(match(Motif.clique(3), edges))


def test_hot_values_have_cells_of_their_own(spark):
    """A star of 4,000 leaves: no cell holds much more than its part of the rows, where one grid for all would give the hub's edges to a quarter of the cells."""
    n = 4000
    edges = spark.createDataFrame([(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, n - 1)] + [(i, 0) for i in range(1, n, 3)], "src long, dst long")
    join = SharedJoin(Motif.clique(3), edges, 64)
    assert join.hot == [0] and len(join.grids) == 8
    sent = join.sent(0).unionByName(join.sent(1), allowMissingColumns=True).unionByName(join.sent(2), allowMissingColumns=True)
    loads = sorted(r["count"] for r in sent.groupBy("cell").count().collect())
    assert loads[-1] < 0.03 * sum(loads)
    assert rows(join.matches()) == rows(match(Motif.clique(3), edges))


def test_one_exchange_a_relation(spark):
    edges = spark.createDataFrame(sorted(brute.random_edges(3, 9, 40)), "src long, dst long")
    join = SharedJoin(Motif.clique(4), edges, 16)
    spark.conf.set(ALL_KEYS, "false")
    try:
        plan = join._plan(4)
        plan.collect()
        names = [name for name, _ in exchanges(plan._jdf.queryExecution().executedPlan())]
    finally:
        spark.conf.set(ALL_KEYS, "true")
    assert names.count("Exchange") + names.count("ReusedExchange") == 6 and "BroadcastExchange" not in names


def test_joins_dont_shuffle_bucketed_indexes(spark, monkeypatch):
    """Of each join of the 4-clique's derivatives, the prefixes alone are shuffled: above the scans of the indexes there is neither an exchange nor a sort before the join."""
    log = spark.createDataFrame(random_log(3, 8, 200, 4), "src long, dst long, t int, w int")
    motif = Motif.clique(4)
    want = sorted(map(tuple, track(motif, log).collect()))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = raw_changes(motif, log, copartition=True)
        changes.collect()
        found = exchanges(changes._jdf.queryExecution().executedPlan())
        assert sorted(map(tuple, track(motif, log, copartition=True).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    scans = [above for name, above in found if name.startswith("Scan parquet spark_catalog")]
    assert len(scans) == 10  # a step with k constraints: k counts, one proposal, k - 1 filters
    for above in scans:
        join = next(i for i, name in enumerate(above) if "Join" in name)
        assert not any("Exchange" in name or name == "Sort" for name in above[:join])


def test_bucketed_tables(spark):
    df = spark.range(100).selectExpr("id % 7 AS k", "id AS v")
    table = bucketed(df, "test", ("k",), 3)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
