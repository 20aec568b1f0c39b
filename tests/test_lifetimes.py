"""Cliques with their lifetimes against brute force and derivatives, and how little of them is shuffled."""

import itertools

import pytest
from test_match import joined_rows, random_log, rows
from test_relations import LOG, plain_changes, symmetric

from graphloom.operators import lifetimes as L
from graphloom.operators.lifetimes import clique_lifetimes, clique_order
from graphloom.operators.match import raw_changes, track
from graphloom.operators.parts import TrackInParts, track_in_parts
from graphloom.operators.versioned import FOREVER, consolidate
from graphloom.plans.pattern import Motif


def test_which_motifs_are_cliques():
    assert clique_order(Motif.clique(4)) == ([0, 1, 2, 3], False)
    assert clique_order(Motif.of((2, 0), (2, 1), (0, 1))) == ([2, 0, 1], False)
    assert clique_order(symmetric(3)) == ([0, 1, 2], True)
    assert all(clique_order(m) is None for m in (Motif.cycle(3), Motif.of((0, 1)), Motif.of((0, 1), (1, 2)), Motif.of((0, 1, "q"), (0, 2), (1, 2)), Motif.of((0, 1), (1, 0), (0, 2), (1, 2))))


@pytest.mark.parametrize("few", [0, 10**6], ids=["cells", "one"])
@pytest.mark.parametrize("motif", [Motif.of((2, 0), (2, 1), (0, 1)), Motif.clique(4), Motif.clique(5), symmetric(3), symmetric(4)], ids=["triangle", "k4", "k5", "sym3", "sym4"])
def test_lifetimes_give_what_derivatives_give(spark, monkeypatch, motif, few):
    """Edges come and go several times, both ways, in one epoch or several."""
    monkeypatch.setattr(L, "FEW", few)
    log = random_log(11, 7, 260, 4)
    log = [(a, b, t, 1 if (a + b + t) % 4 else w) for a, b, t, w in log]
    frame = spark.createDataFrame(log, LOG)
    for since in (None, 2):
        got = track(motif, frame, since)
        assert got.columns == consolidate(raw_changes(Motif.clique(motif.width), frame, since)).columns
        found = [tuple(r) for r in got.select(*motif.columns, "w", "t").collect()]
        want = {r for r in plain_changes(motif, {"edges": log}, 4) if r[-1] >= (since or 0)}
        assert set(found) == want != set() and len(found) == len(want)


@pytest.mark.parametrize("k", [3, 4])
def test_symmetric_cliques_are_found_once(spark, monkeypatch, k):
    """A clique of 24 nodes with edges both ways: no join makes more rows than there are sets of k nodes (the derivatives made one for each order of them, and more)."""
    n, made = 24, []
    monkeypatch.setattr(L, "materialize", lambda df, name, f=L.materialize: made.append(df) or f(df, name))
    log = spark.createDataFrame([(a, b, 1, 1) for a, b in itertools.permutations(range(n), 2)], LOG)
    out = track(symmetric(k), log)
    sets = len(list(itertools.combinations(range(n), k)))
    assert out.count() == sets * len(list(itertools.permutations(range(k))))
    assert len(made[-1].collect()) == sets
    assert 0 < max(int(m["value"]) for m in joined_rows(made[-1])) <= sets


def test_a_hub_makes_no_pairs_of_its_neighbours(spark):
    """A star of 3,000 leaves with one triangle: its 4.5 million pairs of leaves aren't candidates."""
    star = [(0, i, 0, FOREVER) for i in range(1, 3001)] + [(1, 2, 3, FOREVER)]
    held = spark.createDataFrame(star, "src long, dst long, since int, until int")
    found = L._in_cells(L.ranked(held, True), 4)
    assert len(found.collect()) == 1
    assert 0 < max(int(m["value"]) for m in joined_rows(found)) <= 2
    assert [tuple(r) for r in clique_lifetimes(held, 3).collect()] == [(0, 1, 2, 3, FOREVER)]


def test_large_cliques_in_parts_need_no_parts(spark, tmp_path, monkeypatch):
    """delta_k6's way: no table of prefixes is dealt into parts, and the same comes out."""
    log = random_log(2, 9, 200, 3)
    frame = spark.createDataFrame(log, LOG)
    want = rows(TrackInParts(spark, Motif.clique(5), str(tmp_path / "parts"), 10**6).run(frame, 1).select(*Motif.clique(5).columns, "w", "t"))
    monkeypatch.setattr(TrackInParts, "_step", lambda *a: pytest.fail("dealt into parts"))
    assert rows(track_in_parts(Motif.clique(5), frame, str(tmp_path / "none"), 1).select(*Motif.clique(5).columns, "w", "t")) == want != set()


def test_queries_over_graph_and_queries_are_found_once(spark, monkeypatch):
    """query_stream_k5's way: where all that changes is asked for, no derivative is taken; where something else changes too, derivatives follow what is asked alone."""
    from graphloom.operators import match as M

    edges = sorted({(a, b) for a, b, *_ in random_log(5, 8, 120, 2)})
    graph, asked = [(a, b, 0, 1) for a, b in edges[::2]], [(a, b, 1 + k % 3, 1) for k, (a, b) in enumerate(edges[1::2])]
    motif, driven = Motif.clique(4), {"edges": spark.createDataFrame(asked, LOG)}
    more = spark.createDataFrame([*graph, *asked, (91, 92, 2, 1)], LOG)
    want = rows(track(motif, more, driven_by=driven))
    monkeypatch.setattr(M, "_derivatives", lambda *a: pytest.fail("derivatives"))
    assert rows(track(motif, spark.createDataFrame(graph + asked, LOG), driven_by=driven)) == want != set()
    with pytest.raises(pytest.fail.Exception, match="derivatives"):
        track(motif, more, driven_by=driven)


@pytest.mark.parametrize("colours", [1, 4])
def test_candidates_stay_in_their_cells(spark, colours):
    """Where the session has more partitions than there were for cells, Spark shuffled all candidates (7.6 million of 112,238 edges in query_stream_k5): only edges are to be, once for each edge of a triangle."""
    held = spark.createDataFrame([(a, b, 0, FOREVER) for a, b in itertools.combinations(range(12), 2)], "src long, dst long, since int, until int")
    edges = L.ranked(held, True)
    before = {key: spark.conf.get(key) for key in (L.ALL_KEYS, "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("false", "200"), strict=True):
            spark.conf.set(key, value)
        found = L._in_cells(edges, colours)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 3
        assert len(found.collect()) == len(list(itertools.combinations(range(12), 3)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_mutual_edges_are_joined_once(spark, monkeypatch):
    """delta_symmetric_triangle's way: each way of the edges goes into one join, which all that follows reads; before, each use joined them anew, and one side with the edges of both ways."""
    tables = {}
    monkeypatch.setattr(L, "materialize", lambda df, name, f=L.materialize: tables.setdefault(name, df) and f(df, name))
    track(symmetric(3), spark.createDataFrame([(a, b, 1, 1) for a, b in itertools.permutations(range(9), 2)], LOG)).collect()
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in tables.items()}
    assert {name: plan.count("Join ") for name, plan in plans.items() if name != "lifetimes"} == {"mutual-edges": 1, "degrees": 0, "ranked-edges": 2}
    assert all(x in plans["mutual-edges"] for x in (" < dst#", " > dst#"))


def test_few_changes_are_followed_by_derivatives(spark, monkeypatch):
    """Two edges added to a graph of hundreds: its matches are not all found again."""
    from graphloom.operators import match as M

    log = spark.createDataFrame([(a, b, 0, 1) for a, b in itertools.combinations(range(30), 2)] + [(40, 1, 1, 1), (40, 2, 1, 1)], LOG)
    monkeypatch.setattr(M, "clique_changes", lambda *a: pytest.fail("all matches"))
    assert rows(track(Motif.clique(3), log, 1).select("x0", "x1", "x2", "w", "t")) == {(40, 1, 2, 1, 1)}
