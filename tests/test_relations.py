"""Several relations, symmetric motifs, derivatives in parts, and counting by elimination, against brute force."""

import itertools
import random
import time

import brute
import pytest
from test_match import joined_rows, random_log, rows

from graphloom.operators.counting import count_matches, elimination_order
from graphloom.operators.match import match, raw_changes, track
from graphloom.operators.parts import TrackInParts, track_in_parts
from graphloom.plans.pattern import Motif, MotifError

LOG = "src long, dst long, t int, w int"


def symmetric(k):
    return Motif(tuple((a, b) for a in range(k) for b in range(k) if a != b))


def plain_matches(motif, tables):
    nodes = {x for t in tables.values() for e in t for x in e}
    return {m for m in itertools.product(nodes, repeat=motif.width) if all((m[a], m[b]) in tables[name] for (a, b), name in zip(motif.edges, motif.names, strict=True))}


def plain_changes(motif, logs, epochs):
    """Differences of the matches in consecutive snapshots; `logs` by relation, a set is edges that never change."""
    snaps = {name: {t: log for t in range(-1, epochs)} if isinstance(log, set) else brute.snapshots(log, range(-1, epochs)) for name, log in logs.items()}
    out = set()
    for t in range(epochs):
        old, new = (plain_matches(motif, {name: s[at] for name, s in snaps.items()}) for at in (t - 1, t))
        out |= {(*m, 1, t) for m in new - old} | {(*m, -1, t) for m in old - new}
    return out


TWO = [Motif.of((0, 1, "q"), (0, 2), (1, 2)), Motif.of((0, 1, "q"), (1, 0, "edges"), (1, 2, "q")), Motif.of((0, 1), (1, 2, "q"), (2, 3), (3, 0, "r"))]


@pytest.mark.parametrize("motif", TWO, ids=["triangle", "mutual", "cycle"])
def test_relations_with_logs_of_their_own(spark, motif):
    logs = {name: random_log(k, 6, 50, 4) for k, name in enumerate(motif.relations)}
    frames = {name: spark.createDataFrame(log, LOG) for name, log in logs.items()}
    want = plain_changes(motif, logs, 4)
    assert rows(track(motif, frames).select(*motif.columns, "w", "t")) == want != set()
    assert rows(track(motif, frames, strategy="native").select(*motif.columns, "w", "t")) == want
    held = {name: brute.snapshots(log, [3])[3] for name, log in logs.items()}
    assert rows(match(motif, {name: spark.createDataFrame(sorted(e), "src long, dst long") for name, e in held.items()})) == plain_matches(motif, held)


def test_relations_that_never_change_drive_nothing(spark):
    motif, log, fixed = TWO[0], random_log(4, 7, 60, 4), brute.random_edges(9, 7, 25)
    tables = {"q": spark.createDataFrame(log, LOG), "edges": spark.createDataFrame(sorted(fixed), "src long, dst long")}
    want = plain_changes(motif, {"q": log, "edges": fixed}, 4)
    assert rows(track(motif, tables).select("x0", "x1", "x2", "w", "t")) == want != set()
    with pytest.raises(MotifError, match="changes"):
        track(motif, {"q": tables["edges"], "edges": tables["edges"]})
    with pytest.raises(MotifError, match="no table"):
        track(motif, {"q": tables["q"]})


def test_a_stream_of_queries_over_graph_and_queries(spark):
    """The graph's edges come first and drive nothing; the queries' edges are in the index too."""
    edges = sorted(brute.random_edges(5, 8, 40))
    graph, asked = [(a, b, 0, 1) for a, b in edges[::2]], [(a, b, 1 + k % 3, 1) for k, (a, b) in enumerate(edges[1::2])]
    both = graph + asked
    for motif in (Motif.clique(4), Motif.cycle(3)):
        want = {r for r in plain_changes(motif, {"edges": both}, 4) if r[-1] > 0}
        got = track(motif, spark.createDataFrame(both, LOG), driven_by={"edges": spark.createDataFrame(asked, LOG)})
        assert rows(got.select(*motif.columns, "w", "t")) == want != set()
    # an edge that the graph holds already is no change, so asking for it drives nothing
    twice = spark.createDataFrame([*both, (*edges[0], 1, 1)], LOG)
    again = track(motif, twice, driven_by={"edges": spark.createDataFrame([*asked, (*edges[0], 1, 1)], LOG)})
    assert rows(again.select(*motif.columns, "w", "t")) == want


@pytest.mark.parametrize("k", [3, 4])
def test_symmetric_motifs(spark, k):
    log = [(a, b, t, w if k == 3 or (a + b) % 5 == 0 else 1) for a, b, t, w in random_log(k, 5, 260, 3)]
    motif = symmetric(k)
    want = plain_changes(motif, {"edges": log}, 3)
    assert rows(track(motif, spark.createDataFrame(log, LOG)).select(*motif.columns, "w", "t")) == want != set()


def test_plans_of_mutual_edges_dont_grow_with_each(spark):
    """A symmetric 5-clique, 20 edges: the plan has a number of joins in proportion to what its steps need."""
    log = spark.createDataFrame(random_log(1, 6, 60, 2), LOG)
    log.count()
    raw_changes(Motif.clique(3), log)
    began = time.time()
    plan = raw_changes(symmetric(5), log)._jdf.queryExecution().analyzed().toString()
    took = time.time() - began
    assert plan.count("Join LeftSemi") == 1 + 3 + 5 + 7
    assert plan.count("Join Inner") == 4 + 6 + 8 + 3
    assert took < 30


# Parts


@pytest.mark.parametrize("budget", [100, 10**6])
def test_parts_give_what_one_round_gives(spark, tmp_path, budget):
    log = random_log(6, 7, 90, 3)
    frame = spark.createDataFrame(log, LOG)
    for motif in (Motif.clique(3), Motif.of((0, 1), (1, 0)), Motif.of((0, 1), (1, 2))):
        run = TrackInParts(spark, motif, str(tmp_path / f"m{motif.width}{len(motif.edges)}"), budget)
        assert rows(run.run(frame).select(*motif.columns, "w", "t")) == plain_changes(motif, {"edges": log}, 3)
        assert max(run.made.values(), default=0) <= budget


def test_parts_of_nothing(spark, tmp_path):
    assert track_in_parts(Motif.clique(3), spark.createDataFrame([], LOG), str(tmp_path / "none")).count() == 0


def test_a_large_clique_stays_within_the_budget(spark, tmp_path):
    """A clique of 60 in one epoch: 487,635 4-cliques, and no table of a part has more than 150,000 rows."""
    log = spark.createDataFrame([(a, b, 1, 1) for a, b in itertools.combinations(range(60), 2)], LOG)
    run = TrackInParts(spark, Motif.clique(4), str(tmp_path / "k60"), 600_000)
    assert run.run(log).count() == 60 * 59 * 58 * 57 // 24
    assert len(run.made) > 3 and max(run.made.values()) <= 600_000 and sum(run.made.values()) > 500_000


def test_parts_go_on_after_a_failure(spark, tmp_path, monkeypatch):
    log = random_log(8, 8, 120, 3)
    frame, motif, path = spark.createDataFrame(log, LOG), Motif.clique(4), str(tmp_path / "run")
    first = TrackInParts(spark, motif, path, 250)
    table, left = TrackInParts._table, [3]

    def failing(self, df, name):
        if name.startswith("matches/"):
            left[0] -= 1
            if not left[0]:
                raise RuntimeError("lost")
        return table(self, df, name)

    monkeypatch.setattr(TrackInParts, "_table", failing)
    with pytest.raises(RuntimeError, match="lost"):
        first.run(frame)
    monkeypatch.undo()
    second = TrackInParts(spark, motif, path, 250)
    assert rows(second.run(frame).select(*motif.columns, "w", "t")) == plain_changes(motif, {"edges": log}, 3)
    done = {name for name in first.made if name.count(".") == 2}
    assert done and not done & set(second.made)
    third = TrackInParts(spark, motif, path, 250)
    assert third.run(frame).count() == second.run(frame).count() and not third.made


# Counting

COUNTED = [
    Motif.of((0, 1)),
    Motif.of((0, 1), (1, 2), (2, 3), (3, 4)),
    Motif.clique(3),
    Motif.of((0, 1), (0, 2), (1, 2), (2, 3), (3, 4)),
    Motif.cycle(4),
    Motif.clique(4),
    Motif.of((0, 1), (1, 0), (1, 2)),
    Motif.of((0, 1), (0, 1)),
    Motif.of((0, 1), (0, 2), (0, 3), (4, 0)),
    Motif.of((0, 1), (0, 2), (1, 3), (2, 3), (1, 2), (3, 4)),
    Motif.cycle(5),
]


@pytest.mark.parametrize("edges", [brute.random_edges(3, 7, 22), {(1, 2)}, set()], ids=["random", "one", "empty"])
def test_counts(spark, edges):
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    for motif in COUNTED if len(edges) > 1 else COUNTED[::3]:
        assert count_matches(motif, frame).first()["n"] == len(brute.matches(motif, edges)), motif


def test_counts_over_two_relations(spark):
    motif = Motif.of((0, 1, "q"), (0, 2), (1, 2), (2, 3, "q"))
    tables = {"q": brute.random_edges(1, 7, 20), "edges": brute.random_edges(2, 7, 20)}
    got = count_matches(motif, {name: spark.createDataFrame(sorted(e), "src long, dst long") for name, e in tables.items()})
    assert got.first()["n"] == len(plain_matches(motif, tables)) > 0


@pytest.mark.parametrize("motif", [COUNTED[1], COUNTED[3], COUNTED[8]], ids=["path", "lollipop", "star"])
def test_counting_lists_nothing(spark, motif):
    """A star of 3,000 leaves with edges both ways has billions of matches; no join makes more rows than twice the largest separator, an edge table at most."""
    n = 3000
    edges = {(0, i) for i in range(1, n)} | {(i, 0) for i in range(1, n)} | {(1, 2), (2, 3), (1, 3)}
    out = count_matches(motif, spark.createDataFrame(sorted(edges), "src long, dst long"))
    got = out.first()["n"] if motif.width < 3 else out.collect()[0]["n"]
    assert got > (10**9 if motif != COUNTED[3] else 10**3)
    assert max((int(m["value"]) for m in joined_rows(out)), default=0) <= 2 * len(edges)


def test_elimination_takes_ends_first():
    assert elimination_order(Motif.of((0, 1), (1, 2), (2, 3))) == [3, 2, 1, 0]
    assert elimination_order(Motif.of((0, 1), (1, 2), (0, 2), (0, 3)))[0] == 3
    rnd = random.Random(1)
    for _ in range(20):
        edges = {(rnd.randrange(i), i) for i in range(1, 6)} | {(a, b) for a, b in ((rnd.randrange(6), rnd.randrange(6)) for _ in range(3)) if a != b}
        assert sorted(elimination_order(Motif(tuple(sorted(edges))))) == list(range(6))
