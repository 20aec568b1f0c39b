import random

import brute
import pytest

from graphloom.operators import cliques as C
from graphloom.operators.graph import Graph
from graphloom.operators.join import Extender, Index, extend, factorised, nominate
from graphloom.operators.match import epoch_counts, match, raw_changes, running_total, track, track_cliques_by_triangles
from graphloom.operators.versioned import VersionedEdges, consolidate, effective_changes
from graphloom.plans.pattern import Motif

MOTIFS = [Motif.clique(3), Motif.cycle(3), Motif.cycle(4), Motif.clique(4), Motif.of((0, 1), (1, 2)), Motif.of((0, 1), (1, 0), (1, 2)), Motif.of((0, 1), (0, 1)), Motif.of((0, 1))]


def joined_rows(df):
    """The numbers of rows that the joins of an executed plan made."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append({"name": name, "value": node.metrics().apply("numOutputRows").value()})
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def frame(spark, edges, schema="src long, dst long"):
    return spark.createDataFrame(sorted(edges), schema)


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("strategy", ["generic", "native", "array"])
def test_match_agrees_with_brute_force(spark, strategy):
    edges = brute.random_edges(3, 7, 20)
    for motif in MOTIFS[:6]:
        assert rows(match(motif, frame(spark, edges), strategy=strategy)) == brute.matches(motif, edges), motif


def test_seeds_and_other_order(spark):
    edges = brute.random_edges(5, 7, 22)
    seeds = {e for e in edges if e[0] % 2}
    want = {m for m in brute.matches(Motif.clique(4), edges) if m[:2] in seeds}
    assert rows(match(Motif.clique(4), frame(spark, edges), frame(spark, seeds))) == want


def test_delta_law_with_deletions(spark):
    """new - old = sum of derivatives, with insertions of present and deletions of absent edges, and both at once."""
    log = [(s, d, 0, 1) for s, d in brute.random_edges(1, 6, 14)]
    log += [(s, d, 1, 1) for s, d in brute.random_edges(2, 6, 8)] + [(s, d, 1, -1) for s, d, _, _ in log[:3]]
    log += [(s, d, 2, -1) for s, d, _, _ in log[4:9]] + [(0, 5, 2, 1), (0, 5, 2, -1), (5, 0, 3, 1)]
    snaps = brute.snapshots(log, range(-1, 4))
    df = spark.createDataFrame(log, "src long, dst long, t int, w int")
    for motif in MOTIFS:
        want = set()
        for t in range(1, 4):
            old, new = brute.matches(motif, snaps[t - 1]), brute.matches(motif, snaps[t])
            want |= {(*m, 1, t) for m in new - old} | {(*m, -1, t) for m in old - new}
        got = {(*r[: motif.width], r["w"], r["t"]) for r in track(motif, df, 1).collect()}
        assert got == want, motif
    triangle = Motif.clique(3)
    total = running_total(epoch_counts(track(triangle, df))).orderBy("t").collect()
    assert total[-1]["total"] == len(brute.matches(triangle, snaps[3]))
    assert raw_changes(triangle, df).count() >= track(triangle, df).count()


def test_batch_sizes_dont_matter(spark):
    edges = sorted(brute.random_edges(8, 8, 30))
    nets = []
    for size in (1, 7, 30):
        log = spark.createDataFrame([(s, d, i // size, 1) for i, (s, d) in enumerate(edges)], "src long, dst long, t int, w int")
        nets.append(sum(r["net"] for r in epoch_counts(track(Motif.cycle(3), log)).collect()))
    assert len(set(nets)) == 1


#: Repeated inserts and deletes of absent edges; (1, 2) is inserted twice and deleted once.
REPEATED = [(1, 2, 0, 1), (1, 2, 1, 1), (1, 2, 2, -1), (1, 2, 3, -1), (3, 4, 1, 1), (3, 4, 1, -1), (5, 6, 2, -1), (5, 6, 3, 1), (7, 8, 0, 3), (7, 8, 2, -1), (7, 8, 3, 1), (7, 8, 4, 1)]


def test_versions(spark):
    log = spark.createDataFrame(REPEATED, "src long, dst long, t int, w int")
    v = VersionedEdges(log)
    assert rows(v.as_of(0)) == {(1, 2), (7, 8)} == rows(v.as_of(1)) == rows(v.as_of(2, strict=True))
    assert rows(v.as_of(2)) == set() == rows(v.as_of(0, strict=True))
    assert rows(v.as_of(4)) == {(5, 6), (7, 8)}
    assert rows(effective_changes(log)) == {(1, 2, 0, 1), (1, 2, 2, -1), (5, 6, 3, 1), (7, 8, 0, 1), (7, 8, 2, -1), (7, 8, 3, 1)}
    assert v.first_change_after(1).first()["t"] == 2
    assert VersionedEdges.empty(spark).update(log.where("src = 1 and t = 0").drop("t"), 4).as_of(4).count() == 1
    assert rows(VersionedEdges.initial(frame(spark, {(1, 2), (3, 3)})).as_of(0)) == {(1, 2)}
    assert rows(consolidate(log.select("src", "dst", "w"), keep_positive=True)) == {(7, 8, 4)}


def random_log(seed, nodes, n, epochs):
    """Inserts and deletes at random: many repeat what holds already."""
    rnd = random.Random(seed)
    return [(a, b, rnd.randrange(epochs), rnd.choice([1, 1, 1, -1, -2, 2])) for a, b in ((rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(n)) if a != b]


def test_merging_changes_no_later_answer(spark):
    raw = random_log(3, 6, 120, 6)
    log = spark.createDataFrame(raw, "src long, dst long, t int, w int")
    snaps = brute.snapshots(raw, range(-1, 6))
    v, triangle = VersionedEdges(log), Motif.clique(3)
    for t in range(6):
        assert rows(v.as_of(t)) == snaps[t]
    changes = rows(track(triangle, log))
    for t in (0, 2, 5):
        merged = v.merge_to(t)
        for later in range(t, 6):
            assert rows(merged.as_of(later)) == snaps[later]
        assert {r for r in rows(track(triangle, merged.log, t + 1))} == {r for r in changes if r[-2] > t}


def test_derivatives_one_by_one_are_the_same(spark):
    raw = random_log(5, 6, 80, 4)
    log = spark.createDataFrame(raw, "src long, dst long, t int, w int")
    for motif in (Motif.clique(3), Motif.of((0, 1), (1, 0), (1, 2)), Motif.cycle(4), Motif.of((0, 1), (1, 2), (2, 3), (1, 3))):
        one = sorted(map(tuple, raw_changes(motif, log, 1).collect()))
        assert one == sorted(map(tuple, raw_changes(motif, log, 1, "native").collect())), motif


def test_cliques_by_triangles(spark):
    raw = random_log(7, 7, 160, 4)
    log = spark.createDataFrame(raw, "src long, dst long, t int, w int")
    snaps = {t: brute.undirected(e) for t, e in brute.snapshots(raw, range(4)).items()}
    want = set()
    for t in range(1, 4):
        old, new = brute.cliques(snaps[t - 1], 4), brute.cliques(snaps[t], 4)
        want |= {(*c, 1, t) for c in new - old} | {(*c, -1, t) for c in old - new}
    got = track_cliques_by_triangles(log, 1).select("x0", "x1", "x2", "x3", "w", "t")
    assert rows(got) == want != set()


def test_a_function_as_time_validator(spark):
    held = spark.createDataFrame([(1, 2, 0, 3), (1, 3, 2, 9), (1, 4, 5, 9)], "src long, dst long, since int, until int")
    index = Index.forward(held)
    prefix = spark.createDataFrame([(1, 3)], "x long, t int")
    for rule, want in (("new", {3}), ("old", {2, 3}), (lambda since, until, t: since >= t, {4})):
        assert {r["y"] for r in Extender("x", index, rule).propose(prefix, "y").collect()} == want
        assert {r["y"] for r in extend(prefix, [Extender("x", index, rule), Extender("x", index, rule)], "y").collect()} == want


def test_nominate_prefers_the_first_of_equals(spark):
    edges = frame(spark, {(1, 2), (1, 3), (2, 3), (2, 4), (2, 5)})
    forward = Index.forward(edges)
    got = {(r["src"], r["dst"]): (r["cnt"], r["who"]) for r in nominate(edges, [Extender("src", forward), Extender("dst", forward)]).collect()}
    assert got == {(1, 2): (2, 0)}
    assert {(r["src"], r["dst"]): (r["cnt"], r["who"]) for r in nominate(edges, [Extender("src", forward), Extender("src", forward)]).collect()}[1, 2] == (2, 0)


def test_extend_checks_its_arguments(spark):
    edges = frame(spark, {(1, 2)})
    with pytest.raises(ValueError, match="strategy"):
        extend(edges, [Extender("dst", Index.forward(edges))], "x", "other")
    with pytest.raises(ValueError, match="constraint"):
        extend(edges, [], "x")
    with pytest.raises(ValueError, match="versioned"):
        Extender("dst", Index.forward(edges), "new")
    with pytest.raises(ValueError, match="key columns"):
        Extender(("src", "dst"), Index.forward(edges))
    assert factorised(edges, [Extender("src", Index.forward(edges))], "v").first()["v"] == [2]


@pytest.mark.parametrize("edges", [set(), {(1, 2)}, brute.random_edges(4, 9, 40), {(a, b) for a in range(6) for b in range(6) if a < b}, {(0, i) for i in range(1, 8)} | {(1, 2)}], ids=["empty", "one", "random", "K6", "star"])
def test_undirected_patterns(spark, edges):
    graph = Graph.of(frame(spark, edges | {(7, 7)}).union(frame(spark, edges)))
    f = brute.undirected(edges)
    for k in (3, 4, 5):
        assert rows(C.cliques(graph, k)) == brute.cliques(edges, k)
        assert C.count_cliques(graph, k).first()["n"] == len(brute.cliques(edges, k))
    tri = C.triangles(graph)
    for k in (4, 5):
        assert rows(C.cliques_from_triangles(tri, k)) == brute.cliques(edges, k)
    nbr = {x: {b if a == x else a for a, b in f if x in (a, b)} for e in f for x in e}
    struts = {(a, b, x, y) for a, b in f for x in nbr[a] & nbr[b] for y in nbr[a] & nbr[b] if x < y}
    assert rows(C.struts(tri)) == struts
    assert C.count_struts(tri).first()["n"] == len(struts)
    hats = {(a, b, x, y, v) for a, b, x, y in struts if (x, y) in f for v in (nbr[a] & nbr[b]) - {x, y}}
    assert rows(C.hats(graph)) == hats
    for seed in ("cliques", "triangles", "index"):
        assert C.count_hats(graph, seed).first()["n"] == len(hats)
    assert C.count_hats_by_common(graph).first()["n"] == len(hats)
    nodes = sorted(nbr)
    cycles = {(a, b, c, d) for a in nodes for b in nbr[a] for d in nbr[a] if a < b < d for c in nbr[b] & nbr[d] if c > a}
    assert C.four_cycles(graph).first()["n"] == len(cycles)
    fans = sum(1 for h in nodes for m in nbr[h] for p in nbr[h] & nbr[m] for q in nbr[h] & nbr[m] if p < q for x in (nbr[h] & nbr[p]) - {m, q} for y in (nbr[h] & nbr[q]) - {m, p} if x != y)
    assert C.count_fans(tri).first()["n"] == fans
    diamonds = sum(1 for a, b in edges for a2, c in edges if a == a2 and b < c for b2, d in edges if b2 == b and (c, d) in edges)
    assert C.diamonds(graph).first()["n"] == diamonds
    closed = {}
    for a, b in edges:
        if n := sum((a, c) in edges and (b, c) in edges for c in nodes if a != b and c not in (a, b)):
            closed[a, b] = n
    assert rows(C.common_targets(graph.edges)) == {(a, b, n) for (a, b), n in closed.items()}
    by_node = {}
    for (a, _), n in closed.items():
        by_node[a] = by_node.get(a, 0) + n
    assert rows(C.triangles_by_vertex(graph.edges)) == set(by_node.items())


@pytest.mark.parametrize("name", ["diamonds", "common_targets", "triangles_by_vertex", "count_fans", "count_hats_by_common", "four_cycles"])
def test_a_hub_costs_no_square(spark, name):
    """A star of 3,000 leaves with edges both ways: no join makes more than a few rows for each edge."""
    n = 3000
    graph = Graph(frame(spark, {(0, i) for i in range(1, n)} | {(i, 0) for i in range(1, n)} | {(1, 2), (2, 3), (1, 3)}))
    out = {"common_targets": lambda: C.common_targets(graph.edges), "triangles_by_vertex": lambda: C.triangles_by_vertex(graph.edges), "count_fans": lambda: C.count_fans(C.triangles(graph))}.get(name, lambda: getattr(C, name)(graph))()
    got = out.collect()
    made = [int(m["value"]) for m in joined_rows(out)]
    assert got and max(made, default=0) <= 20 * n


def test_graph_views(spark):
    graph = Graph.of(frame(spark, {(1, 2), (2, 1), (2, 3), (5, 2), (3, 3)}))
    assert rows(graph.oriented) == {(1, 2), (2, 3), (2, 5)}
    assert graph.symmetric.count() == 6
    assert rows(graph.degrees()) == {(1, 1), (2, 2), (5, 1)}
    assert rows(graph.total_degrees()) == {(1, 2), (2, 4), (3, 1), (5, 1)}
    assert rows(graph.smaller_neighbours()) == {(1, 0), (2, 1), (3, 1), (5, 1)}
    assert rows(graph.relabelled_by_degree()) == {(3, 0), (5, 1), (1, 2), (2, 3)}
    assert rows(graph.layout()) == {(2, 3), (0, 3), (1, 3)}
    assert rows(graph.fragment(1, 4)) == {(1, 2), (5, 2)}
    assert graph.sources().first()["n"] == 3
    assert {r["node"]: r["nbrs"] for r in graph.adjacency().collect()} == {1: [2], 2: [1, 3], 5: [2]}
