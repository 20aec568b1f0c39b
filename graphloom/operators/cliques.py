"""Undirected patterns: triangles, cliques, struts, hats, fans, cycles and diamonds.

All start from edges that are oriented from nodes of lower to nodes of higher degree. A node has then at most sqrt(2m) edges out, so the arrays that are
intersected are short even at hubs, and a clique is found once, from its lowest node. Results name nodes by number, in ascending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import common, pairs, total, without
from graphloom.operators.graph import Graph
from graphloom.operators.join import Extender, Index, extend
from graphloom.storage import materialize


def _cliques_with_candidates(graph: Graph, k: int) -> DataFrame:
    """y1, ..., yk (each clique of k nodes once, in rank order; some that nothing extends are left out) and cand, the nodes above that extend it, in the order of ranks.

    A node that is taken from cand leaves only what comes after it to be extended with, so each row carries no more than that to the next join.
    """
    up = graph.upward()
    rows = up.select(F.col("node").alias("y1"), F.col("up").alias("cand"))
    for i in range(2, k + 1):
        rows = rows.select(*(f"y{j}" for j in range(1, i)), "cand", F.posexplode("cand").alias("at", f"y{i}"))
        rows = rows.select(*(f"y{j}" for j in range(1, i + 1)), F.slice("cand", F.col("at") + 2, F.size("cand")).alias("cand")).where(F.size("cand") > 0)
        rows = rows.join(up.withColumnsRenamed({"node": f"y{i}"}), f"y{i}", "left")
        rows = rows.select(*(f"y{j}" for j in range(1, i + 1)), F.coalesce(common("cand", "up"), F.array().cast("array<long>")).alias("cand"))
    return rows


def cliques(graph: Graph, k: int) -> DataFrame:
    """v1 < ... < vk: each clique of k >= 3 nodes once."""
    rows = _cliques_with_candidates(graph, k - 1).withColumn(f"y{k}", F.explode("cand"))
    nodes = F.array_sort(F.array(*(f"y{i}" for i in range(1, k + 1))))
    return rows.select(nodes.alias("v")).select(*(F.col("v")[i].alias(f"v{i + 1}") for i in range(k)))


def count_cliques(graph: Graph, k: int) -> DataFrame:
    """How many, without listing them: the last node is only counted."""
    return _cliques_with_candidates(graph, k - 1).agg(total(F.size("cand")).alias("n"))


def triangles(graph: Graph) -> DataFrame:
    """a < b < c"""
    return cliques(graph, 3).toDF("a", "b", "c")


def support(tri: DataFrame) -> DataFrame:
    """(s, d, third): each edge of each triangle with the third node."""
    sides = F.array(*(F.struct(F.col(s).alias("s"), F.col(d).alias("d"), F.col(x).alias("third")) for s, d, x in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))))
    return tri.select(F.explode(sides).alias("e")).select("e.*")


def struts(tri: DataFrame) -> DataFrame:
    """(v1, v3, v2, v4): an edge v1 < v3 and two common neighbours v2 < v4."""
    e = support(tri)
    return e.join(e.withColumnRenamed("third", "other"), ["s", "d"]).where("third < other").select(F.col("s").alias("v1"), F.col("d").alias("v3"), F.col("third").alias("v2"), F.col("other").alias("v4"))


def count_struts(tri: DataFrame) -> DataFrame:
    return support(tri).groupBy("s", "d").agg(F.count("*").alias("k")).agg(total(pairs("k")).alias("n"))


def four_cycles(graph: Graph) -> DataFrame:
    """How many cycles of four nodes there are: for each highest node and opposite node, the pairs of lower nodes between them.

    The wedges are walked from the lower end of a ranked edge, so a hub's edges aren't paired with each other.
    """
    ranked = graph.ranked()
    degree = graph.symmetric.groupBy("src").agg(F.count("*").alias("deg"))
    near = graph.symmetric.join(degree.withColumnsRenamed({"src": "dst"}), "dst").select(F.col("src").alias("low"), F.col("dst").alias("far"), F.struct("deg", "dst").alias("far_rank"))
    top = ranked.join(degree.withColumnsRenamed({"src": "high"}), "high").select("low", "high", F.struct(F.col("deg"), F.col("high").alias("dst")).alias("rank"))
    wedges = top.join(near, "low").where("far_rank < rank")
    return wedges.groupBy("high", "far").agg(F.count("*").alias("k")).agg(total(pairs("k")).alias("n"))


def cliques_from_triangles(tri: DataFrame, k: int) -> DataFrame:
    """v1 < ... < vk for k = 4 or 5, by joins of the triangle table on pairs of nodes."""
    tri = materialize(tri, "triangles")
    index = Index(tri.select(F.col("a").alias("k1"), F.col("b").alias("k2"), F.col("c").alias("val")), ("k1", "k2"))
    rows = tri.toDF("v1", "v2", "v3")
    rows = extend(rows, [Extender(p, index) for p in (("v1", "v2"), ("v1", "v3"), ("v2", "v3"))], "v4")
    if k == 5:
        rows = extend(rows, [Extender(p, index) for p in (("v1", "v2"), ("v3", "v4"))], "v5")
    return rows


def hats(graph: Graph) -> DataFrame:
    """(v2, v5, v3, v4, v1): an edge v2 < v5, two adjacent common neighbours v3 < v4, and one more common neighbour v1."""
    tri = materialize(triangles(graph), "triangles")
    e = support(tri)
    third = e.groupBy("s", "d").agg(F.collect_set("third").alias("near"))
    four = cliques(graph, 4)
    names = ["v1", "v2", "v3", "v4"]
    six = [(s, d, *[x for x in names if x not in (s, d)]) for i, s in enumerate(names) for d in names[i + 1 :]]
    bases = four.select(F.explode(F.array(*(F.struct(F.col(s).alias("s"), F.col(d).alias("d"), F.col(p).alias("p"), F.col(q).alias("q")) for s, d, p, q in six))).alias("e")).select("e.*")
    rows = bases.join(third, ["s", "d"]).select("s", "d", "p", "q", F.explode(without("near", F.col("p"), F.col("q"))).alias("v1"))
    return rows.select(F.col("s").alias("v2"), F.col("d").alias("v5"), F.col("p").alias("v3"), F.col("q").alias("v4"), "v1")


def _hat_total(bases: DataFrame, tri: DataFrame) -> DataFrame:
    """Each row (s, d) of `bases`, an edge with two adjacent common neighbours, gives as many hats as the edge has other common neighbours."""
    common_n = support(tri).groupBy("s", "d").agg(F.count("*").alias("k"))
    return bases.groupBy("s", "d").agg(F.count("*").alias("m")).join(common_n, ["s", "d"]).agg(total(F.col("m") * (F.col("k") - 2)).alias("n"))


def count_hats(graph: Graph, seeded_by: str = "cliques") -> DataFrame:
    """How many, in closed form: each edge of each 4-clique gives its number of common neighbours less two.

    `seeded_by` is where the 4-cliques come from: the ranked graph ("cliques"); the triangle table, extended by a node ("triangles"); or edges, by way of an index
    from two nodes to the third of their triangles ("index").
    """
    tri = materialize(triangles(graph), "triangles")
    if seeded_by == "index":
        third = Index(materialize(support(tri).toDF("k1", "k2", "val"), "thirds"), ("k1", "k2"))
        rows = extend(graph.oriented, [Extender(("s", "d"), third)], "v3")
        sides = [Extender((F.least(x, "v3"), F.greatest(x, "v3")), third) for x in ("s", "d")]
        bases = extend(rows, [Extender(("s", "d"), third), *sides], "v4").where("v3 < v4")
    else:
        four = cliques_from_triangles(tri, 4) if seeded_by == "triangles" else cliques(graph, 4)
        names = ["v1", "v2", "v3", "v4"]
        sides = [F.struct(F.col(s).alias("s"), F.col(d).alias("d")) for i, s in enumerate(names) for d in names[i + 1 :]]
        bases = four.select(F.explode(F.array(*sides)).alias("e")).select("e.*")
    return _hat_total(bases, tri)


def count_hats_by_common(graph: Graph) -> DataFrame:
    """The same from edges alone: the common neighbours of an edge's ends serve both as v3 and, adjacent to it, as v4, and their number gives the hats. No stage for the last node.

    A v4 comes either from the edge's common neighbours or from the neighbours of v3, whichever are fewer; pairs of common neighbours are never listed.
    """
    tri = materialize(triangles(graph), "triangles")
    near = materialize(support(tri), "near")
    of_edge = Index(near.toDF("k1", "k2", "val"), ("k1", "k2"))
    of_node = Index.forward(materialize(graph.oriented.toDF("src", "dst"), "oriented"))
    rows = near.withColumnRenamed("third", "v3")
    return _hat_total(extend(rows, [Extender("v3", of_node), Extender(("s", "d"), of_edge)], "v4"), tri)


def count_fans(tri: DataFrame, four: DataFrame | None = None) -> DataFrame:
    """How many fans there are: a hub, and a path of five of its neighbours. No path is listed. `four` are the 4-cliques, if there is a cheaper way to them than by the triangles.

    In the graph that a hub's neighbours form (its link), let d be degrees. The paths of five with middle m, arms p and q are the pairs of neighbours of m, each with (d_p - 1)(d_q - 1)
    ends, corrected where p and q are adjacent (a triangle of the link, so a 4-clique with the hub) and where the two ends coincide (a 4-cycle of the link):
    sum over m and p < q of (d_p - 1)(d_q - 1), less the sum over triangles of 2 (d_x + d_y + d_z) - 9, less four times the number of 4-cycles.
    """
    tri = materialize(tri, "triangles")
    e = support(tri)
    link = materialize(e.unionByName(e.select(F.col("d").alias("s"), F.col("s").alias("d"), "third")).toDF("hub", "x", "y"), "link")
    degree = materialize(link.groupBy("hub", "x").agg(F.count("*").alias("d")), "link-degrees")
    arms = link.join(degree.withColumnsRenamed({"x": "y", "d": "dy"}), ["hub", "y"])
    sums = arms.groupBy("hub", "x").agg(F.sum(F.col("dy") - 1).alias("s"), F.sum((F.col("dy") - 1) * (F.col("dy") - 1)).alias("q"))
    paths = sums.agg(total((F.col("s") * F.col("s") - F.col("q")) / 2).alias("n"))

    four = cliques_from_triangles(tri, 4) if four is None else four
    names = ["v1", "v2", "v3", "v4"]
    sides = [F.struct(F.col(s).alias("hub"), F.col(d).alias("x")) for i, s in enumerate(names) for d in names[i + 1 :]]
    held = four.select(F.explode(F.array(*sides)).alias("e")).groupBy("e.hub", "e.x").agg(F.count("*").alias("k"))
    # a clique is a triangle in the link of each of its four nodes; each of its edges is met twice, once from either end
    closed = held.join(degree, ["hub", "x"]).agg((total(F.col("k") * F.col("d")) * 4 - (total("k") / 6).cast("long") * 36).alias("n"))

    ends_ = degree.select("hub", "x", F.struct("d", "x").alias("rank"))
    ranked = link.join(ends_, ["hub", "x"]).withColumnRenamed("rank", "rank_x").join(ends_.withColumnsRenamed({"x": "y", "rank": "rank_y"}), ["hub", "y"])
    ranked = materialize(ranked.select("hub", "x", "y", "rank_x", "rank_y"), "link-ranked")
    top = ranked.where("rank_x < rank_y").select("hub", F.col("x").alias("low"), F.col("y").alias("high"), F.col("rank_y").alias("top"))
    far = ranked.select("hub", F.col("x").alias("low"), F.col("y").alias("far"), F.col("rank_y").alias("rank"))
    cycles = top.join(far, ["hub", "low"]).where("rank < top").groupBy("hub", "high", "far").agg(F.count("*").alias("k")).agg((total(pairs("k")) * 4).alias("n"))
    parts = paths.select("n").unionByName(closed.select((-F.col("n")).alias("n"))).unionByName(cycles.select((-F.col("n")).alias("n")))
    return parts.agg(total("n").alias("n"))


def diamonds(graph: Graph) -> DataFrame:
    """How many a -> b -> d, a -> c -> d with b < c there are (d may be a).

    But for d = a, where any two nodes with edges to and from a do, a diamond is a 4-cycle without directions. Each is found from its node of highest degree and the one opposite: the two others
    are walked from their own, shorter lists, as in `four_cycles`, and told apart by the directions of their two edges.
    """
    edges = graph.edges
    both = edges.select("src", "dst", F.lit(True).alias("out")).unionByName(edges.select(F.col("dst"), F.col("src"), F.lit(False)).toDF("src", "dst", "out"))
    sided = materialize(both.groupBy("src", "dst").agg(F.bool_or("out").alias("to"), F.bool_or(~F.col("out")).alias("back")), "sided")
    degree = materialize(sided.groupBy("src").agg(F.count("*").alias("deg")), "degrees")
    ranks = degree.select("src", F.struct("deg", "src").alias("rank"))
    ranked = sided.join(ranks.withColumnRenamed("rank", "rank_src"), "src").join(ranks.toDF("dst", "rank_dst"), "dst")
    ranked = materialize(ranked.select("src", "dst", "to", "back", "rank_src", "rank_dst"), "ranked")
    top = ranked.where("rank_src < rank_dst").select(F.col("src").alias("low"), F.col("dst").alias("high"), F.col("rank_dst").alias("top"), F.col("to").alias("up"), F.col("back").alias("down"))
    far = ranked.select(F.col("src").alias("low"), F.col("dst").alias("far"), F.col("rank_dst").alias("rank"), F.col("to").alias("out"), F.col("back").alias("into"))
    through = {"a": F.col("down") & F.col("out"), "b": F.col("up") & F.col("into"), "c": F.col("up") & F.col("out"), "d": F.col("down") & F.col("into")}
    counts = [F.count_if(on).alias(name) for name, on in through.items()]
    wedges = top.join(far, "low").where("rank < top").groupBy("high", "far").agg(*counts, F.count_if(through["c"] & through["d"]).alias("cd"))
    cycles = wedges.agg(total(pairs("a") + pairs("b") + F.col("c") * F.col("d") - F.col("cd")).alias("n"))
    mutual = sided.where(F.col("to") & F.col("back")).groupBy("src").agg(F.count("*").alias("k")).agg(total(pairs("k")).alias("n"))
    return cycles.unionByName(mutual).agg(total("n").alias("n"))


def common_sources(edges: DataFrame) -> DataFrame:
    """(x, y, z): for each edge y -> z, each x with x -> y and x -> z."""
    reverse = Index.reverse(edges)
    return extend(edges.toDF("y", "z"), [Extender("y", reverse), Extender("z", reverse)], "x").select("x", "y", "z")


def _closed(edges: DataFrame) -> DataFrame:
    """(src, dst, z): each edge with each target that its ends share; the end with fewer targets proposes them, so a hub's are never copied to all its edges."""
    forward = Index.forward(edges)
    return extend(edges.select("src", "dst"), [Extender("src", forward), Extender("dst", forward)], "z")


def common_targets(edges: DataFrame) -> DataFrame:
    """(src, dst, n): for each edge, how many targets its ends share, if any."""
    return _closed(edges).groupBy("src", "dst").agg(F.count("*").alias("n"))


def triangles_by_vertex(edges: DataFrame) -> DataFrame:
    """(node, n): directed triangles x -> y, x -> z, y -> z for each x with any."""
    return _closed(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
