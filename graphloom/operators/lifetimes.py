"""Cliques with the epochs in which they hold, found once for all epochs.

A match holds while all its edges do. So its lifetime is what the intervals of its edges have in common, and it appears and goes where that begins and ends: every match is found once, whatever number of edges
changed for it, and nothing has to cancel. Intervals of one edge never touch, so lifetimes of one match don't either. Where a good part of the edges changes within the epochs asked for, this replaces one derivative
for each edge of the motif; where few do, derivatives are the lesser work (`pays`).

Candidates never travel. Edges are oriented from the end of lower degree to the other, and go to cells by a colour of each node of a triangle they may be in: a cell finds the triangles with its three colours among
what it holds, candidates and all. Triangles are then dealt by their lowest node, and a task grows them to larger cliques from the triangles of that node alone: a fourth node closes a clique if it makes triangles with the
lowest node and each of the others. What is shuffled is edges, a few copies of each, and triangles, once. All joins stream through hash tables of what a task holds, so candidates are neither sorted nor written.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.join import ALL_KEYS, with_setting
from graphloom.operators.versioned import FOREVER
from graphloom.plans.pattern import Motif
from graphloom.storage import bucketed, materialize

#: Edges of one kind in a cell: what a hash table of one task holds. Below FEW edges in all there is one cell.
CELL_EDGES, FEW = 400_000, 5_000
#: Edges for each bucket of triangles, some twenty triangles an edge.
BUCKET_EDGES = 10_000


def clique_order(motif: Motif) -> tuple[list[int], bool] | None:
    """The attributes of a clique over one relation so that edges lead to later ones, and whether all edges lead back as well; None for any other motif."""
    edges, k = set(motif.edges), motif.width
    if len(motif.relations) > 1 or k < 3 or len({frozenset(e) for e in edges}) < k * (k - 1) // 2:
        return None
    out = [sum(a == e[0] for e in edges) for a in range(k)]
    order = sorted(range(k), key=lambda a: -out[a])
    if len(edges) == k * (k - 1):
        return order, True
    return (order, False) if sorted(out) == list(range(k)) else None


def pays(motif: Motif, changes: DataFrame, held: DataFrame, partly: bool) -> int | None:
    """The epoch from which on `changes` are all there are, if lifetimes give what they do to the motif by less work than derivatives do; else None. `partly`: not all changes may be among them."""
    n, first = changes.agg(F.count("*"), F.min("t")).first()
    if not n:
        return None
    turned = F.count_if(F.col("since") >= first) + F.count_if((F.col("until") >= first) & (F.col("until") < FOREVER))
    edges, every = held.agg(F.count("*"), turned).first()
    return first if n * len(motif.edges) >= edges and (not partly or every == n) else None


def mutual(held: DataFrame) -> DataFrame:
    """(src < dst, since, until): when there are edges both ways."""
    back = held.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    return held.where("src < dst").join(back, ["src", "dst"]).select("src", "dst", *_common(F.col("_since"), F.col("_until"))).where("since < until")


def _common(since: Column, until: Column) -> tuple[Column, Column]:
    return F.greatest("since", since).alias("since"), F.least("until", until).alias("until")


def _overlap(since: str, until: str) -> Column:
    return F.greatest("since", since) < F.least("until", until)


def ranked(held: DataFrame, directed: bool) -> DataFrame:
    """(a, b, rank, out, since, until): each edge from its end of lower degree (ties: lower number) to the other, b's degree, and whether it leads that way; always so for edges without directions."""
    degrees = materialize(held.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")), "degrees")
    rows = held.join(degrees.toDF("src", "_m"), "src").join(degrees.toDF("dst", "_n"), "dst")
    ahead = F.struct("_m", "src") < F.struct("_n", "dst")
    ends = [F.when(ahead, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("src", "dst", "a"), ("dst", "src", "b"), ("_n", "_m", "rank"))]
    return materialize(rows.select(*ends, (ahead if directed else F.lit(True)).alias("out"), "since", "until"), "ranked-edges")


def _kept(spark: SparkSession, parts: int) -> int:
    """At least `parts`, and as many as Spark leaves alone: what lies in fewer parts than it would deal by itself, it shuffles again ahead of each join, candidates included."""
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _in_cells(edges: DataFrame, colours: int) -> DataFrame:
    """(p0, p1, p2, f01, f02, f12, since, until): the triangles by rank, with the direction of each edge, without those that are cycles. One exchange; the joins run where the cell's edges lie."""
    parts = _kept(edges.sparkSession, 2 * colours**3)

    def sent(i: int, j: int, *names: str) -> DataFrame:
        """The edges as those from the i-th to the j-th node of a triangle, in each cell of their two colours."""
        own = F.pmod(F.xxhash64("a"), F.lit(colours)) * colours ** (2 - i) + F.pmod(F.xxhash64("b"), F.lit(colours)) * colours ** (2 - j)
        cells = F.array(*(own + F.lit(c * colours ** (i + j - 1)) for c in range(colours)))
        return edges.select(F.explode(cells).alias("cell"), *(F.col(c).alias(n) for c, n in zip(("a", "b", "out", "since", "until", "rank"), names, strict=False))).repartition(parts, "cell")

    second, third = (sent(*e).hint("shuffle_hash") for e in ((0, 2, "p0", "p2", "f02", "_since", "_until", "_rank"), (1, 2, "p1", "p2", "f12", "_from", "_to")))
    later = F.struct("rank", "p1") < F.struct("_rank", "p2")
    rows = sent(0, 1, "p0", "p1", "f01", "since", "until", "rank").join(second, ["cell", "p0"]).where(later & _overlap("_since", "_until"))
    rows = rows.select("cell", "p0", "p1", "p2", "f01", "f02", *_common(F.col("_since"), F.col("_until")))
    rows = rows.join(third, ["cell", "p1", "p2"]).where(_overlap("_from", "_to") & ((F.col("f01") != F.col("f12")) | (F.col("f01") == F.col("f02"))))
    return rows.select("p0", "p1", "p2", "f01", "f02", "f12", *_common(F.col("_from"), F.col("_to")))


def _placed(places: list[Column], leads: list[Column]) -> tuple[list[Column], Column]:
    """The places, in the order that the edges give, of a clique's nodes and of a new one to which some of them lead; and whether all edges agree with that order."""
    own = reduce(Column.__add__, [x.cast("int") for x in leads])
    return [*(s + (s >= own).cast("int") for s in places), own], reduce(Column.__and__, [x == (s < own) for s, x in zip(places, leads, strict=True)])


def _grown(triangles: DataFrame, k: int) -> DataFrame:
    """(p0, ..., s0, ..., since, until): cliques of k nodes by rank, and the place of each in the order of the edges. `triangles` lie by p0, so nothing is shuffled."""
    places, _ = _placed([F.lit(0)], [F.col("f01")])
    places, _ = _placed(places, [F.col("f02"), F.col("f12")])
    rows = triangles.select("p0", "p1", "p2", *(s.alias(f"s{i}") for i, s in enumerate(places)), "since", "until")
    near = triangles.toDF("_a", "_b", "_c", "_ab", "_ac", "_bc", "_since", "_until").hint("shuffle_hash")
    for n in range(3, k):
        held = [*(f"p{i}" for i in range(n)), *(f"s{i}" for i in range(n))]
        for turn, i in enumerate([n - 1, *range(1, n - 1)]):
            on = (F.col("_a") == F.col("p0")) & (F.col("_b") == F.col(f"p{i}")) & (F.col("_ab") == (F.col("s0") < F.col(f"s{i}")))
            if turn:  # the others filter what the last one's triangles propose
                on = on & (F.col("_c") == F.col(f"p{n}")) & (F.col("_ac") == F.col("l0"))
            new = [F.col(f"p{n}"), F.col("l0"), *(F.col(f"l{j}") for j in [n - 1, *range(1, n - 1)][:turn])] if turn else [F.col("_c").alias(f"p{n}"), F.col("_ac").alias("l0")]
            rows = rows.join(near, on & _overlap("_since", "_until")).select(*held, *new, F.col("_bc").alias(f"l{i}"), *_common(F.col("_since"), F.col("_until")))
        places, agree = _placed([F.col(f"s{i}") for i in range(n)], [F.col(f"l{i}") for i in range(n)])
        rows = rows.where(agree).select(*(f"p{i}" for i in range(n + 1)), *(s.alias(f"s{i}") for i, s in enumerate(places)), "since", "until")
    return rows


def clique_lifetimes(held: DataFrame, k: int, directed: bool = True) -> DataFrame:
    """(v0, ..., since, until), written: cliques of k >= 3 nodes and when they hold, with edges from each node to all later ones; without `directed`, each set of nodes once, in any order, of edges in any direction.

    `held` has (src, dst, since, until); without directions, no pair of nodes twice at a time.
    """
    edges = ranked(held, directed)
    n = edges.count()
    colours = 1 if n < FEW else max(4, math.ceil(math.sqrt(n / CELL_EDGES)))
    parts = _kept(edges.sparkSession, n // BUCKET_EDGES)
    found = _in_cells(edges, colours)

    def run() -> DataFrame:
        rows = _grown(found if k == 3 else bucketed(found, "triangles", ("p0",), parts), k)
        order = [F.coalesce(*(F.when(F.col(f"s{i}") == at, F.col(f"p{i}")) for i in range(k))).alias(f"v{at}") for at in range(k)]
        return materialize(rows.select(*order, "since", "until"), "lifetimes")

    # with all keys required, Spark would shuffle again by each join's own keys what lies by the cell or the lowest node
    return with_setting(ALL_KEYS, "false", run, edges)


def clique_changes(motif: Motif, held: DataFrame, since: int) -> DataFrame:
    """(x0, ..., t, w): the changes from epoch `since` on of a motif that `clique_order` knows."""
    order, both = clique_order(motif)
    # degrees and ranks both read the mutual edges
    found = clique_lifetimes(materialize(mutual(held), "mutual-edges") if both else held, motif.width, not both)
    turns = F.array(F.struct(F.col("since").alias("t"), F.lit(1).cast("long").alias("w")), F.struct(F.col("until").alias("t"), F.lit(-1).cast("long").alias("w")))
    rows = found.select(*found.columns[: motif.width], F.explode(turns).alias("turn")).select(*found.columns[: motif.width], "turn.*").where((F.col("t") >= since) & (F.col("t") < FOREVER))
    if both:  # every order of a clique's nodes is a match of its own
        orders = F.array(*(F.struct(*(F.col(f"v{v}").alias(f"x{a}") for a, v in enumerate(p))) for p in itertools.permutations(range(motif.width))))
        return rows.select(F.explode(orders).alias("m"), "t", "w").select("m.*", "t", "w")
    return rows.select(*(F.col(f"v{order.index(a)}").alias(f"x{a}") for a in range(motif.width)), "t", "w")
