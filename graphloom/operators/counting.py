"""Counting the matches of any motif without listing them: attributes are eliminated one by one.

A factor is a table over some attributes with a weight n: how often its row occurs in what has been eliminated so far. At first each edge is one, all weights 1. To eliminate an attribute, the factors that
hold it, and those that lie within its neighbours, are joined into one, and the attribute is summed out: what remains is a factor over its neighbours, the separator. So the end of a path costs one aggregation of
an edge table, whatever the number of paths, and only the cyclic parts of a motif are ever joined.

The next attribute is the one with the fewest neighbours that are not already joined by an edge, then with the fewest neighbours. Within an elimination, its neighbours come first, from the factor that holds
most of them; the attribute itself comes last, by the generic join, where the shortest list of candidates proposes, and its values go into the sum without being kept. Weights are long integers; a sum beyond is an
error, not a wrong number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import total
from graphloom.operators.join import Extender, Index, extend
from graphloom.operators.match import named
from graphloom.plans.pattern import Motif


@dataclass
class Factor:
    """`rows` has a column x{a} for each attribute of `scope`, and n unless all weights are 1."""

    scope: frozenset[int]
    rows: DataFrame
    #: Of an edge: its attributes, and the index by each of them.
    ends: tuple[int, int] | None = None
    by: tuple[Index, Index] | None = None

    @property
    def weighted(self) -> bool:
        return "n" in self.rows.columns

    def columns(self) -> list[str]:
        return [f"x{a}" for a in sorted(self.scope)]


def elimination_order(motif: Motif) -> list[int]:
    """Attributes in the order in which they are summed out; the fewest new links between neighbours first, then the fewest neighbours, then the last attribute."""
    near = {a: {b for e in motif.edges if a in e for b in e} - {a} for a in range(motif.width)}
    order = []
    while near:
        def cost(a: int) -> tuple[int, int, int]:
            return sum(c not in near[b] for b in near[a] for c in near[a] if b < c), len(near[a]), -a

        v = min(near, key=cost)
        for b in near[v]:
            near[b] |= near[v] - {b}
            near[b].discard(v)
        del near[v]
        order.append(v)
    return order


def _times(rows: DataFrame, other: Factor) -> DataFrame:
    """Rows that the other factor holds as well, its weight multiplied in."""
    if not other.weighted:
        return rows.join(other.rows, other.columns(), "left_semi")
    if "n" not in rows.columns:
        return rows.join(other.rows, other.columns())
    joined = rows.withColumnRenamed("n", "_n").join(other.rows, other.columns())
    return joined.withColumn("n", F.col("_n") * F.col("n")).drop("_n")


def _join(factors: list[Factor], last: int) -> DataFrame:
    """The product of factors, attribute `last` bound as late as can be."""
    rest = sorted(factors, key=lambda f: (last in f.scope, -len(f.scope), f.weighted))
    first = rest.pop(0)
    rows, bound = first.rows, set(first.scope)
    while rest:
        inside = [f for f in rest if f.scope <= bound]
        for f in inside:
            rows = _times(rows, f)
        rest = [f for f in rest if f not in inside]
        if not rest:
            break
        new = min({a for f in rest if f.scope & bound for a in f.scope} - bound, key=lambda a: (a == last, a))
        edges = [f for f in rest if f.ends and new in f.scope and f.scope - {new} <= bound]
        if edges:
            sides = [Extender(f"x{a}", f.by[0 if f.ends[0] == a else 1]) for f in edges for a in f.scope - {new}]
            rows = extend(rows, sides, f"x{new}")
            bound.add(new)
            rest = [f for f in rest if f not in edges]
        else:
            f = next(f for f in rest if new in f.scope and f.scope & bound)
            weight = {"n": "_m"} if f.weighted else {}
            rows = rows.join(f.rows.withColumnsRenamed(weight), [f"x{a}" for a in sorted(f.scope & bound)])
            if f.weighted:
                rows = rows.withColumn("n", F.col("n") * F.col("_m") if "n" in rows.columns else F.col("_m")).drop("_m")
            bound |= f.scope
            rest = [g for g in rest if g is not f]
    return rows


def count_matches(motif: Motif, edges: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """n: the number of homomorphisms of the motif in one edge table, or in a table for each relation that it names."""
    tables = named(motif, edges)
    index = {id(t): (Index.forward(t), Index.reverse(t)) for t in tables.values()}
    factors = []
    for (a, b), name in zip(motif.edges, motif.names, strict=True):
        rows = tables[name].select(F.col("src").alias(f"x{a}"), F.col("dst").alias(f"x{b}"))
        factors.append(Factor(frozenset((a, b)), rows, (a, b), index[id(tables[name])]))
    for v in elimination_order(motif):
        own = [f for f in factors if v in f.scope]
        scope = reduce(frozenset.union, (f.scope for f in own))
        own = [f for f in factors if f.scope <= scope]
        factors = [f for f in factors if not f.scope <= scope]
        rows, kept = _join(own, v), sorted(scope - {v})
        summed = F.sum("n").alias("n") if "n" in rows.columns else F.count("*").alias("n")
        if not kept:
            return rows.agg(total("n" if "n" in rows.columns else F.lit(1)).alias("n"))
        factors.append(Factor(frozenset(kept), rows.groupBy(*(f"x{a}" for a in kept)).agg(summed)))
    raise AssertionError("the last attribute has no neighbours")
