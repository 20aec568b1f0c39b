"""A multiway join in one exchange: every row is sent to all cells of a grid in which it may meet a match, and each cell joins what it holds.

Each attribute has a share, the number of parts its values are hashed into; the shares multiply to the number of cells. An edge between two attributes knows two coordinates of its cells and is copied along the others: of
a triangle with 64 cells, each of the three relations is shuffled with 4 copies a row. After that one exchange, nothing is shuffled any more, however many edges the motif has: all joins have the cell among their keys and run
where the rows lie, sorted and merged by Spark. Partial matches never travel, which is what they do in an attribute-at-a-time join.

A value with so many edges that they would overfill its part is hot. Hot values get cells of their own: for each choice of the attributes that take hot values there is a grid by itself, in which these attributes have one
part and the others share all cells, so the edges of a hot value are spread by their other end. A row goes to the grids that agree with its own two ends. There are only so many hot values as a share has parts, so
their list is small by definition.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.join import ALL_KEYS, with_setting
from graphloom.plans.pattern import Motif
from graphloom.storage import materialize

CELLS = 64


@dataclass(frozen=True)
class Grid:
    """The cells for matches in which just the attributes of `hot` take hot values."""

    hot: frozenset[int]
    shares: tuple[int, ...]
    base: int  #: the number of its first cell

    @property
    def size(self) -> int:
        return reduce(int.__mul__, self.shares)

    def stride(self, a: int) -> int:
        return reduce(int.__mul__, self.shares[a + 1 :], 1)

    def copies(self, a: int, b: int) -> list[int]:
        """The cells, relative to its own coordinates, of an edge between two attributes."""
        others = [[i * self.stride(c) for i in range(s)] for c, s in enumerate(self.shares) if c not in (a, b)]
        return [self.base + sum(x) for x in itertools.product(*others)]


def shares(motif: Motif, cells: int, hot: frozenset[int] = frozenset()) -> tuple[int, ...]:
    """A share for each attribute: hot ones have one part; of the others, the one whose doubling copies the fewest rows doubles, as long as all fit in `cells`."""
    own = [1] * motif.width

    def rows(s: list[int]) -> int:
        return sum(reduce(int.__mul__, [x for c, x in enumerate(s) if c not in e], 1) for e in motif.edges)

    while True:
        wider = [[*own[:a], own[a] * 2, *own[a + 1 :]] for a in range(motif.width) if a not in hot]
        wider = [s for s in wider if reduce(int.__mul__, s) <= cells]
        if not wider:
            return tuple(own)
        own = min(wider, key=lambda s: (rows(s), s[::-1]))


def hot_values(edges: DataFrame, parts: int) -> list[int]:
    """The nodes with more edges out or in than one of `parts` parts should have: at most as many as twice the parts."""
    n = edges.count()
    often = [edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") * parts > n).select("node") for c in ("src", "dst")]
    return sorted(r["node"] for r in often[0].union(often[1]).distinct().collect())


class SharedJoin:
    """The grids of a motif over one edge table, and the rows that are sent to them."""

    def __init__(self, motif: Motif, edges: DataFrame, cells: int = CELLS):
        self.motif, self.edges = motif, materialize(edges.select("src", "dst").distinct(), "edges")
        self.hot = hot_values(self.edges, max(2, max(shares(motif, cells))))
        self.grids, base = [], 0
        for n in range(motif.width + 1 if self.hot else 1):
            for hot in itertools.combinations(range(motif.width), n):
                grid = Grid(frozenset(hot), shares(motif, cells, frozenset(hot)), base)
                self.grids.append(grid)
                base += grid.size
        self.cells = base

    def _is_hot(self, value: str) -> Column:
        return F.col(value).isin(self.hot) if self.hot else F.lit(False)

    def sent(self, i: int) -> DataFrame:
        """(cell, x{a}, x{b}): the rows of the i-th edge of the motif, a copy for each cell; this is what is shuffled."""
        a, b = self.motif.edges[i]
        lists = []
        for grid in self.grids:
            agrees = (self._is_hot("src") if a in grid.hot else ~self._is_hot("src")) & (self._is_hot("dst") if b in grid.hot else ~self._is_hot("dst"))
            own = F.pmod(F.xxhash64("src", F.lit(a)), F.lit(grid.shares[a])) * grid.stride(a) + F.pmod(F.xxhash64("dst", F.lit(b)), F.lit(grid.shares[b])) * grid.stride(b)
            cells = F.array(*(own + F.lit(c) for c in grid.copies(a, b)))
            lists.append(F.when(agrees, cells).otherwise(F.array().cast("array<bigint>")))
        return self.edges.select(F.explode(F.concat(*lists)).alias("cell"), F.col("src").alias(f"x{a}"), F.col("dst").alias(f"x{b}"))

    def _plan(self, parts: int) -> DataFrame:
        order = self.motif.plan(0)
        rest = list(range(1, len(self.motif.edges)))
        rows, bound = self.sent(0).repartition(parts, "cell"), set(order.order[:2])
        for attribute in (None, *order.order[2:]):
            if attribute is not None:
                bound.add(attribute)
            for i in [i for i in rest if set(self.motif.edges[i]) <= bound]:
                keys = ["cell", *(f"x{a}" for a in dict.fromkeys(self.motif.edges[i]) if f"x{a}" in rows.columns)]
                rows = rows.join(self.sent(i).repartition(parts, "cell").hint("merge"), keys, "left_semi" if len(keys) == 3 else "inner")
                rest.remove(i)
        return rows.select(*self.motif.columns)

    def matches(self) -> DataFrame:
        """x0, x1, ...: all matches, written. A match lies in just one cell: its values say which grid and which coordinates."""
        return with_setting(ALL_KEYS, "false", lambda: materialize(self._plan(parts_of(self.edges.sparkSession, self.cells)), "shared-join"), self.edges)


def parts_of(spark: SparkSession, cells: int) -> int:
    """Partitions that hold the cells: as many as there are cells, but not more than four for each of the session's."""
    return max(1, min(cells, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def match_by_shares(motif: Motif, edges: DataFrame, cells: int = CELLS) -> DataFrame:
    """What `match` gives, by one exchange."""
    return SharedJoin(motif, edges, cells).matches()
