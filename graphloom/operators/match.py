"""Matches of a motif in a graph, and how they change with it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.join import Extender, Index, choose, extend
from graphloom.operators.lifetimes import clique_changes, clique_order, pays
from graphloom.operators.versioned import FOREVER, changes_of, consolidate, held_in, turns, undirected
from graphloom.plans.pattern import Motif, MotifError
from graphloom.storage import bucketed, materialize


def _bound(rows: DataFrame, motif: Motif, start: int, *more: str) -> DataFrame:
    a, b = motif.edges[start]
    return rows.select(F.col("src").alias(f"x{a}"), F.col("dst").alias(f"x{b}"), *more)


def named(motif: Motif, given: DataFrame | Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The table of each relation of a motif; one table alone is that of all."""
    if isinstance(given, DataFrame):
        return dict.fromkeys(motif.relations, given)
    if missing := [name for name in motif.relations if name not in given]:
        raise MotifError(f"no table for the relations {missing}")
    return {name: given[name] for name in motif.relations}


def _both_ways(motif: Motif, tables: Mapping[str, DataFrame]) -> dict[tuple[str, bool], Index]:
    """The forward (True) and reverse index of each relation; relations of one table share theirs."""
    made = {id(t): (Index.forward(t), Index.reverse(t)) for t in tables.values()}
    return {(name, ahead): made[id(tables[name])][0 if ahead else 1] for name in motif.relations for ahead in (True, False)}


def match(motif: Motif, edges: DataFrame | Mapping[str, DataFrame], seeds: DataFrame | None = None, strategy: str = "generic") -> DataFrame:
    """x0, x1, ...: all matches in one edge table, or in a table for each relation that the motif names.

    `seeds` (src, dst) are the bindings of the first edge to start from; without them, all rows of its relation.
    """
    tables, plan = named(motif, edges), motif.plan(0)
    index = _both_ways(motif, tables)
    rows = _bound(tables[motif.names[0]] if seeds is None else seeds, motif, 0)
    for (src, dst, _), name in zip(plan.within, plan.within_names, strict=True):
        rows = Extender(f"x{src}", index[name, True]).intersect(rows, f"x{dst}")
    for attribute, step in zip(plan.order[2:], plan.steps, strict=True):
        rows = extend(rows, [Extender(f"x{c.bound}", index[c.relation, c.forward]) for c in step], f"x{attribute}", strategy)
    return rows.select(*motif.columns)


def derivative(motif: Motif, start: int, changes: DataFrame, validity: DataFrame | Mapping[str, DataFrame], strategy: str = "generic") -> DataFrame:
    """(x0, ..., w, t): what the changes of one edge's relation do there, with earlier edges as of the epoch and later ones as of before it.

    All epochs are handled in one plan: the index rows carry the epochs in which they hold, and the joins compare them with each change's own.
    """
    plan, index = motif.plan(start), _both_ways(motif, named(motif, validity))
    rows = _bound(changes, motif, start, "w", "t")
    for (src, dst, prior), name in zip(plan.within, plan.within_names, strict=True):
        rows = Extender(f"x{src}", index[name, True], "new" if prior else "old").intersect(rows, f"x{dst}")
    for attribute, step in zip(plan.order[2:], plan.steps, strict=True):
        rows = extend(rows, [Extender(f"x{c.bound}", index[c.relation, c.forward], "new" if c.prior else "old") for c in step], f"x{attribute}", strategy)
    return rows.select(*motif.columns, "w", "t")


class Rounds:
    """The derivatives of several edges of a motif in one chain of joins.

    Each change becomes a prefix for each edge it may stand for (`start`), bound to the places 0 and 1 of that edge's plan. A step of all plans is one round of joins against one table of all relations' indexes
    in both directions, in which a row's start and nominee say which index it reads, by which place, and as of when. Plans with fewer constraints at a step repeat one.
    """

    def __init__(self, motif: Motif, starts: Sequence[int], index: DataFrame, degrees: DataFrame, members: DataFrame | None = None):
        """`members` has the rows of `index` too; what proposes reads the one, what filters the other, so each can lie by its own keys."""
        self.motif, self.index, self.degrees, self.members = motif, index, degrees, index if members is None else members
        self.starts, self.plans = list(starts), [motif.plan(i) for i in starts]
        self.number = {name: 2 * n for n, name in enumerate(motif.relations)}
        self.rounds = motif.width - 2

    @staticmethod
    def indexes(motif: Motif, validity: Mapping[str, DataFrame]) -> DataFrame:
        """(_index, _key, _val, _since, _until): a relation's rows by source under an even number, and by target under the next."""
        parts = []
        for n, name in enumerate(motif.relations):
            rows = validity[name]
            parts.append(rows.select(F.lit(2 * n).alias("_index"), F.col("src").alias("_key"), F.col("dst").alias("_val"), F.col("since").alias("_since"), F.col("until").alias("_until")))
            parts.append(rows.select(F.lit(2 * n + 1).alias("_index"), F.col("dst").alias("_key"), F.col("src").alias("_val"), F.col("since").alias("_since"), F.col("until").alias("_until")))
        return reduce(DataFrame.unionByName, parts)

    @classmethod
    def over(cls, motif: Motif, starts: Sequence[int], validity: Mapping[str, DataFrame], copartition: bool) -> Rounds:
        """With indexes that are read from where `validity` lies, or with `copartition` written once in buckets of the keys that joins have: (index, key) to count and propose by, (index, key, value) to filter by."""
        index = cls.indexes(motif, validity)
        if not copartition:
            return cls(motif, starts, index, materialize(cls.count_keys(index), "degrees"))
        proposing = bucketed(index, "index", ("_index", "_key"))
        # counted where the rows lie: no shuffle, and what is written lies the same way
        degrees = bucketed(cls.count_keys(proposing), "degrees", ("_index", "_key"))
        return cls(motif, starts, proposing, degrees, bucketed(index, "members", ("_index", "_key", "_val")))

    @staticmethod
    def count_keys(index: DataFrame) -> DataFrame:
        return index.groupBy("_index", "_key").agg(F.count("*").alias("_n"))

    @staticmethod
    def _read(table: list[tuple], width: int, turn: Column | int) -> list[Column]:
        """What a row's plan says at a turn; a constant where all plans say the same."""
        spot = F.col("start") * width + turn
        return [F.lit(values[0]) if len(set(values)) == 1 else F.get(F.array(*map(F.lit, values)), spot) for values in zip(*table, strict=True)]

    def prefixes(self, changes: Mapping[str, DataFrame]) -> DataFrame:
        """(p0, p1, w, t, start) of the changes (src, dst, w, t) of each relation, where what the motif has within the starting pair holds as well."""
        parts = []
        for name, rows in changes.items():
            own = [s for s, i in enumerate(self.starts) if self.motif.names[i] == name]
            if own:
                parts.append(rows.select(F.col("src").alias("p0"), F.col("dst").alias("p1"), "w", "t", F.explode(F.array(*map(F.lit, own))).alias("start")))
        rows = reduce(DataFrame.unionByName, parts)
        width = max(len(plan.within) for plan in self.plans)
        if not width:
            return rows
        table: list[tuple] = []  # by start and turn: index, place of the key, of the value, epochs to go back
        for plan in self.plans:
            place = {a: i for i, a in enumerate(plan.order)}
            own = [(self.number[name], place[src], place[dst], 0 if prior else 1) for (src, dst, prior), name in zip(plan.within, plan.within_names, strict=True)] or [(0, 0, 1, 0)]
            table += (own * width)[:width]
        free = [s for s, plan in enumerate(self.plans) if not plan.within]
        held = rows.where(~F.col("start").isin(free)) if free else rows
        pair = F.array("p0", "p1")
        for turn in range(width):
            index, key, val, back = self._read(table, width, turn)
            when = F.col("t") - back
            holds = (F.col("_index") == index) & (F.col("_key") == F.get(pair, key)) & (F.col("_val") == F.get(pair, val)) & (F.col("_since") <= when) & (when < F.col("_until"))
            held = held.join(self.members, holds, "left_semi")
        return held.unionByName(rows.where(F.col("start").isin(free))) if free else held

    def _constraints(self, step: int) -> tuple[int, Callable[[Column | int], tuple[Column, Column, Column]]]:
        width = max(len(plan.steps[step]) for plan in self.plans)
        table: list[tuple] = []  # by start and turn: index, place, epochs to go back; a plan with fewer constraints repeats them
        for plan in self.plans:
            place = {a: i for i, a in enumerate(plan.order)}
            own = [(self.number[c.relation] + (0 if c.forward else 1), place[c.bound], 0 if c.prior else 1) for c in plan.steps[step]]
            table += (own * width)[:width]
        places = F.array(*(f"p{i}" for i in range(step + 2)))

        def read(turn: Column | int) -> tuple[Column, Column, Column]:
            """The index, key and epoch that a row reads with at a turn."""
            index, place, back = self._read(table, width, turn)
            return index, F.get(places, place), F.col("t") - back

        return width, read

    def nominate(self, rows: DataFrame, step: int) -> DataFrame:
        """The prefixes with cnt, the fewest candidates that a constraint has for them (an upper bound, in any epoch), and who, its number; those without any are dropped."""
        width, read = self._constraints(step)
        bound = rows.columns
        for i in range(width):
            index, key, _ = read(i)
            rows = rows.join(self.degrees.withColumnsRenamed({"_n": f"_n{i}"}), (F.col("_index") == index) & (F.col("_key") == key)).drop("_index", "_key")
        counts = [F.col(f"_n{i}") for i in range(width)]
        least = F.least(*counts) if width > 1 else counts[0]
        return rows.select(*bound, least.alias("cnt"), F.coalesce(*(F.when(n == least, F.lit(i)) for i, n in enumerate(counts))).alias("who"))

    def extend(self, rows: DataFrame, step: int) -> DataFrame:
        """Nominated prefixes with each value of the next place: one join proposes, the others filter."""
        width, read = self._constraints(step)
        bound, new = [c for c in rows.columns if c not in ("cnt", "who")], f"p{step + 2}"
        for turn in range(width):
            index, key, when = read(F.pmod(F.col("who") + turn, F.lit(width)))
            holds = (F.col("_index") == index) & (F.col("_key") == key) & (F.col("_since") <= when) & (when < F.col("_until"))
            if turn:
                rows = rows.join(self.members, holds & (F.col("_val") == F.col(new)), "left_semi")
            else:
                rows = rows.join(self.index, holds).select(*bound, "who", F.col("_val").alias(new))
        return rows.drop("who")

    def matches(self, rows: DataFrame) -> DataFrame:
        """(x0, ..., w, t) of whole prefixes."""
        columns = [choose(F.col("start"), [F.col(f"p{plan.order.index(a)}") for plan in self.plans]).alias(f"x{a}") for a in range(self.motif.width)]
        return rows.select(*columns, "w", "t")


def driving_changes(motif: Motif, log: DataFrame | Mapping[str, DataFrame], since: int | None = None, driven_by: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(src, dst, w, t) by relation that drives something, and (src, dst, since, until) by relation, all written.

    A table with a column t is a log, of which the edges' turns are written once; one without holds edges that never change, and drives nothing. With `driven_by`, only the relations that it names drive, each by those changes whose edge and epoch are in its table.
    """
    tables, done = named(motif, log), {}
    changes, validity = {}, {}
    for name, table in tables.items():
        if id(table) not in done:
            if "t" in table.columns:  # each is read by every join of every derivative: written once, so that plans stay small and nothing is computed twice
                turned = materialize(turns(table.select("src", "dst", "t", "w")), "turns")
                own = changes_of(turned)
                done[id(table)] = own if since is None else own.where(F.col("t") >= since), held_in(turned)
            else:
                held = table.select("src", "dst").distinct()
                done[id(table)] = None, materialize(held.select("src", "dst", F.lit(-FOREVER).alias("since"), F.lit(FOREVER).alias("until")), "intervals")
        own, validity[name] = done[id(table)]
        if own is not None and driven_by is None:
            changes[name] = own
        elif own is not None and name in driven_by:
            changes[name] = materialize(own.join(driven_by[name].select("src", "dst", "t").distinct(), ["src", "dst", "t"], "left_semi"), "driving-changes")
    if not changes:
        raise MotifError("no relation of the motif changes")
    return changes, validity


def raw_changes(motif: Motif, log: DataFrame | Mapping[str, DataFrame], since: int | None = None, strategy: str = "generic", driven_by: Mapping[str, DataFrame] | None = None, copartition: bool = False) -> DataFrame:
    """The derivatives of all edges whose relation changes, together; a match may occur more than once, with weights that cancel.

    `copartition` writes the indexes in buckets of their keys first, for logs too large to be broadcast: then each of the many joins shuffles its partial matches alone.
    """
    return _derivatives(motif, *driving_changes(motif, log, since, driven_by), strategy, copartition)


def _derivatives(motif: Motif, changes: Mapping[str, DataFrame], validity: Mapping[str, DataFrame], strategy: str, copartition: bool) -> DataFrame:
    starts = [i for i, name in enumerate(motif.names) if name in changes]
    if strategy != "generic":
        return reduce(DataFrame.unionByName, [derivative(motif, i, changes[motif.names[i]], validity, strategy) for i in starts])
    rounds = Rounds.over(motif, starts, validity, copartition)
    rows = rounds.prefixes(changes)
    for step in range(rounds.rounds):
        rows = rounds.extend(rounds.nominate(rows, step), step)
    return rounds.matches(rows)


def track(motif: Motif, log: DataFrame | Mapping[str, DataFrame], since: int | None = None, strategy: str = "generic", driven_by: Mapping[str, DataFrame] | None = None, copartition: bool = False) -> DataFrame:
    """(x0, ..., w, t): the matches that each epoch (from `since` on) adds, w = 1, and removes, w = -1.

    `log` is one log that all edges of the motif read, or a table for each relation that it names: a log (src, dst, t, w), or edges (src, dst) that never change. `driven_by` has logs by relation: only the changes
    in them are followed (a stream of queries over an index that holds both them and the graph); what else changes is read as of the epoch, but drives nothing.

    Cliques of which a good part changes are found once with their lifetimes; other motifs, and few changes of many edges, by the derivatives of each edge.
    """
    changes, validity = driving_changes(motif, log, since, driven_by)
    if strategy == "generic" and not copartition and (found := track_by_lifetimes(motif, changes, validity, driven_by is not None)) is not None:
        return found
    return consolidate(_derivatives(motif, changes, validity, strategy, copartition))


def track_by_lifetimes(motif: Motif, changes: Mapping[str, DataFrame], validity: Mapping[str, DataFrame], partly: bool = False) -> DataFrame | None:
    """What `track` gives, for a clique whose changes are many enough that to find each match once is the lesser work; else None. `partly`: `changes` may be some of them only."""
    if not clique_order(motif):
        return None
    name = motif.relations[0]
    first = pays(motif, changes[name], validity[name], partly)
    return None if first is None else clique_changes(motif, validity[name], first)


def track_cliques_by_triangles(log: DataFrame, since: int | None = None) -> DataFrame:
    """(x0, ..., x3, w, t): the changes of 4-cliques x0 < x1 < x2 < x3 of the graph without directions, by way of those of triangles.

    The changes of the triangle table T are a log of their own. A 4-clique is T(a, b, c), T(a, b, d) and T(a, c, d); each of the three is changed in turn and extended by the fourth node with indexes from
    two nodes of a triangle to the third, earlier tables as of the epoch and later ones as of before it.
    """
    tri = materialize(track(Motif.clique(3), undirected(log)).select("x0", "x1", "x2", "w", "t"), "triangle-changes")
    nodes = [F.col(f"x{i}") for i in range(3)]
    life = F.lead("t").over(Window.partitionBy("x0", "x1", "x2").orderBy("t"))
    held = tri.withColumn("until", F.coalesce(life, F.lit(FOREVER))).where("w > 0").select(*nodes, F.col("t").alias("since"), "until")
    held = materialize(held, "triangles-held")

    def index(key: tuple[int, int], val: int) -> Index:
        return Index(held.select(nodes[key[0]].alias("k1"), nodes[key[1]].alias("k2"), nodes[val].alias("val"), "since", "until"), ("k1", "k2"), versioned=True)

    last, middle = index((0, 1), 2), index((0, 2), 1)
    changes = materialize(tri if since is None else tri.where(F.col("t") >= since), "recent-triangle-changes")
    # the triangle that changes, the node it lacks, and how the two other triangles give it
    terms = [
        ("abc", "d", [(("a", "b"), last, "old"), (("a", "c"), last, "old")]),
        ("abd", "c", [(("a", "b"), last, "new"), (("a", "d"), middle, "old")]),
        ("acd", "b", [(("a", "c"), middle, "new"), (("a", "d"), middle, "new")]),
    ]
    parts = [extend(changes.toDF(*own, "w", "t"), [Extender(key, x, as_of) for key, x, as_of in using], new) for own, new, using in terms]
    found = reduce(DataFrame.unionByName, parts).select(*(F.col(c).alias(f"x{i}") for i, c in enumerate("abcd")), "w", "t")
    return consolidate(found)


def epoch_counts(changes: DataFrame) -> DataFrame:
    """(t, n_changes, net) for each epoch with changes."""
    return changes.groupBy("t").agg(F.count("*").alias("n_changes"), F.sum("w").cast("long").alias("net"))


def running_total(counts: DataFrame, base: int = 0) -> DataFrame:
    """(t, total): the sum of net changes up to each epoch; a row an epoch, so its window is small whatever the graph's size."""
    return counts.select("t", (F.lit(base) + F.sum("net").over(Window.orderBy("t"))).cast("long").alias("total"))
