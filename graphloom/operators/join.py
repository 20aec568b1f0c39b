"""Extending partial matches by one attribute: the multiway join.

A prefix table holds partial matches, one column for each bound attribute. An `Extender` relates some of its columns to candidate values of
a new attribute, by an index of (key, value) rows. `extend` keeps the values that all extenders allow. Strategies:

* `generic`: each prefix is extended by the extender that has the fewest candidates for it; the others only filter (semi-joins). The number of
  candidates never exceeds the smallest list, so a hub among the bound attributes does no harm. The first of equally short ones proposes.
* `native`: the first extender proposes for all prefixes; Catalyst orders and runs the joins.
* `array`: candidates stay one array for each prefix (`factorised`), intersected with adjacency arrays; best for counting.

Relations are sets. With `as_of`, index rows carry the epochs [since, until) in which they hold, and each prefix row its epoch t: "new" reads the index as
of t, "old" as of just before t, and a function of (since, until, t) reads the rows for which the column it gives is true.

No prefix is sent to a task for its hub alone: degrees are looked up in a table with one row a key, a join whose other side Spark splits where a key is hot. Where that isn't enough, an extender can say how rows are dealt: `route` gives
the value by which both sides of its joins are partitioned in place of the key's hash (rows that one task should see together), and `spread` the number of prefixes of one key from which they are dealt to several tasks, to each of which
that key's rows of the index are copied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize

STRATEGIES = ("generic", "native", "array")
#: With this setting off, rows that lie by a part of a join's keys need no shuffle for it.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: So many hot keys, a row of some 32 bytes each, are broadcast; more are joined by shuffle.
HOT_KEYS = 500_000
Validator = Callable[[Column, Column, Column], Column]


def choose(by: Column, options: Sequence[Column | int]) -> Column:
    """The option with the number that `by` holds; without a choice if all are the same."""
    options = [F.lit(o) if isinstance(o, int) else o for o in options]
    if len({str(o) for o in options}) == 1:
        return options[0]
    return F.coalesce(*(F.when(by == i, o) for i, o in enumerate(options)))


@dataclass
class Index:
    """(key..., val) rows; `since` and `until` too if it is versioned."""

    rows: DataFrame
    keys: tuple[str, ...] = ("key",)
    versioned: bool = False
    _degrees: DataFrame | None = field(default=None, repr=False)
    _arrays: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def forward(cls, edges: DataFrame) -> Index:
        """From source to targets."""
        more = [c for c in ("since", "until") if c in edges.columns]
        return cls(edges.select(F.col("src").alias("key"), F.col("dst").alias("val"), *more), versioned=bool(more))

    @classmethod
    def reverse(cls, edges: DataFrame) -> Index:
        """From target to sources."""
        more = [c for c in ("since", "until") if c in edges.columns]
        return cls(edges.select(F.col("dst").alias("key"), F.col("src").alias("val"), *more), versioned=bool(more))

    def degrees(self) -> DataFrame:
        """How many values each key has; of a versioned index, in any epoch (an upper bound is enough to choose by). Written once, for all joins that look degrees up."""
        if self._degrees is None:
            self._degrees = materialize(self.rows.groupBy(*self.keys).agg(F.count("*").alias("n")), "degrees")
        return self._degrees

    def arrays(self) -> DataFrame:
        """The values of each key as one sorted array."""
        if self._arrays is None:
            self._arrays = self.rows.groupBy(*self.keys).agg(F.array_sort(F.collect_set("val")).alias("vals"))
        return self._arrays


@dataclass
class Extender:
    """An index, and the columns (or expressions) of the prefix that are its key."""

    on: tuple[str | Column, ...]
    index: Index
    as_of: str | Validator | None = None
    route: Callable[..., Column] | None = None
    spread: int | None = None

    def __init__(self, on: str | Column | Sequence[str | Column], index: Index, as_of: str | Validator | None = None, route: Callable[..., Column] | None = None, spread: int | None = None):
        self.on = (on,) if isinstance(on, str | Column) else tuple(on)
        self.index, self.as_of, self.route, self.spread = index, as_of, route, spread
        if len(self.on) != len(index.keys):
            raise ValueError(f"the index has {len(index.keys)} key columns, not {len(self.on)}")
        if as_of not in (None, "old", "new") and not callable(as_of):
            raise ValueError(f"as_of is 'old', 'new' or a function, not {as_of!r}")
        if as_of and not index.versioned:
            raise ValueError("only a versioned index can be read as of an epoch")

    def _key(self) -> list[Column]:
        return [F.col(c) if isinstance(c, str) else c for c in self.on]

    def _matches(self, tag: str, value: str | None) -> tuple[DataFrame, Column]:
        """The index with names of its own, and the join condition; `value`: a prefix column that must be the value."""
        rows = self.index.rows
        renamed = rows.select(*(F.col(c).alias(f"_{tag}_{c}") for c in rows.columns))
        conditions = [k == F.col(f"_{tag}_{c}") for k, c in zip(self._key(), self.index.keys, strict=True)]
        if value:
            conditions.append(F.col(value) == F.col(f"_{tag}_val"))
        if self.as_of:
            conditions.append(self.valid(F.col(f"_{tag}_since"), F.col(f"_{tag}_until")))
        return renamed, reduce(Column.__and__, conditions)

    def valid(self, since: Column, until: Column) -> Column:
        """Whether an index row counts for a prefix row."""
        t = F.col("t")
        if callable(self.as_of):
            return self.as_of(since, until, t)
        return (since <= t) & (t < until) if self.as_of == "new" else (since < t) & (t <= until) if self.as_of else F.lit(True)

    def count(self, prefix: DataFrame, to: str) -> DataFrame:
        """The prefix with the number of its candidates; prefixes without any are dropped."""
        degrees = self.index.degrees().select(*(F.col(c).alias(f"_d_{c}") for c in self.index.keys), F.col("n").alias(to))
        on = reduce(Column.__and__, [k == F.col(f"_d_{c}") for k, c in zip(self._key(), self.index.keys, strict=True)])
        return self._joined(prefix, degrees, "_d_", on, "inner").select(*prefix.columns, to)

    def propose(self, prefix: DataFrame, to: str) -> DataFrame:
        """A row for each prefix and candidate."""
        rows, on = self._matches("p", None)
        return self._joined(prefix, rows, "_p_", on, "inner").withColumn(to, F.col("_p_val")).select(*prefix.columns, to)

    def intersect(self, extended: DataFrame, value: str) -> DataFrame:
        """The rows whose `value` is a candidate."""
        rows, on = self._matches("i", value)
        return self._joined(extended, rows, "_i_", on, "left_semi").select(*extended.columns)

    def _joined(self, left: DataFrame, right: DataFrame, tag: str, on: Column, how: str) -> DataFrame:
        """A join of a prefix table with the index (or its degrees), dealt as `route` and `spread` say."""
        if self.spread:
            left, right, on = self._salted(left, right, tag, on)
        if not self.route:
            return left.join(right, on, how)
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        extra = ["_salt"] if self.spread else []
        left = left.withColumn("_route", self.route(*self._key())).repartition(parts, "_route", *extra)
        right = right.withColumn(f"{tag}route", self.route(*(F.col(f"{tag}{c}") for c in self.index.keys))).repartition(parts, f"{tag}route", *(f"{tag}salt" for _ in extra))
        # with all keys required, Spark would shuffle both sides again by the key
        return with_setting(ALL_KEYS, "false", lambda: materialize(left.join(right.hint("merge"), on & (F.col("_route") == F.col(f"{tag}route")), how), "routed"), left)

    def hot_keys(self, prefix: DataFrame) -> DataFrame:
        """(_h0, ..., _parts): the keys with more than `spread` prefixes, and over how many tasks each is dealt; there are no more of them than prefixes divided by `spread`."""
        counts = prefix.groupBy(*(k.alias(f"_h{i}") for i, k in enumerate(self._key()))).agg(F.count("*").alias("_n")).where(F.col("_n") > self.spread)
        return materialize(counts.withColumn("_parts", F.ceil(F.col("_n") / self.spread)).drop("_n"), "hot-keys")

    def _salted(self, left: DataFrame, right: DataFrame, tag: str, on: Column) -> tuple[DataFrame, DataFrame, Column]:
        hot = self.hot_keys(left)
        if hot.count() <= HOT_KEYS:
            hot = F.broadcast(hot)

        def known(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
            return rows.join(hot, reduce(Column.__and__, [k == F.col(f"_h{i}") for i, k in enumerate(keys)]), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

        columns = [F.col(c) for c in left.columns]
        dealt = known(left, self._key()).select(*columns, F.pmod(F.xxhash64(*columns), F.col("_parts")).alias("_salt"))
        held = known(right, [F.col(f"{tag}{c}") for c in self.index.keys])
        copied = held.select(*right.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias(f"{tag}salt"))
        return dealt, copied, on & (F.col("_salt") == F.col(f"{tag}salt"))


def with_setting(key: str, value: str, run: Callable[[], DataFrame], like: DataFrame) -> DataFrame:
    """What `run` writes while a setting of the session has another value."""
    conf = like.sparkSession.conf
    held = conf.get(key)
    conf.set(key, value)
    try:
        return run()
    finally:
        conf.set(key, held)


def nominate(prefix: DataFrame, extenders: Sequence[Extender]) -> DataFrame:
    """The prefix with cnt, the fewest candidates that an extender has for it, and who, the first such extender."""
    columns = prefix.columns
    for i, e in enumerate(extenders):
        prefix = e.count(prefix, f"_n{i}")
    counts = [F.col(f"_n{i}") for i in range(len(extenders))]
    least = F.least(*counts) if len(counts) > 1 else counts[0]
    who = F.coalesce(*(F.when(n == least, F.lit(i)) for i, n in enumerate(counts)))
    return prefix.select(*columns, least.alias("cnt"), who.alias("who"))


def extend(prefix: DataFrame, extenders: Sequence[Extender], to: str, strategy: str = "generic") -> DataFrame:
    """A row for each prefix and each value of the new attribute `to` that all extenders allow."""
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {STRATEGIES}")
    if not extenders:
        raise ValueError("an attribute needs a constraint")
    if len(extenders) == 1:
        return extenders[0].propose(prefix, to)
    if strategy == "array" and not any(e.as_of for e in extenders):
        return factorised(prefix, extenders, "_vals").withColumn(to, F.explode("_vals")).drop("_vals")
    if strategy == "native":
        return reduce(lambda rows, e: e.intersect(rows, to), extenders[1:], extenders[0].propose(prefix, to))
    return _by_fewest(prefix, extenders, to)


def _by_fewest(prefix: DataFrame, extenders: Sequence[Extender], to: str) -> DataFrame:
    """One plan without branches: rows of all indexes lie in one table, by the index's number, and a row's nominee decides which part of it each join reads.

    The first join proposes; the others, one less than there are extenders, look the value up with the nominee's successors, in a circle.
    """
    if any(e.route or e.spread for e in extenders):
        return _by_nominee(prefix, extenders, to)
    k = len(extenders)
    keys = [f"_k{i}" for i in range(max(len(e.on) for e in extenders))]  # keys of other indexes may be narrower
    timed = any(e.as_of for e in extenders)
    indexes = list({id(e.index): e.index for e in extenders}.values())
    number = {id(x): n for n, x in enumerate(indexes)}
    none = F.lit(0).cast("long")

    def padded(columns: Sequence[Column]) -> list[Column]:
        return [*columns, *[none] * (len(keys) - len(columns))]

    def part(n: int, x: Index) -> DataFrame:
        epochs = [F.col("since").alias("_since"), F.col("until").alias("_until")] if x.versioned else [F.lit(None).cast("int").alias(c) for c in ("_since", "_until")]
        return x.rows.select(F.lit(n).alias("_index"), *(c.alias(name) for c, name in zip(padded([F.col(c) for c in x.keys]), keys, strict=True)), F.col("val").alias("_val"), *(epochs if timed else []))

    rows = reduce(DataFrame.unionByName, [part(n, x) for n, x in enumerate(indexes)])

    def condition(step: int) -> Column:
        who = F.pmod(F.col("who") + step, F.lit(k))
        parts = [F.col("_index") == choose(who, [number[id(e.index)] for e in extenders])]
        parts += [F.col(name) == choose(who, [padded(e._key())[i] for e in extenders]) for i, name in enumerate(keys)]
        if timed:
            parts.append(choose(who, [e.valid(F.col("_since"), F.col("_until")) for e in extenders]))
        return reduce(Column.__and__, parts)

    chosen = nominate(prefix, extenders)
    out = chosen.join(rows, condition(0)).select(*prefix.columns, "who", F.col("_val").alias(to))
    for step in range(1, k):
        out = out.join(rows, condition(step) & (F.col("_val") == F.col(to)), "left_semi")
    return out.select(*prefix.columns, to)


def _by_nominee(prefix: DataFrame, extenders: Sequence[Extender], to: str) -> DataFrame:
    """A branch for each nominee, so that each extender deals its own joins; the prefixes with their nominees are written once."""
    chosen = materialize(nominate(prefix, extenders), "nominated")
    parts = []
    for i, e in enumerate(extenders):
        own = e.propose(chosen.where(F.col("who") == i).select(*prefix.columns), to)
        parts.append(reduce(lambda rows, other: other.intersect(rows, to), [x for x in extenders if x is not e], own))
    return reduce(DataFrame.unionByName, parts)


def factorised(prefix: DataFrame, extenders: Sequence[Extender], to: str) -> DataFrame:
    """The prefix with an array of all values that the extenders allow; prefixes without any are dropped.

    A key's values must fit in a row: orient or relabel by degree first if the graph has hubs.
    """
    out = prefix
    for i, e in enumerate(extenders):
        arrays = e.index.arrays().select(*(F.col(c).alias(f"_a{i}_{c}") for c in e.index.keys), F.col("vals").alias(f"_v{i}"))
        on = reduce(Column.__and__, [k == F.col(f"_a{i}_{c}") for k, c in zip(e._key(), e.index.keys, strict=True)])
        out = out.join(arrays, on)
    values = reduce(F.array_intersect, [F.col(f"_v{i}") for i in range(len(extenders))])
    return out.select(*prefix.columns, values.alias(to)).where(F.size(to) > 0)
