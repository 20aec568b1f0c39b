"""Derivatives in parts of bounded size, one after another.

One round of joins over all changes may list more partial matches than there is disk for: the changes of a 6-clique multiply with each attribute. Here the partial matches are extended depth first. At each step,
every prefix is given its number of candidates from the degrees (what its nominee will propose, so an upper bound of what the step makes of it), and prefixes are dealt into parts whose
numbers add up to at most `budget`. A part is extended, and what it gives is dealt into parts in turn, down to whole matches, before the next part begins. So a table of one part for each step exists at a
time, and none has more rows than the budget, unless a single prefix has more candidates.

Cliques of which a good part changes need no parts: found with their lifetimes (`lifetimes`), no partial match but triangles is ever written. `track_in_parts` leaves these to `track`; `TrackInParts` itself deals any motif into parts.

Parts are restartable: a part's matches are written when it is done, and a run over the same folder goes on after the last one. Dealing is by a hash of the prefix, so it is the same again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.match import Rounds, driving_changes, track_by_lifetimes
from graphloom.operators.versioned import consolidate
from graphloom.plans.pattern import Motif
from graphloom.storage import delete, exists

#: Rows that a step may make of one part.
BUDGET = 20_000_000


@dataclass
class TrackInParts:
    """One run over a log. `path` is a folder in the shared file system that belongs to this run."""

    spark: SparkSession
    motif: Motif
    path: str
    budget: int = BUDGET
    #: Rows of each table of prefixes that this run wrote, by the part's name.
    made: dict[str, int] = field(default_factory=dict)

    def _done(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}/_SUCCESS")

    def _table(self, df: DataFrame | None, name: str) -> DataFrame:
        """The table of this name; written from `df` if an earlier run hasn't."""
        if df is not None and not self._done(name):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def run(self, log: DataFrame | Mapping[str, DataFrame], since: int | None = None, driven_by: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """(x0, ..., w, t), as `track` gives them."""
        if not self._done("prefixes"):
            changes, validity = driving_changes(self.motif, log, since, driven_by)
            self._table(self.spark.createDataFrame([(i,) for i, name in enumerate(self.motif.names) if name in changes], "start int"), "starts")
            self._table(Rounds.indexes(self.motif, validity), "index")
            self._table(Rounds.count_keys(self._table(None, "index")), "degrees")
            self._table(self._rounds().prefixes(changes), "prefixes")
        rounds = self._rounds()
        if not rounds.rounds:
            return consolidate(rounds.matches(self._table(None, "prefixes")))
        self._step(rounds, "prefixes", "p", 0)
        return consolidate(self.spark.read.parquet(f"{self.path}/matches/*"))

    def _rounds(self) -> Rounds:
        starts = sorted(r["start"] for r in self._table(None, "starts").collect())  # one an edge of the motif
        return Rounds(self.motif, starts, self._table(None, "index"), self._table(None, "degrees"))

    def _deal(self, rows: DataFrame) -> int:
        """A number of parts, each within the budget; those above it hold one prefix."""
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0))).first()
        parts = max(1, -(-total // self.budget))
        while 1 < parts <= n:
            sums = rows.groupBy(F.pmod("hash", F.lit(parts))).agg(F.sum("cnt").alias("n"), F.count("*").alias("rows"))
            if sums.where((F.col("n") > self.budget) & (F.col("rows") > 1)).isEmpty():
                break
            parts *= 2
        return parts

    def _step(self, rounds: Rounds, table: str, name: str, step: int) -> None:
        """Extends a table of prefixes part by part, each to the end."""
        rows = rounds.nominate(self._table(None, table), step)
        rows = self._table(rows.withColumn("hash", F.xxhash64(*(F.col(c) for c in rows.columns if c not in ("cnt", "who")))), f"nominated/{name}")
        parts = self._deal(rows)
        for part in range(parts):
            own = f"{name}.{part}of{parts}"
            if self._done(f"finished/{own}"):
                continue
            grown = rounds.extend(rows.where(F.pmod("hash", F.lit(parts)) == part).drop("hash"), step)
            if step == rounds.rounds - 1:
                self._table(rounds.matches(grown), f"matches/{own}")
                self.made[own] = self._table(None, f"matches/{own}").count()
            else:
                self.made[own] = self._table(grown, f"extended/{own}").count()
                if self.made[own]:
                    self._step(rounds, f"extended/{own}", own, step + 1)
                delete(self.spark, [f"{self.path}/extended/{own}", f"{self.path}/nominated/{own}"])
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/finished/{own}")
        if not self._done("matches/none") and name == "p":
            empty = rounds.matches(rounds.index.sparkSession.createDataFrame([], ", ".join([*(f"p{i} long" for i in range(self.motif.width)), "w int, t int, start int"])))
            self._table(empty, "matches/none")


def track_in_parts(motif: Motif, log: DataFrame | Mapping[str, DataFrame], path: str, since: int | None = None, budget: int = BUDGET, driven_by: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """What `track` gives, in parts of at most `budget` partial matches; called again with the same `path` after a failure, it goes on where it stopped."""
    spark = (log if isinstance(log, DataFrame) else next(iter(log.values()))).sparkSession
    if not exists(spark, f"{path}/prefixes/_SUCCESS"):
        changes, validity = driving_changes(motif, log, since, driven_by)
        if (found := track_by_lifetimes(motif, changes, validity, driven_by is not None)) is not None:
            return found
    return TrackInParts(spark, motif, path, budget).run(log, since, driven_by)
