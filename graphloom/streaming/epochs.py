"""Streams whose rows carry epochs of their own, and the frontier that says which epochs are complete.

Rows (src, dst, t, w, sender) come in any order and any micro-batch. They wait in a pending table until no more rows of their epoch can come; then all rows of all complete epochs are released together, and the
motif's changes are computed for each epoch as if it had come alone. What is known to be complete is the frontier: the least epoch that may still get rows. It follows from

* marks: a row without src and dst says that its sender will send nothing before epoch t any more (`InputSession.advance_to` writes one). The frontier is the least mark over all senders, which are named at the outset; or
* a watermark: with `lateness` n, once a row of epoch t was seen, epochs before t - n are taken for complete.

Rows that come too late for their epoch are an error (`late="error"`) or belong to the first epoch that is still open (`late="next"`, the default); none is dropped.

The pending table is kept by micro-batch and by range of epochs (`SPAN` of them), so a release reads the ranges that it completes, and no arrival is written twice. The order of writes makes replays safe: arrivals, then what
they complete (state before changes), then the new frontier. A micro-batch that runs again starts from the frontier of the one before and writes the same files anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.versioned import FOREVER
from graphloom.plans.pattern import Motif
from graphloom.storage import delete
from graphloom.streaming.runner import BEFORE, MotifStream

ROWS = "src long, dst long, t int, w int, sender string"
#: Epochs in one part of the pending table.
SPAN = 16
LATE = ("next", "error")


class EpochStream:
    """Tracks one motif over rows with epochs; `path` is a folder in the shared file system, with in, pending, frontier and motif below it."""

    def __init__(self, spark: SparkSession, motif: Motif, path: str, base: DataFrame | None = None, senders: Sequence[str] = ("",), lateness: int | None = None, late: str = "next", span: int = SPAN, keep_versions: int = 2, **options):
        if late not in LATE:
            raise ValueError(f"late is one of {LATE}")
        if not senders:
            raise ValueError("without senders no epoch is ever complete")
        self.spark, self.path, self.senders, self.lateness, self.late, self.span, self.keep_versions = spark, path, tuple(senders), lateness, late, span, keep_versions
        self.stream = MotifStream(spark, motif, f"{path}/motif", base, keep_versions=keep_versions, **options)

    # State

    def _fs(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str, key: str) -> list[int]:
        fs, path = self._fs(folder)
        if not fs.exists(path):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))

    def _committed(self) -> list[int]:
        """The micro-batches whose frontier was written to the end."""
        found = []
        for b in self._numbers("frontier", "b"):
            fs, path = self._fs(f"frontier/b={b}/_SUCCESS")
            if fs.exists(path):
                found.append(b)
        return found

    def _marks(self, before: int) -> dict[str, int]:
        """Each sender's mark after the last micro-batch before the given one."""
        batches = [b for b in self._committed() if b < before]
        if not batches:
            return dict.fromkeys(self.senders, BEFORE + 1)
        held = {r["sender"]: r["t"] for r in self.spark.read.schema("sender string, t int").parquet(f"{self.path}/frontier/b={batches[-1]}").collect()}  # a row a sender
        return {s: held.get(s, BEFORE + 1) for s in self.senders}

    def frontier(self) -> int:
        """The least epoch that may still change; all before it are complete, and their changes are there."""
        return min(self._marks(FOREVER).values())

    def complete(self, t: int) -> bool:
        return t < self.frontier()

    def _pending(self, until: int, low: int, high: int) -> DataFrame | None:
        """(src, dst, t, w): what came in micro-batches up to `until` for the epochs low <= t < high. Only the parts of these epochs are read."""
        paths = [f"{self.path}/pending/b={b}/part={p}" for b in self._numbers("pending", "b") if b <= until for p in self._numbers(f"pending/b={b}", "part") if low // self.span <= p <= (high - 1) // self.span]
        if not paths:
            return None
        return self.spark.read.schema("src long, dst long, t int, w int").parquet(*paths).where(F.col("t").between(low, high - 1))

    # Micro-batches

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: keeps what arrived, moves the frontier, and releases what that completes."""
        marks = self._marks(batch)
        before = min(marks.values())
        sender = F.coalesce("sender", F.lit("")) if "sender" in rows.columns else F.lit("")
        rows = rows.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("t").cast("int"), F.col("w").cast("int"), sender.alias("sender"))
        arrived = rows.where("src is not null and dst is not null")
        if self.late == "error":
            check = F.when(F.col("t") < before, F.raise_error(F.concat(F.lit("too late for epoch "), F.col("t").cast("string"))).cast("int")).otherwise(F.col("t"))
        else:
            check = F.greatest("t", F.lit(before))
        arrived = arrived.select("src", "dst", check.alias("t"), "w").withColumn("part", F.floor(F.col("t") / self.span).cast("int"))
        arrived.repartition("part", F.pmod(F.xxhash64("src"), F.lit(8))).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/pending/b={batch}")

        said = rows.where("src is null and dst is null").groupBy("sender").agg(F.max("t").alias("t"))
        if self.lateness is None:
            for r in said.where(F.col("sender").isin(*self.senders)).collect():  # a row a sender
                marks[r["sender"]] = max(marks[r["sender"]], r["t"])
        else:
            seen = rows.agg(F.max("t").alias("t")).first()["t"]
            if seen is not None:
                marks = {s: max(t, seen - self.lateness) for s, t in marks.items()}
        after = min(marks.values())
        if after > before:
            released = self._pending(batch, before, after)
            if released is not None:
                self.stream.advance(released, batch)
        state = self.spark.createDataFrame(list(marks.items()), "sender string, t int").coalesce(1)
        state.write.mode("overwrite").parquet(f"{self.path}/frontier/b={batch}")
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        """Deletes the pending parts that were complete before anything that may still be replayed."""
        old = [b for b in self._committed() if b <= batch - self.keep_versions]
        if not old:
            return
        done = min(self._marks(old[-1] + 1).values())
        for b in self._numbers("pending", "b"):
            parts = self._numbers(f"pending/b={b}", "part")
            gone = [p for p in parts if (p + 1) * self.span <= done and b <= old[-1]]
            whole = len(gone) == len(parts) and b <= old[-1]
            delete(self.spark, [f"{self.path}/pending/b={b}"] if whole else [f"{self.path}/pending/b={b}/part={p}" for p in gone])
        delete(self.spark, [f"{self.path}/frontier/b={b}" for b in old[:-1]])

    # Input and output

    def session(self, sender: str = "") -> InputSession:
        """An input whose rows and marks the stream of `input` reads."""
        if sender not in self.senders:
            raise ValueError(f"the senders are {self.senders}")
        return InputSession(self, sender)

    def input(self, **options: str) -> DataFrame:
        """The streaming DataFrame of what the sessions write."""
        return self.spark.readStream.schema(ROWS).options(**options).parquet(f"{self.path}/in")

    def start(self, stream: DataFrame | None = None, on_batch: Callable[[int], None] | None = None, **options: str) -> StreamingQuery:
        """Runs over a streaming DataFrame of (src, dst, t, w[, sender]), by default that of the sessions."""

        def each(rows: DataFrame, batch: int) -> None:
            self.process(rows, batch)
            if on_batch:
                on_batch(batch)

        rows = stream if stream is not None else self.input()
        return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/checkpoint").options(**options).start()

    def changes(self) -> DataFrame:
        """(x0, ..., w, t) of all complete epochs."""
        return self.stream.changes()

    def edges(self) -> DataFrame:
        """(src, dst): the graph after all complete epochs."""
        return self.stream.edges()


class InputSession:
    """One sender: rows are sent at its current epoch, which only moves forward. What it sends is written when the epoch moves on, together with the mark."""

    def __init__(self, stream: EpochStream, sender: str):
        self.stream, self.sender, self.time = stream, sender, BEFORE + 1
        self._held: list[DataFrame] = []

    def send(self, rows: DataFrame | Iterable[tuple[int, int, int]], t: int | None = None) -> None:
        """(src, dst, w) at the current epoch, or at a later one."""
        t = self.time if t is None else t
        if t < self.time:
            raise ValueError(f"epoch {t} is over; the session is at {self.time}")
        frame = rows if isinstance(rows, DataFrame) else self.stream.spark.createDataFrame(list(rows), "src long, dst long, w int")
        self._held.append(frame.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(t).alias("t"), F.col("w").cast("int"), F.lit(self.sender).alias("sender")))

    def advance_to(self, t: int) -> None:
        """No more rows before epoch t."""
        if t < self.time:
            raise ValueError(f"the session is at {self.time} already")
        self.time = t
        out = self.stream.spark.createDataFrame([(None, None, t, 0, self.sender)], ROWS).coalesce(1)
        for frame in self._held:
            out = out.unionByName(frame)
        out.write.mode("append").parquet(f"{self.stream.path}/in")
        self._held = []

    def close(self) -> None:
        """No more rows at all."""
        self.advance_to(FOREVER)
