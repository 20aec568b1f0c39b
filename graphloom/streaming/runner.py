"""Structured Streaming: micro-batches of signed edge changes in, changes of a motif's matches out.

A micro-batch is one epoch, or brings whole epochs of its own (`advance`; `streaming.epochs` collects them from rows in any order).

The state has two tiers. The base holds edges once by source and once by target, each dealt into buckets of its key and sorted within them. The tail is a log of the
effective changes of each batch since. A batch reads of both only the neighbourhood of what it changes: of the base the buckets of the nodes concerned, which the driver looks up (a number a bucket), with semi-joins that need no
shuffle of the base; then it writes its own changes.

Each bucket is compacted by itself: when its rows in the tail pass `MERGE_SHARE` of its rows in the base, they are merged into a new version of this bucket, and all others stay where they are. Rows of the tail that both
their buckets hold already are left out when the tail is folded into one table, which happens every `FOLD` batches. When the base has grown to more than `BUCKET_ROWS` rows a bucket on average, it is written anew with
twice as many. So rewriting costs each change a constant amount, however large the graph, and a change at one node rewrites a bucket each way at most. A manifest for each batch says which versions of which buckets, and which
tables of the tail, make the state; it is written last, so a batch that failed leaves no trace.

Edges are sets, by the rule of `operators.versioned`. A batch that runs again reads what was there before it and writes the same tables anew, so replays are safe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.match import track
from graphloom.operators.versioned import FOREVER, effective_changes, held_edges, net_changes
from graphloom.plans.pattern import Motif
from graphloom.storage import materialize

#: A bucket is merged with its rows of the tail when these are more than this share of its rows in the base, or of an average bucket's.
MERGE_SHARE = 0.25
#: Buckets at the outset, rows of a bucket on average at which their number doubles, and tables of the tail at which they are folded into one.
BUCKETS, BUCKET_ROWS, FOLD = 32, 1_000_000, 16
#: The epoch of what is in the base.
BEFORE = -FOREVER


EDGES, CHANGES = "src long, dst long", "src long, dst long, t int, w int"
#: The two ways in which the base lies, and the key of each.
WAYS = {"forward": "src", "reverse": "dst"}


class MotifStream:
    """Tracks one motif; `path` is a folder in the shared file system, with base/v=N, log/b=N, changes/b=N and manifest/b=N below it, N the micro-batch."""

    def __init__(self, spark: SparkSession, motif: Motif, path: str, base: DataFrame | None = None, strategy: str = "generic", keep_versions: int = 2, merge_share: float = MERGE_SHARE, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, fold: int = FOLD):
        self.spark, self.motif, self.path, self.strategy, self.keep_versions = spark, motif, path, strategy, keep_versions
        self.merge_share, self.bucket_rows, self.fold = merge_share, bucket_rows, fold
        self.inner, self.outer = motif.reach()
        self._known: dict[int, dict] = {}
        if not self._manifests():  # else a stream that goes on
            edges = base if base is not None else spark.createDataFrame([], "src long, dst long")
            edges = materialize(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct(), "given")
            state = {"buckets": buckets, "base": {"forward": {}, "reverse": {}}, "tail": []}
            self._write_buckets(edges, state, -1, {way: None for way in WAYS}, BEFORE)
            self._commit(state, -1)

    # Tables

    def _fs(self, name: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self, table: str, key: str) -> list[int]:
        """The batches of a table that were written to the end; of the base, the versions that a manifest names."""
        if table == "base":
            return sorted({v for b in self._manifests() for way in self._state(b)["base"].values() for v, _, _ in way.values()})
        fs, path = self._fs(table)
        if not fs.exists(path):
            return []
        found = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{key}=") and fs.exists(self._fs(f"{table}/{n}/_SUCCESS")[1]))

    # Manifests: number of buckets; by way and bucket (version, rows, epoch up to which all is in); tables of the tail

    def _manifests(self) -> list[int]:
        fs, path = self._fs("manifest")
        if not fs.exists(path):
            return []
        found = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith("b="))

    def _state(self, batch: int) -> dict:
        if batch not in self._known:
            fs, path = self._fs(f"manifest/b={batch}")
            java = self.spark.sparkContext._jvm.java.io
            reader = java.BufferedReader(java.InputStreamReader(fs.open(path), "UTF-8"))
            try:
                self._known[batch] = json.loads(reader.readLine())
            finally:
                reader.close()
        return self._known[batch]

    def _commit(self, state: dict, batch: int) -> None:
        """Writes a manifest; by way of a rename, so it is whole or not there."""
        fs, path = self._fs(f"manifest/b={batch}")
        part = self._fs(f"manifest/_{batch}-{uuid.uuid4().hex}")[1]
        stream = fs.create(part)
        stream.write(bytearray(json.dumps(state), "ascii"))
        stream.close()
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"can't write {path}")
        self._known.pop(batch, None)

    def _bucket(self, col: str, buckets: int):
        return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")

    def _write_buckets(self, edges: DataFrame, state: dict, version: int, only: dict[str, list[int] | None], upto: int) -> None:
        """Writes buckets of the base anew (`only` says which of each way; None: all) from `edges`, a written table that holds what is in them, and enters them into the state."""
        parts = []
        for way, key in WAYS.items():
            if only[way] != []:
                rows = edges.select("src", "dst", F.lit(way).alias("way"), self._bucket(key, state["buckets"]).alias("bucket"), F.col(key).alias("at"))
                parts.append(rows if only[way] is None else rows.where(F.col("bucket").isin(only[way])))
        rows = reduce(DataFrame.unionByName, parts)
        # a hub's bucket is split among tasks and files by Spark where it is large
        rows = rows.hint("rebalance", "way", "bucket").sortWithinPartitions("way", "bucket", "at").drop("at")
        rows.write.mode("overwrite").partitionBy("way", "bucket").parquet(f"{self.path}/base/v={version}")
        written = self.spark.read.schema(f"{EDGES}, way string, bucket int").parquet(f"{self.path}/base/v={version}")
        counts = {(r["way"], r["bucket"]): r["count"] for r in written.groupBy("way", "bucket").count().collect()}  # a row a bucket
        for way, buckets in only.items():
            for bucket in range(state["buckets"]) if buckets is None else buckets:
                n = counts.get((way, bucket), 0)
                state["base"][way].pop(str(bucket), None)
                if n or upto > BEFORE:
                    state["base"][way][str(bucket)] = (version, n, upto)

    def _base(self, batch: int, way: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """(src, dst, bucket) of the base after a batch: all buckets of one way, or these."""
        held = self._state(batch)["base"][way]
        chosen = held if buckets is None else {str(b): held[str(b)] for b in buckets if str(b) in held}
        paths = [f"{self.path}/base/v={v}/way={way}/bucket={b}" for b, (v, n, _) in chosen.items() if n]
        if not paths:
            return self.spark.createDataFrame([], f"{EDGES}, bucket int")
        rows = self.spark.read.schema(f"{EDGES}, v int, way string, bucket int").option("basePath", f"{self.path}/base").parquet(*paths)
        return rows.select("src", "dst", "bucket")

    def _tail(self, after: int, until: int) -> DataFrame:
        """(src, dst, t, w): the effective changes that the base after a batch may lack, before another."""
        names = [f"log/b={b}" for b in self._numbers("log", "b") if after < b < until]
        names = [*self._state(after)["tail"], *names]
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.path}/{name}" for name in names)) if names else self.spark.createDataFrame([], CHANGES)

    def _around(self, nodes: DataFrame, version: int, tail: DataFrame, both_ends: bool = False) -> DataFrame:
        """(src, dst): the edges with an end (or both) among `nodes` (node), as of the tail's end. Only the buckets of these nodes are read."""
        needed = [r["bucket"] for r in nodes.select(self._bucket("node", self._state(version)["buckets"]).alias("bucket")).distinct().collect()]  # a row a bucket

        def ends(rows: DataFrame, key: str, *more: str) -> DataFrame:
            return rows.join(nodes, rows[key] == nodes["node"], "left_semi").select("src", "dst", *more)

        held = ends(self._base(version, "forward", needed), "src")
        if both_ends:
            held, own = ends(held, "dst"), ends(ends(tail, "src", "t", "w"), "dst", "t", "w")
        else:
            held = held.unionByName(ends(self._base(version, "reverse", needed), "dst")).distinct()
            own = ends(tail, "src", "t", "w").unionByName(ends(tail, "dst", "t", "w")).distinct()
        return held_edges(self._as_log(held).unionByName(own))

    @staticmethod
    def _as_log(base: DataFrame) -> DataFrame:
        return base.select("src", "dst", F.lit(BEFORE).alias("t"), F.lit(1).alias("w"))

    # Batches

    def process(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch of (src, dst, w), an epoch by itself: weights of an edge are added up, then only effective changes count."""
        self.advance(changes.select("src", "dst", F.lit(batch).alias("t"), "w"), batch)

    def advance(self, changes: DataFrame, batch: int) -> None:
        """A micro-batch of (src, dst, t, w): all rows of some epochs, each later than those of the batches before."""
        version = max(b for b in self._manifests() if b < batch)
        tail = self._tail(version, version + 1)
        net = net_changes(changes.where("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("t").cast("int"), "w"))
        net = materialize(net.select("src", "dst", "t", F.signum("w").cast("int").alias("w")), "net")
        asked = net.select("src", "dst").distinct()
        buckets = [r["bucket"] for r in net.select(self._bucket("src", self._state(version)["buckets"]).alias("bucket")).distinct().collect()]  # a row a bucket
        there = self._as_log(self._base(version, "forward", buckets)).unionByName(tail).join(asked, ["src", "dst"], "left_semi")
        there = held_edges(there)
        effective = effective_changes(self._as_log(there).unionByName(net)).where(F.col("t") > BEFORE)
        effective.write.mode("overwrite").parquet(f"{self.path}/log/b={batch}")
        effective = self.spark.read.schema(CHANGES).parquet(f"{self.path}/log/b={batch}")

        nodes = materialize(effective.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "changed-nodes")
        for _ in range(self.inner):
            near = self._around(nodes, version, tail)
            nodes = materialize(nodes.unionByName(near.select(F.explode(F.array("src", "dst")).alias("node"))).distinct(), "near-nodes")
        local = self._around(nodes, version, tail, both_ends=self.inner == self.outer and self.inner > 0)
        log = self._as_log(local).unionByName(effective)
        track(self.motif, log, BEFORE + 1, self.strategy).write.mode("overwrite").parquet(f"{self.path}/changes/b={batch}")
        self._merge(version, batch)

    def _merge(self, version: int, batch: int) -> None:
        """Merges the buckets whose part of the tail has grown large, commits the batch's state, and forgets what no replay of the last batches can need."""
        state = json.loads(json.dumps(self._state(version)))
        state["tail"].append(f"log/b={batch}")
        tail = self._read_tail(state)
        epoch = tail.agg(F.max("t").alias("t")).first()["t"]
        if epoch is not None:
            self._compact(state, tail, batch, epoch)
        if len(state["tail"]) > self.fold:
            self._fold(state, batch)
        self._commit(state, batch)
        self._forget(batch)

    def _read_tail(self, state: dict) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.path}/{name}" for name in state["tail"]))

    def _compact(self, state: dict, tail: DataFrame, batch: int, epoch: int) -> None:
        held = state["base"]
        ways = [tail.select(F.lit(way).alias("way"), self._bucket(key, state["buckets"]).alias("bucket"), "t") for way, key in WAYS.items()]
        known = self.spark.createDataFrame([(way, int(b), upto) for way in WAYS for b, (_, _, upto) in held[way].items()], "way string, bucket int, upto int")  # a row a bucket
        open_ = reduce(DataFrame.unionByName, ways).join(F.broadcast(known), ["way", "bucket"], "left").where(F.col("t") > F.coalesce("upto", F.lit(BEFORE)))
        grown: dict[str, list[int]] = {way: [] for way in WAYS}
        total = sum(n for _, n, _ in held["forward"].values())
        mean = total / state["buckets"]
        for r in open_.groupBy("way", "bucket").count().collect():  # a row a bucket
            if r["count"] > self.merge_share * max(mean, held[r["way"]].get(str(r["bucket"]), (0, 0, 0))[1]):
                grown[r["way"]].append(r["bucket"])
        wider = state["buckets"]
        while any(grown.values()) and total > wider * self.bucket_rows:
            wider *= 2
        if wider > state["buckets"]:
            every = held_edges(self._as_log(self._all(state)).unionByName(tail))
            state |= {"buckets": wider, "base": {way: {} for way in WAYS}, "tail": []}
            self._write_buckets(materialize(every, "merged"), state, batch, {way: None for way in WAYS}, epoch)
        elif any(grown.values()):
            parts = []
            for way, key in WAYS.items():
                if grown[way]:
                    own = self._paths(held[way], way, grown[way])
                    base = self.spark.read.schema(EDGES).parquet(*own) if own else self.spark.createDataFrame([], EDGES)
                    parts.append(self._as_log(base).unionByName(tail.where(self._bucket(key, state["buckets"]).isin(grown[way]))))
            # an edge may be in buckets of both ways; its rows are the same, and the last of them counts
            merged = materialize(held_edges(reduce(DataFrame.unionByName, parts)), "merged")
            self._write_buckets(merged, state, batch, grown, epoch)

    def _paths(self, held: dict, way: str, buckets: Iterable[int] | None = None) -> list[str]:
        return [f"{self.path}/base/v={v}/way={way}/bucket={b}" for b, (v, n, _) in held.items() if n and (buckets is None or int(b) in buckets)]

    def _all(self, state: dict) -> DataFrame:
        paths = self._paths(state["base"]["forward"], "forward")
        return self.spark.read.schema(EDGES).parquet(*paths) if paths else self.spark.createDataFrame([], EDGES)

    def _fold(self, state: dict, batch: int) -> None:
        """The tables of the tail as one, with the last change of each edge, and without those that the base has both ways."""
        tail = self._read_tail(state).groupBy("src", "dst").agg(F.max("t").alias("t"), F.max_by("w", "t").alias("w"))
        for way, key in WAYS.items():
            known = self.spark.createDataFrame([(int(b), upto) for b, (_, _, upto) in state["base"][way].items()], "bucket int, upto int")
            named = tail.withColumn("bucket", self._bucket(key, state["buckets"])).join(F.broadcast(known), "bucket", "left")
            tail = named.select("src", "dst", "t", "w", *(c for c in named.columns if c.startswith("in_")), (F.col("t") <= F.coalesce("upto", F.lit(BEFORE))).alias(f"in_{way}"))
        rest = tail.where(~(F.col("in_forward") & F.col("in_reverse"))).select("src", "dst", "t", "w")
        rest.write.mode("overwrite").parquet(f"{self.path}/folded/b={batch}")
        state["tail"] = [f"folded/b={batch}"]

    def _forget(self, batch: int) -> None:
        manifests = self._manifests()
        kept = [b for b in manifests if b >= batch + 1 - self.keep_versions]
        older = [b for b in manifests if b < batch + 1 - self.keep_versions]
        kept += older[-1:]  # a replay of the oldest batch starts from the state before it
        states = [self._state(b) for b in kept]
        used = {f"base/v={v}/way={way}/bucket={b}" for s in states for way in WAYS for b, (v, _, _) in s["base"][way].items()} | {name for s in states for name in s["tail"]}
        for b in older[:-1]:
            before = self._state(b)
            gone = {f"base/v={v}/way={way}/bucket={x}" for way in WAYS for x, (v, _, _) in before["base"][way].items()} | set(before["tail"])
            for name in [*sorted(gone - used), f"manifest/b={b}"]:
                fs, path = self._fs(name)
                fs.delete(path, True)
            self._known.pop(b, None)

    def edges(self) -> DataFrame:
        """(src, dst): the graph after all batches so far."""
        state = self._state(max(self._manifests()))
        log = self._as_log(self._all(state))
        return held_edges(log.unionByName(self._read_tail(state)) if state["tail"] else log)

    def start(self, stream: DataFrame, on_batch: Callable[[int], None] | None = None, **options: str) -> StreamingQuery:
        """Runs over a streaming DataFrame of (src, dst, w)."""

        def each(changes: DataFrame, batch: int) -> None:
            self.process(changes, batch)
            if on_batch:
                on_batch(batch)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/checkpoint").options(**options).start()

    def changes(self) -> DataFrame:
        """(x0, ..., w, t) of all batches so far."""
        schema = ", ".join([*(f"{c} long" for c in self.motif.columns), "w long, t int"])
        batches = self._numbers("changes", "b")
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/changes/b={b}" for b in batches)) if batches else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """(t, n_changes, net)"""
        return self.changes().groupBy("t").agg(F.count("*").alias("n_changes"), F.sum("w").cast("long").alias("net"))
