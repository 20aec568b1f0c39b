"""A stored index of edges that change, with reads as of any epoch.

The log lies in parts of `span` epochs, and snapshots hold the edges as of some epochs. A read as of epoch t takes the latest snapshot up to t and, of the log, only the parts with the epochs between the two. So
what it reads follows the graph at that time and the distance to the next snapshot, not the length of the history; the more snapshots, the shorter the distance. The rules of `operators.versioned` hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.versioned import FOREVER, held_edges

SPAN = 16
LOG = "src long, dst long, t int, w int"


class StoredEdges:
    """`path` is a folder in the shared file system, with log/part=P and base/t=T below it; an index that lies there already goes on."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN):
        self.spark, self.path, self.span = spark, path, span

    def _listed(self, folder: str, key: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))

    def snapshots(self) -> list[int]:
        """The epochs of the snapshots that were written to the end."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = [(t, jvm.org.apache.hadoop.fs.Path(f"{self.path}/base/t={t}/_SUCCESS")) for t in self._listed("base", "t")]
        return [t for t, path in done if path.getFileSystem(conf).exists(path)]

    def append(self, changes: DataFrame) -> None:
        """More changes (src, dst, t, w). They must be later than any snapshot, as that holds what was known of its epoch."""
        late = max(self.snapshots(), default=-FOREVER)
        t = F.col("t").cast("int")
        open_ = F.when(t > late, t).otherwise(F.raise_error(F.concat(F.lit("there is a snapshot of a later epoch than "), t.cast("string"))).cast("int"))
        rows = changes.select(F.col("src").cast("long"), F.col("dst").cast("long"), open_.alias("t"), F.col("w").cast("int")).withColumn("part", F.floor(F.col("t") / self.span).cast("int"))
        # a part's rows go to several tasks, by edge, and lie together in its files
        rows.repartition("part", F.pmod(F.xxhash64("src", "dst"), F.lit(8))).write.mode("append").partitionBy("part").parquet(f"{self.path}/log")

    def _log(self, after: int, until: int) -> DataFrame:
        """The changes of epochs after < t <= until, from the parts that hold them."""
        paths = [f"{self.path}/log/part={p}" for p in self._listed("log", "part") if (after + 1) // self.span <= p <= until // self.span]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*paths).where((F.col("t") > after) & (F.col("t") <= until))

    def as_of(self, t: int, strict: bool = False) -> DataFrame:
        """(src, dst): the edges present at epoch t, or with `strict` just before it."""
        t = t - 1 if strict else t
        nearest = max((s for s in self.snapshots() if s <= t), default=None)
        log = self._log(-FOREVER if nearest is None else nearest, t)
        if nearest is not None:
            base = self.spark.read.schema("src long, dst long").parquet(f"{self.path}/base/t={nearest}")
            log = base.select("src", "dst", F.lit(nearest).alias("t"), F.lit(1).alias("w")).unionByName(log)
        return held_edges(log)

    def snapshot(self, t: int) -> None:
        """Stores the edges as of epoch t, from the snapshot before and the log in between."""
        self.as_of(t).write.mode("overwrite").parquet(f"{self.path}/base/t={t}")
