"""Reading and writing edges, and how they are dealt into batches."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import part_name
from graphloom.storage import materialize


def edge_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, value): the raw lines of edge-list text with their number, comments and blanks included; files count in the order of their paths.

    The lines are written once with their place in the scan, so no later step depends on how a scan cuts the files. Numbers follow from the lines of each split of a file: a table with
    one row a split, whose running sum is the only thing that a single task orders.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
    rows = materialize(rows, "lines")
    splits = rows.groupBy("file", "offset").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "offset")) - F.col("n")
    splits = materialize(splits.select("file", "offset", "first", before.alias("start")), "splits")
    return rows.join(splits, ["file", "offset"]).select((F.col("start") + F.col("at") - F.col("first")).alias("line_no"), "value")


def parse_edges(lines: DataFrame) -> DataFrame:
    """src and dst from the first two fields of each line that is neither blank nor a comment; a malformed number is an error."""
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kept = lines.where(~F.col("value").startswith("#") & (F.trim(F.regexp_replace("value", r"\s+", " ")) != ""))

    def number(i: int) -> Column:
        text = F.get(fields, F.lit(i))
        return F.when(text.rlike("^[0-9]+$"), text.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("long"))

    return kept.select(*(c for c in lines.columns if c != "value"), number(0).alias("src"), number(1).alias("dst"))


def edge_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """src and dst of an edge-list file, folder or pattern."""
    return parse_edges(spark.read.text(path))


def edge_parts(spark: SparkSession, prefix: str, number: int) -> DataFrame:
    """src and dst from files prefix00000, prefix00001, ..."""
    return edge_text(spark, [part_name(prefix, i) for i in range(number)])


def preload_and_batches(spark: SparkSession, path: str | list[str], preload: int, batch: int) -> tuple[DataFrame, DataFrame]:
    """The edges of the first `preload` raw lines, and the rest as (src, dst, t, w) in epochs of `batch` raw lines, counted from 1."""
    rows = parse_edges(edge_lines(spark, path))
    t = (1 + F.floor((F.col("line_no") - preload) / batch)).cast("int")
    return rows.where(F.col("line_no") < preload).select("src", "dst"), rows.where(F.col("line_no") >= preload).select("src", "dst", t.alias("t"), F.lit(1).alias("w"))


def update_batches(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """A file of updates of its own, as (src, dst, t, w)."""
    return preload_and_batches(spark, path, 0, batch)[1]


def node_batches(edges: DataFrame, batch: int) -> DataFrame:
    """All edges out of `batch` consecutive nodes in one epoch, from 1."""
    return edges.select("src", "dst", (1 + F.floor(F.col("src") / batch)).cast("int").alias("t"), F.lit(1).alias("w"))


def percent_split(edges: DataFrame, percent: float) -> tuple[DataFrame, DataFrame]:
    """Edges of the first `percent` of nodes (by number, up to the greatest), and the others."""
    limit = edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n")).first()["n"] or 0
    cut = limit * percent / 100
    return edges.where(F.col("src") < cut), edges.where(F.col("src") >= cut)


def percent_of_lines(spark: SparkSession, path: str | list[str], percent: float, batch: int) -> tuple[DataFrame, DataFrame]:
    """The edges of the first `percent` of the raw lines, the line at the cut not included, and the rest in epochs of `batch` lines."""
    n = spark.read.text(path).count()
    return preload_and_batches(spark, path, math.floor(n * percent / 100), batch)


def shuffled_batches(edges: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """Edges in a random order that the seed fixes, about `batch` to an epoch: a hash deals them out, so nothing is sorted."""
    n = max(1, -(-edges.count() // batch))
    return edges.select("src", "dst", (1 + F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(n))).cast("int").alias("t"), F.lit(1).alias("w"))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows`, written, with `place` (from 1) in the total order of these columns, and `part`, the range of the order in which it lies.

    Rows are dealt by range, so parts are about equal however the columns are distributed. A place follows from the place within the part and the sizes of the parts before, a row a part.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumns({"_at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "in-order")
    parts = dealt.groupBy("part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(materialize(parts, "parts")), "part").withColumn("place", F.col("_at") + F.col("_shift") + 1).drop("_at", "_shift")


def following(rows: DataFrame) -> DataFrame:
    """(src, dst): `key` of each row (key, at, bucket) and of the next one in the order of `at`. Buckets ascend with `at`; rows are paired within them, and only each bucket's last row with the first of the next."""
    inside = rows.withColumn("next", F.lead(F.struct("key")).over(Window.partitionBy("bucket").orderBy("at")))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("at", "key")).alias("head"))
    heads = heads.select("bucket", F.lead("head.key").over(Window.orderBy("bucket")).alias("after"))  # a row a bucket
    pairs = inside.join(heads, "bucket")
    return pairs.select(F.col("key").alias("src"), F.when(F.col("next").isNull(), F.col("after")).otherwise(F.col("next.key")).alias("dst")).where("dst is not null")


def transitions(events: DataFrame, key: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """(src, dst): `key` of each row and of the next one in the order of `order`, over the whole table.

    The order is total, but no task sees all rows: they are dealt by ranges of the order, or if given by buckets, which must ascend with its first column.
    """
    if bucket is None:
        rows = in_order(events.select(F.col(key).alias("key"), *order), order)
        return following(rows.select("key", F.col("place").alias("at"), F.col("part").alias("bucket")))
    return following(events.select(F.col(key).alias("key"), F.struct(*order).alias("at"), bucket.alias("bucket")))


#: Edges of a CSR block, and the most nodes without edges that it bridges.
BLOCK_EDGES, BLOCK_GAP = 250_000, 1_000_000
BLOCK = "part int, at int, first_node long, last_node long, edges long, counts binary, targets binary"


def csr_blocks(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(first_node, last_node, first_edge, edges, before, after, counts, targets): the edges in the order of (src, dst), cut into blocks, written.

    A block holds how many edges each node from first_node to last_node has in it (32-bit) and their targets (32-bit), first_edge is the number of edges before it, `before` the last node of the block before and `after` the first of the next (-1: none). Edges
    are dealt by range and every task cuts its own; a node with very many lies in several blocks. What comes before a block follows from sums over a row a block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size = 0

        def blocks(rows: np.ndarray, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Whole blocks of rows (src, dst), and what is left over."""
            jumps = np.flatnonzero(np.diff(rows[:, 0]) > BLOCK_GAP) + 1
            low = 0
            for high in [*jumps.tolist(), len(rows)]:
                while high - low >= block_edges or low < high and (last or high < len(rows)):
                    yield rows[low : min(low + block_edges, high)], rows[min(low + block_edges, high) :]
                    low = min(low + block_edges, high)

        def row(block: np.ndarray) -> pa.RecordBatch:
            nonlocal at
            first, end = int(block[0, 0]), int(block[-1, 0])
            if block.min() < 0 or block.max() >= 1 << 32:
                raise ValueError("nodes of a CSR graph are numbers from 0 to 2^32 - 1")
            counts = np.bincount(block[:, 0] - first, minlength=end - first + 1).astype(np.uint32)
            at += 1
            values = [[part], [at], [first], [end], [len(block)], [counts.tobytes()], [block[:, 1].astype(np.uint32).tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            held.append(np.stack([batch["src"].to_numpy(), batch["dst"].to_numpy()], axis=1))
            size += batch.num_rows
            if size >= block_edges:
                rest = rows = np.concatenate(held)
                for block, rest in blocks(rows, False):
                    yield row(block)
                held, size = [rest], len(rest)
        if size:
            for block, _ in blocks(np.concatenate(held), True):
                yield row(block)

    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    found = materialize(rows.mapInArrow(cut, BLOCK), "csr-blocks")
    order = Window.orderBy("part", "at")  # a row a block, without its edges
    places = found.select("part", "at", (F.sum("edges").over(order) - F.col("edges")).alias("first_edge"), F.coalesce(F.lag("last_node").over(order), F.lit(-1)).alias("before"), F.coalesce(F.lead("first_node").over(order), F.lit(-1)).alias("after"))
    return found.join(F.broadcast(materialize(places, "csr-places")), ["part", "at"]).drop("part", "at")


def write_csr_blocks(edges: DataFrame, path: str, block_edges: int = BLOCK_EDGES) -> None:
    """The CSR form as a Parquet table of blocks, written by tasks: for any file system that Spark writes to."""
    csr_blocks(edges, block_edges).write.parquet(path)


def read_csr_blocks(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """src and dst of a table of blocks; with `low` and `high` of the nodes low <= src <= high alone, for which only the blocks that hold some are read."""
    blocks = spark.read.parquet(path).select("first_node", "last_node", "counts", "targets")
    if low is not None:
        blocks = blocks.where(F.col("last_node") >= low)
    if high is not None:
        blocks = blocks.where(F.col("first_node") <= high)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, targets in zip(batch["first_node"].to_pylist(), batch["counts"], batch["targets"], strict=True):
                n = np.frombuffer(counts.as_buffer(), np.uint32)
                src = np.repeat(np.arange(first, first + len(n)), n)
                dst = np.frombuffer(targets.as_buffer(), np.uint32).astype(np.int64)
                inside = (src >= (low if low is not None else 0)) & (src <= (high if high is not None else 1 << 32))
                yield pa.RecordBatch.from_arrays([pa.array(src[inside]), pa.array(dst[inside])], ["src", "dst"])

    return blocks.select("first_node", "counts", "targets").mapInArrow(rows, "src long, dst long")


def write_csr(edges: DataFrame, path: str, block_edges: int = BLOCK_EDGES) -> None:
    """path.offsets (64-bit) and path.targets (32-bit) in a folder that driver and workers share as a file system: the form that single machines map into memory.

    The driver only makes the two files, at their full length; each task writes its blocks at the places where they belong. A task that runs again writes the same bytes.
    """
    blocks = materialize(csr_blocks(edges, block_edges), "csr")
    total, nodes = blocks.agg(F.sum("edges"), F.max("last_node") + 1).first()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for name, size in (("targets", 4 * (total or 0)), ("offsets", 8 * ((nodes or 0) + 1))):
        with open(f"{path}.{name}", "wb") as f:
            f.truncate(size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(f"{path}.targets", "r+b") as targets, open(f"{path}.offsets", "r+b") as offsets:
            for batch in batches:
                for row in batch.to_pylist():
                    targets.seek(4 * row["first_edge"])
                    targets.write(row["targets"])
                    ends = row["first_edge"] + np.cumsum(np.frombuffer(row["counts"], np.uint32), dtype=np.uint64)
                    # where each next node begins, also behind nodes without edges; that of a node that goes on is the next block's to write
                    skipped = np.full(max(0, row["first_node"] - row["before"] - 1), row["first_edge"], np.uint64)
                    if row["after"] == row["last_node"]:
                        ends = ends[:-1]
                    offsets.seek(8 * min(row["before"] + 2, row["first_node"] + 1))
                    offsets.write(np.concatenate([skipped, ends]).astype(np.uint64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["blocks"])

    blocks.mapInArrow(write, "blocks long").agg(F.sum("blocks")).collect()


def read_csr(spark: SparkSession, path: str, nodes_per_task: int = 100_000) -> DataFrame:
    """src and dst from path.offsets and path.targets, which every worker must see; each task maps only its own range."""
    n = max(0, np.memmap(f"{path}.offsets", np.uint64, "r").shape[0] - 1)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, targets = np.memmap(f"{path}.offsets", np.uint64, "r"), np.memmap(f"{path}.targets", np.uint32, "r")
        for batch in batches:
            for low in batch["id"]:
                ends = offsets[low : min(low + nodes_per_task, n) + 1].astype(np.int64)
                yield pd.DataFrame({"src": np.repeat(np.arange(low, low + len(ends) - 1), np.diff(ends)), "dst": targets[ends[0] : ends[-1]].astype(np.int64)})

    tasks = max(1, -(-n // nodes_per_task))
    return spark.range(0, n, nodes_per_task, tasks).mapInPandas(rows, "src long, dst long") if n else spark.createDataFrame([], "src long, dst long")
