"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, rows are sorted by the index of their cell on the
curve, and the sorted rows are cut into runs of equal length. Neighbours on the curve are near in every dimension, so
each shard covers a small box and a reader can skip files by any of the dimensions.

Dimensions: language and source, each coded in the order of its names (the distinct names are cut into as many ranges as a dimension has cells), and text size by 8 steps for
each doubling. Rows in one cell are ordered by text size, the text's digest and the identifier.

Equal texts lie together: all rows of a group take the cell of the least (language, source) among them, so they are neighbours on the curve. The law is `rows` (counts at most one apart),
and it goes first: a group is parted where the cut between two shards falls within it, and only there.

Defined cases: a null text has no bytes (size 1, CRC 0); null language or source is a value of its own, before all others; rows that are repeated, also with the same identifier or none, are
each placed; an empty table gives no rows; with fewer rows than shards, the last shards stay empty. Columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graphloom.llm.common import broadcast_if_small, materialize, numbered, text_or_empty

BITS = 8
SHARDS = 16


def hilbert_index(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each column of `coords` (dimensions x rows), with `bits` bits a dimension.

    Turns the coordinates into the transposed index with exclusive-or steps from the high bit down, then interleaves.
    """
    x = np.array(coords, dtype=np.int64)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            first = np.where(hit, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
            x[0] = first
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix = np.where((x[n - 1] & q) != 0, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _curve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, c in parts:
        yield pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()])))


def _codes(rows: DataFrame, col: str) -> DataFrame:
    """A number from 0 to 2**BITS - 1 for each value of a column, ascending with it, spread over the whole range."""
    cells = 1 << BITS
    ranged = rows.select(col).distinct().repartitionByRange(cells, col).select(F.col(col).alias("value"), F.spark_partition_id().alias("part"))
    ranged = materialize(ranged, f"{col}-ranges")
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    return ranged.select("value", F.least(F.floor(F.col("part") * cells / parts), F.lit(cells - 1)).cast("int").alias("code"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rid_col: str | None = None) -> DataFrame:
    """id, size, text_crc32, curve, position, shard and slot for each row, and the written column `rid_col` as rid if given; shard sizes are at most one row apart.

    Only metadata is sorted, over as many range partitions as the session sets. Positions follow from the number of
    rows in each partition: those few counts are the only thing that is gathered.
    """
    text = text_or_empty(text_col)
    meta = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        *([F.col(rid_col).alias("rid")] if rid_col else []),
    )
    meta = materialize(meta, "shard-metadata")
    place = F.struct(F.col("lang").isNotNull().alias("has_lang"), "lang", F.col("source").isNotNull().alias("has_source"), "source")
    mixed = meta.groupBy("digest").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
    mixed = materialize(mixed.select("digest", "least"), "mixed-groups")
    meta = meta.join(broadcast_if_small(mixed, 128), "digest", "left")
    meta = meta.withColumn("at_lang", _of_group("lang")).withColumn("at_source", _of_group("source"))
    for dim in ("lang", "source"):
        codes = broadcast_if_small(_codes(meta.select(F.col(f"at_{dim}").alias(dim)), dim), 128)
        meta = meta.join(codes.withColumnsRenamed({"value": f"{dim}_value", "code": f"{dim}_code"}), F.col(f"at_{dim}").eqNullSafe(F.col(f"{dim}_value")))
    steps = F.least(F.floor(F.log2("size") * 8), F.lit((1 << BITS) - 1)).cast("int")
    curve = F.pandas_udf(_curve, LongType())("lang_code", "source_code", steps)
    placed = meta.select("id", "size", "text_crc32", "digest", *(["rid"] if rid_col else []), curve.alias("curve"))
    order = ["curve", "size", "digest", "id"]
    ranked = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = materialize(ranked, "hilbert")
    low = F.lit(1 << 33)
    part, within = F.floor(F.col("at") / low), F.col("at") % low
    counts = sorted((r["part"], r["n"]) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    spark, total, starts = docs.sparkSession, 0, []
    for p, n in counts:  # one number for each range partition, not for each row
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    ranked = ranked.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("position", F.col("start") + within)
    short, extra = divmod(total, shards)
    pos, cut = F.col("position"), extra * (short + 1)
    shard = F.when(pos < cut, F.floor(pos / (short + 1))).otherwise(extra + F.floor((pos - cut) / max(short, 1))).cast("int")
    slot = F.when(pos < cut, pos % (short + 1)).otherwise((pos - cut) % max(short, 1)).cast("long")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "position", shard.alias("shard"), slot.alias("slot"), *(["rid"] if rid_col else []))


def _of_group(col: str) -> Column:
    """A row's own value, or that of its group's place if the group's rows differ."""
    return F.when(F.col("least").isNotNull(), F.col(f"least.{col}")).otherwise(F.col(col))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **columns: str) -> None:
    """Write `docs` as one folder a shard, each in curve order. Rows are told apart by a number that is written with them, so identifiers may repeat or be null."""
    rows, rid = numbered(docs)
    placed = hilbert_shards(rows, shards, rid_col=rid, **columns).select(F.col("rid").alias(rid), F.col("shard").alias(f"{rid}_shard"), F.col("slot").alias(f"{rid}_slot"))
    rows = rows.drop("shard").join(placed, rid).withColumnRenamed(f"{rid}_shard", "shard")  # a column of that name gives way to the folders'
    rows = rows.repartition("shard", (F.col(f"{rid}_slot") / 100_000).cast("int")).sortWithinPartitions("shard", f"{rid}_slot")
    rows.drop(rid, f"{rid}_slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
