"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import fresh_path as table_path
from graphloom.storage import materialize

__all__ = ["bounded_batches", "broadcast_if_small", "materialize", "numbered", "table_path", "text_or_empty", "without_rows"]

#: A table is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the table's measured size is within `limit`; else leave the join to shuffle.

    The size is `row_bytes` (what a row takes at least) for each row, and the bytes that its strings, binaries and arrays of strings hold. `df` should be a written table, as it is read here.
    """
    kinds = {c: k for c, k in df.dtypes if k in ("string", "binary", "array<string>")}
    held = [F.sum(F.octet_length(F.concat_ws("", c) if k == "array<string>" else F.col(c))) for c, k in kinds.items()]
    n, *parts = df.agg(F.count("*"), *held).first()
    return F.broadcast(df) if n * row_bytes + sum(x or 0 for x in parts) <= limit else df


#: Rows that are sent to Python at a time, each with a whole text or an array as long.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to BATCH_ROWS; a lower setting stays. With the default of 10,000 whole texts, buffers outside the heap get large.

    Bytes are bounded by Spark's own limit on a batch (64 MB by default). The setting stays lowered, as results are lazy and the session decides only when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` written once with a number for each row, and that column's name, which no other column has.

    The numbers stay the rows' own: a scan that is planned again, with other cores registered, may cut the files differently and number rows anew.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_row{i}" for i in range(len(taken) + 1)) if n not in taken)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without_rows(rows: DataFrame, rid: str, dropped: DataFrame) -> DataFrame:
    """The table of `numbered` without the rows whose number is in `dropped` (rid), and without the number."""
    gone = materialize(dropped.select(F.col("rid").alias(rid)).distinct(), "dropped")
    return rows.join(broadcast_if_small(gone, 24), rid, "left_anti").drop(rid)
