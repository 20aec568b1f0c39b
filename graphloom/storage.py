"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a local session gets a temporary folder; on a cluster it is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table that no other has, in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The setting without which a scan of a bucketed table doesn't say that it is sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_catalogued: set[str] = set()


def bucketed(df: DataFrame, name: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """`df` written as a table that is bucketed and sorted by `keys`, one file a bucket: joins on exactly these keys read it without shuffling or sorting it, however often.

    There are as many buckets as the session has shuffle partitions, so the other side of a join is dealt as it would be anyway. The session's setting `ORDERED` is switched on, and stays so.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(ORDERED, "true")
    table = f"graphloom_{name}_{uuid.uuid4().hex}"
    rows = df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).sortBy(*keys)
    rows.option("path", fresh_path(spark, name)).saveAsTable(table)
    _catalogued.add(table)
    return spark.table(table)


def forget(spark: SparkSession) -> None:
    """Deletes all tables that this application has written in the shared folder. Results read them, so only after these are written elsewhere."""
    while _catalogued:
        spark.sql(f"DROP TABLE IF EXISTS {_catalogued.pop()}")
    delete(spark, [_own_folder(spark)])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables (or folders of them) that nothing reads any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


_records: ContextVar[tuple[list[str], ...]] = ContextVar("records", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that `materialize` writes within the block."""
    paths: list[str] = []
    token = _records.set((*_records.get(), paths))
    try:
        yield paths
    finally:
        _records.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts the lineage, and what a lost executor had is still there."""
    path = fresh_path(df.sparkSession, name)
    for paths in _records.get():
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
