"""Exact dedup with a log-structured merge index of text digests (DataFrame functions only).

* A *memtable* is what one task has read, at most `memtable_rows` rows. Its flush is one Parquet file of the batch's row table, sorted by digest.
* A batch's *run* has one row a digest, the smallest (order key, identifier) and the number of rows, merged from the memtables. Runs are sorted by digest, with a Bloom filter on it, and lie in
  levels: a batch's run is on level 0, and once a level has `fanout` runs, *compaction* merges them into one run of the next level, keeping the smallest identifiers and adding up the
  numbers. So a digest is rewritten once a level, however many batches come.
* A *hit* is a digest with more than one row, in the batch or in earlier runs. Earlier runs are searched for the batch's digests only: a few are looked up by value, and the scan skips
  whatever their sort order and filters rule out; many are semi-joined. The texts of hits receive byte verification: a digest with two different texts is a collision, and its rows are
  grouped by text instead of by digest. An index that is to take further batches keeps one copy of each text for that.

Two texts are equal if they are identical after the six ASCII white-space characters are deleted. Defined cases: a
null text counts as empty, and all empty texts are one group; of equal texts the one with the most code points
stays, then the smallest identifier (null last), then, for rows that are repeated with the same identifier, the
first one that was read, so that exactly one row of a group stays. A later batch's row may take the place of an earlier one; results are for the rows of the batch, judged by all rows so far.
An empty table gives an empty result. Columns other than identifier and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, materialize, numbered, table_path, text_or_empty, without_rows

#: The characters of [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: More levels than any index gets: with the least fanout, 2, for 2**32 batches.
LEVELS = 32


def normalized(text: Column) -> Column:
    """`text` without ASCII white space: six byte-wise replacements, faster than a regular expression."""
    for c in SPACES:
        text = F.replace(text, F.lit(c))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _least() -> Column:
    return F.min(F.struct("order_key", F.col("id").isNull().alias("no_id"), "id", "batch", "rid"))


class DigestIndex:
    """The index over (digest, order key, identifier); `path` is a folder in the shared file system, and may hold the index of an earlier session.

    `texts`: keep a copy of each text, without which a second batch can't be verified.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = 1_000_000, digest=sha256, texts: bool = False, fanout: int = 4, lookups: int = 200):
        self.spark, self.memtable_rows, self.digest, self.texts, self.fanout, self.lookups = spark, memtable_rows, digest, texts, fanout, lookups
        self.path = path or table_path(spark, "digest-index")

    def _names(self, folder: str) -> list[str]:
        """The tables in a folder that were written to the end."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(conf)
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(str(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def next_batch(self) -> int:
        return 1 + max((int(n.partition("=")[2]) for n in self._names("rows")), default=-1)

    def runs(self) -> list[str]:
        """The paths of the live runs: those of a level that were merged into a finished run above no longer count."""
        out, covered = [], -1
        levels = [self._names(f"level={k}") for k in range(LEVELS)]
        for k in range(LEVELS - 1, -1, -1):  # a run is named by the last batch in it
            for name in levels[k]:
                if int(name.partition("=")[2]) > covered:
                    out.append(f"{self.path}/level={k}/{name}")
            covered = max([covered, *(int(n.partition("=")[2]) for n in levels[k])])
        return out

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        options = {"parquet.bloom.filter.enabled#digest": "true", "maxRecordsPerFile": str(self.memtable_rows)}
        rows.sortWithinPartitions("digest").write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def flush(self, docs: DataFrame, id_col: str, text_col: str, rid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Adds the rows of `docs` as a batch: its row table (id, digest, order_key, rid, batch) and its run (digest, best, n)."""
        batch = self.next_batch()
        if batch and not self.texts:
            raise ValueError("an index without texts can't verify a second batch")
        text = text_or_empty(text_col)
        rows = docs.select(
            F.col(id_col).alias("id"),
            self.digest(normalized(text)).alias("digest"),
            (-F.char_length(text)).cast("long").alias("order_key"),
            (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"),
        ).withColumn("batch", F.lit(batch))
        if self.texts:
            own = docs.select(self.digest(normalized(text)).alias("digest"), normalized(text).alias("norm"), F.col(id_col).alias("id"), (-F.char_length(text)).cast("long").alias("order_key"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.lit(batch).alias("batch"))
            self._write(own.groupBy("digest", "norm").agg(_least().alias("best"), F.count("*").alias("n")), f"texts/batch={batch}")
        rows = self._write(rows, f"rows/batch={batch}")
        return rows, self._write(rows.groupBy("digest").agg(_least().alias("best"), F.count("*").alias("n")), f"level=0/run={batch}")

    def lookup(self, digests: DataFrame, runs: list[str]) -> DataFrame:
        """The rows of runs with one of the digests. Few are compared by value, so that the scan skips by sort order and filters."""
        few = [r["digest"] for r in digests.select("digest").limit(self.lookups + 1).collect()]  # at most lookups + 1 rows
        found = self.spark.read.parquet(*runs)
        if len(few) <= self.lookups:
            return found.where(F.col("digest").isin(*[F.lit(d) for d in few]))
        return found.join(digests.select("digest"), "digest", "left_semi")

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next."""
        level = 0
        while len(names := [n for n in self.runs() if f"/level={level}/" in n]) >= self.fanout:
            merged = self.spark.read.parquet(*names).groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").cast("long").alias("n"))
            last = max(int(n.rpartition("=")[2]) for n in names)
            self._write(merged, f"level={level + 1}/run={last}")
            for n in names:
                self._delete(n.removeprefix(f"{self.path}/"))
            level += 1

    def all_texts(self) -> DataFrame | None:
        """(digest, norm, best, n) of all batches, if texts are kept."""
        return self.spark.read.parquet(*(f"{self.path}/texts/{n}" for n in self._names("texts"))) if self.texts else None


def collisions(docs: DataFrame, hits: DataFrame, text_col: str, digest=sha256, earlier: DataFrame | None = None) -> DataFrame:
    """The hit digests that stand for more than one text. `earlier`: (digest, norm) of texts that are not in `docs`.

    Grouping by (digest, text) compares bytes; each task passes on one row for each text it saw, so a large group of
    copies costs one text a task.
    """
    norm = normalized(text_or_empty(text_col))
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"))
    if earlier is not None:
        texts = texts.unionByName(earlier.select("digest", "norm"))
    texts = texts.join(broadcast_if_small(hits.select("digest"), 64), "digest", "left_semi")
    return texts.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, rid_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256, rid, and the sizes it was judged by.

    `rid` is the row's number: that of the written column `rid_col`, or else one that names rows of this result only. With an `index` that holds earlier batches, rows are
    judged together with those.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    before, batch = index.runs(), index.next_batch()
    rows, found = index.flush(docs, id_col, text_col, rid_col)
    if before:
        both = found.unionByName(index.lookup(found, before))
        found = materialize(both.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").cast("long").alias("n")), "with-earlier")
    clash = materialize(collisions(docs, found.where("n > 1"), text_col, index.digest, index.all_texts()), "collisions")
    if not clash.isEmpty():  # never with SHA-256; the texts of these digests are their own keys
        text = text_or_empty(text_col)
        small = broadcast_if_small(clash, 64)
        own = docs.select(F.col(id_col).alias("id"), index.digest(normalized(text)).alias("digest"), normalized(text).alias("norm"), (-F.char_length(text)).cast("long").alias("order_key"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), F.lit(batch).alias("batch"))
        own = materialize(own.join(small, "digest", "left_semi"), "collided")
        best = own.groupBy("digest", "norm").agg(_least().alias("best"), F.count("*").alias("n"))
        if before:
            earlier = index.all_texts().join(small, "digest", "left_semi").where(F.col("best.batch") < batch)
            best = best.unionByName(earlier.select(*best.columns)).groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").cast("long").alias("n"))
        apart = own.join(best, ["digest", "norm"])
        rest = rows.join(small, "digest", "left_anti").join(found, "digest")
        columns = ["id", "digest", "order_key", "rid", "batch", "best", "n"]
        joined = rest.select(*columns, F.lit(None).cast("string").alias("norm")).unionByName(apart.select(*columns, "norm"))
    else:
        joined = rows.join(found, "digest").withColumn("norm", F.lit(None).cast("string"))
    index.compact()
    sha = F.lower(F.hex("digest")) if index.digest is sha256 else F.coalesce(F.sha2(F.col("norm"), 256), F.lower(F.hex("digest")))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        ((F.col("rid") == F.col("best.rid")) & (F.col("batch") == F.col("best.batch"))).alias("kept"),
        sha.alias("text_sha256"),
        (-F.col("order_key")).alias("n_code_points"),
        "rid",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that dedup_exact drops."""
    rows, rid = numbered(docs)
    return without_rows(rows, rid, dedup_exact(rows, id_col, text_col, rid_col=rid).where("not kept"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "n_code_points")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
