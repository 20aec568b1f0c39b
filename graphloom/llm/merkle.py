"""Merkle manifest of a dataset, in levels of windows.

Each row is a leaf: a digest of its fields. Within a group, leaves ascend by identifier; while a group has several nodes, each `FAN` consecutive ones (the last run: fewer, even one) become the digest of
their digests. What remains is the group's subroot; subroots, in the order of the groups, likewise give the root. A row's proof is, level by level, what else its runs hold: with it and the row alone, the
root can be computed again.

A level is one window, partitioned by group and number of the parent, whose ordered full-frame `collect_list` supplies both the parent's preimage and the siblings. It collects each node once, from the
first leaf below it, so parents are deduplicated before the next level. `SPAN` levels are computed on rows that lie together by group and block of FAN^SPAN leaves: one shuffle for all of them, and no
window holds more rows than a block, however large a group is. Then one row a block goes on. So with n leaves there are log(n) / log(FAN^SPAN) shuffles.

Places in a group follow from a range partitioned order: a row's place is its place in its partition and group, plus the rows of that group in earlier partitions, so that no task sees a whole group.

Defined cases: fields are hashed whole; nulls as `-`. Nulls come first among groups and identifiers; rows with equal identifiers are ordered by their leaves, and wholly equal rows are leaves of their own, in any
order. A lone leaf is its group's subroot, a lone subroot the root. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes in a run, and levels that are computed after one shuffle.
FAN, SPAN = 3, 6
NO_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts in UTF-8, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`rows`, written, with `idx`, the place within the group from 0, and `m`, the group's number of rows."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), name)
    parts = dealt.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # a row a partition at most
    earlier = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    starts = materialize(parts.select("_part", group, (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("m")), f"{name}-starts")
    return dealt.join(broadcast_if_small(starts, 48), ["_part", group]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _block_levels(nodes: DataFrame, name: str) -> DataFrame:
    """`nodes` (grp, idx, m, digest, ...) with `blk`, `top` (the digest of the node SPAN levels above, or the subroot if that is lower) and `path` up to it, written."""
    size = FAN**SPAN
    rows = nodes.withColumn("blk", F.floor(F.col("idx") / size)).repartition("grp", "blk").withColumn("top", F.col("digest")).withColumn("path", F.array().cast(NO_PATH))
    columns = rows.columns
    for level in range(SPAN):
        below, parent = FAN**level, FAN ** (level + 1)
        run = Window.partitionBy("grp", "blk", F.floor(F.col("idx") / parent)).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = (F.floor(F.col("idx") / below) % FAN).cast("int")
        rows = rows.withColumn("_kids", F.collect_list(F.when(F.col("idx") % below == 0, F.col("top"))).over(run))
        left, right = F.slice("_kids", F.lit(1), own), F.slice("_kids", own + 2, F.lit(FAN))
        step = F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))
        open_ = F.col("m") > below  # else the group has one node already
        rows = rows.withColumns({"path": F.when(open_, F.concat("path", F.array(step))).otherwise(F.col("path")), "top": F.when(open_, F.sha2(F.concat_ws("", "_kids"), 256)).otherwise(F.col("top"))})
    return materialize(rows.select(*columns), name)


def trees(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each group of `leaves` (grp, idx, m, digest, ...): these rows with blk and the path within the block, and a table (grp, blk, subroot, path) with what is above each block."""
    levels = [_block_levels(leaves, f"{name}-0")]
    while True:
        heads = levels[-1].where(F.col("idx") % FAN**SPAN == 0).select("grp", F.col("blk").alias("idx"), F.ceil(F.col("m") / FAN**SPAN).alias("m"), F.col("top").alias("digest"))
        if heads.where("m > 1").isEmpty():
            break
        levels.append(_block_levels(heads, f"{name}-{len(levels)}"))
    above = heads.select("grp", F.lit(0).cast("long").alias("blk"), F.col("digest").alias("subroot"), F.array().cast(NO_PATH).alias("path"))
    for nodes in reversed(levels[1:]):
        joined = nodes.select("grp", "idx", "blk", F.col("path").alias("own")).join(above, ["grp", "blk"])
        above = materialize(joined.select("grp", F.col("idx").alias("blk"), "subroot", F.concat("own", "path").alias("path")), f"{name}-above")
    return levels[0], above


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf upwards."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda below, x: digest(x["left"], below, x["right"]))


def manifest(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, path, proof_sha256, folded_root and verified of each row.

    `tampered` gives a text column from the one it is called with; the root is then computed again with the rows as they are with that text, and the siblings of the original.
    """
    spark = docs.sparkSession

    def leaf(text: Column) -> Column:
        return digest(*(field(text if c == text_col else F.col(c)) for c in fields))

    # groups by a key without nulls, in their order
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    text = F.col(text_col)
    seen = F.when(~text.eqNullSafe(tampered(text)), leaf(tampered(text))) if tampered else F.lit(None).cast("string")
    rows = materialize(docs.select(F.col(id_col).alias("id"), key.alias("grp"), leaf(text).alias("digest"), seen.alias("seen"), F.monotonically_increasing_id().alias("rid")), "leaves")
    # the number parts rows that are wholly equal, however many
    leaves, above = trees(ranked(rows, "grp", ["id", "digest", "rid"], "leaves-ranked"), "groups")

    subroots = above.select("grp", "subroot").distinct()
    placed = ranked(subroots.select(F.col("grp").alias("of"), F.lit("").alias("grp"), F.col("subroot").alias("digest")), "grp", ["of"], "subroots-ranked")
    tops, over = trees(placed, "root")
    up = tops.join(over.select("grp", "blk", F.col("subroot").alias("root"), F.col("path").alias("rest")), ["grp", "blk"]).select(F.col("of").alias("grp"), "root", F.concat("path", "rest").alias("last"))
    above = materialize(above.join(up, "grp").select("grp", "blk", "subroot", "root", F.concat("path", "last").alias("rest")), "above-blocks")

    width = 64 * 2 * 24  # a path of 24 levels
    joined = leaves.join(broadcast_if_small(above, width), ["grp", "blk"]).withColumn("path", F.concat("path", "rest"))
    out = joined.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("seen", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_lines(id_col: str) -> Callable[[Column], Column]:
    """Texts without line feeds where 2 divides the CRC of the identifier."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return lambda text: F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), without_lines("doc_id")).drop("path")


_ID = "CAST(doc_id AS VARCHAR)"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({_ID}) + 1), lambda i: ascii(substr({_ID}, CAST(i AS INT), 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS) + ")"
_NAMES = {c: c for c in FIELDS}


def _tree_sql(name: str, leaves: str) -> str:
    """The nodes of all levels, from `leaves` (grp, idx, d)."""
    return f"""{name} AS (
  SELECT 0 AS lv, grp, idx, d FROM {leaves}
  UNION ALL
  SELECT any_value(lv) + 1, grp, idx // {FAN}, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM {name}) WHERE m > 1 GROUP BY grp, idx // {FAN})"""


def _way_sql(name: str, nodes: str) -> str:
    """For each leaf and level, the siblings before and after."""
    return f"""{name} AS (
  SELECT a.grp, a.idx, b.lv, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx // CAST({FAN}**b.lv AS BIGINT)), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx // CAST({FAN}**b.lv AS BIGINT)), '') AS r
  FROM (SELECT grp, idx, unnest(range(0, (SELECT max(lv) FROM {nodes} y WHERE y.grp IS NOT DISTINCT FROM x.grp))) AS lv FROM {nodes} x WHERE lv = 0) a
  JOIN {nodes} b ON b.grp = a.grp AND b.lv = a.lv AND b.idx // {FAN} = a.idx // CAST({FAN}**(a.lv + 1) AS BIGINT) GROUP BY a.grp, a.idx, b.lv)"""


ORACLE_SQL = f"""WITH RECURSIVE doc AS (SELECT *, CASE WHEN coalesce({_CRC} % 2 = 0, FALSE) THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents),
leaf AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF.format(**_NAMES)} AS d, {_LEAF.format(**(_NAMES | {"text": "seen"}))} AS s FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS idx FROM leaf),
{_tree_sql("node", "placed")},
{_way_sql("way", "node")},
sub AS (SELECT grp AS g, '' AS grp, arg_max(d, lv) AS d FROM node GROUP BY grp),
subs AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS idx FROM sub),
{_tree_sql("top", "subs")},
{_way_sql("topway", "top")},
step AS (SELECT grp, idx, lv, l, r FROM way UNION ALL SELECT p.grp, p.idx, 1000 + t.lv, t.l, t.r FROM placed p JOIN subs s ON s.g = p.grp JOIN topway t ON t.idx = s.idx),
ways AS (SELECT p.doc_id, p.grp, p.d, p.s, list({{'l': w.l, 'r': w.r}} ORDER BY w.lv) FILTER (WHERE w.lv IS NOT NULL) AS w FROM placed p LEFT JOIN step w ON w.grp = p.grp AND w.idx = p.idx GROUP BY p.doc_id, p.grp, p.idx, p.d, p.s),
fold AS (SELECT doc_id, grp, d, coalesce(w, []) AS w, s AS x, 0 AS k FROM ways UNION ALL SELECT doc_id, grp, d, w, sha256(w[k + 1].l || x || w[k + 1].r), k + 1 FROM fold WHERE k < len(w)),
root AS (SELECT arg_max(d, lv) AS root FROM top)
SELECT doc_id, f.d AS leaf, sub.d AS subroot, root, sha256(array_to_string(list_transform(w, lambda y: y.l || y.r), '')) AS proof_sha256, x AS folded_root, x = root AS verified
FROM fold f JOIN sub ON sub.g = f.grp, root WHERE k = len(w)"""
