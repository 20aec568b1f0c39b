"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

A text becomes its template: each number, unit (the word after a number, from a fixed list) and name (a word with one capital, first) is
replaced by a typed placeholder, all other words are lower-cased. Windows of `WINDOW` template tokens of all documents are hash-joined with those of the
benchmark; matching windows of a document and an item at the same distance form an alignment. The values in its slots must be consistent: equal values of the item stand
for equal values in the document (different ones may coincide). A consistent alignment marks the document, so a question with other numbers
or names is caught, and a mere likeness of form is not. A window with fewer than `LITERALS` plain words says little: an alignment of such
windows alone counts only if all values are equal. An alignment that isn't consistent as a whole is judged by its runs of adjoining windows, each by itself in the same way, and its
windows with enough plain words whose own values are all equal always count: one edited value doesn't clear the rest of a copy.

The corpus is read and templated once, with the windows of all widths of the benchmark (items shorter than a window have their own). They are looked up by hash while they stream by: the
benchmark's windows are broadcast if their measured size allows, else Spark shuffles the join behind a Bloom filter of the smaller side. Hits are then compared with the documents' own tokens, so
a collision of hashes marks nothing.

Defined cases: null and empty texts have no tokens and never match; an item shorter than a window is one window of its own length; rows of the benchmark may
repeat; repeated documents are judged alike; an empty table on either side gives no match; item identifiers may be null; columns other than identifier and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, materialize, numbered, text_or_empty, without_rows

WINDOW, LITERALS = 8, 4
#: Units of measurement.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec ms min h hr hrs hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres mile miles inch inches foot feet gram grams dollar dollars cent cents euro euros percent degrees kmh mph w kw v hz pa j kj n mol".split()
NUMBER, NAME, UNIT = "", "", ""
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def template(text: Column) -> Column:
    """The template tokens of a text; they correspond to `values` one by one."""
    x = F.regexp_replace(text, _NUMBER, f" {NUMBER} ")
    x = F.regexp_replace(x, rf"{NUMBER} +(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])", f"{NUMBER} {UNIT}")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}+(?![\p{L}\p{M}])", NAME)
    x = F.regexp_replace(F.lower(x), rf"[^\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+", " ")
    return F.filter(F.split(x, " "), lambda t: t != "")


def values(text: Column) -> Column:
    """The tokens of a text as they stand."""
    return F.regexp_extract_all(text, F.lit(rf"({_NUMBER}|[\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+)"), F.lit(1))


def _windows(tokens: Column, widths: list[int]) -> Column:
    """(pos, width, hash) of each window of each width."""

    def of(width: int) -> Column:
        last = F.size(tokens) - F.lit(width - 1)
        each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct((i - 1).alias("pos"), F.lit(width).alias("width"), F.xxhash64(F.slice(tokens, i, width)).alias("hash")))
        return F.when(last > 0, each).otherwise(F.array().cast("array<struct<pos:int,width:int,hash:bigint>>"))

    return F.concat(*map(of, widths)) if len(widths) > 1 else of(widths[0])


def _verified(hits: DataFrame, docs: DataFrame, rid_col: str, text_col: str) -> DataFrame:
    """The hits (rid, pos, width, hash, words) whose words stand in the document. Only documents with hits are read again, and each is templated once."""
    by_row = materialize(hits.groupBy("rid").agg(F.collect_list(F.struct("pos", "width", "hash", "words")).alias("hits")), "hits-by-row")
    texts = docs.select(F.col(rid_col).alias("rid"), text_or_empty(text_col).alias("text")).join(broadcast_if_small(materialize(by_row.select("rid"), "hit-rows"), 24), "rid", "left_semi")
    rows = texts.select("rid", template(F.col("text")).alias("tokens")).join(by_row, "rid")
    real = F.filter("hits", lambda h: F.slice(F.col("tokens"), h["pos"] + 1, h["width"]) == h["words"])
    return rows.select("rid", F.explode(real).alias("hit")).select("rid", "hit.*")


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, at, hash, words, width, literals) of each window, and (item, at, kind, value) of each slot."""
    text = text_or_empty(text_col)
    tokens = items.select(F.col(id_col).alias("item"), template(text).alias("tokens"), values(text).alias("values")).where(F.size("tokens") > 0)
    tokens = materialize(tokens.withColumn("item_row", F.monotonically_increasing_id()), "items")
    width = F.least(F.size("tokens"), F.lit(WINDOW))
    at = tokens.select("item", "item_row", "tokens", width.alias("width"), F.explode(F.sequence(F.lit(0), F.size("tokens") - width)).alias("at"))
    window = F.slice("tokens", F.col("at") + 1, F.col("width"))
    windows = at.select("item", "item_row", "at", F.xxhash64(window).alias("hash"), window.alias("words"), "width", F.size(F.filter(window, lambda t: ~_is_slot(t))).alias("literals"))
    slots = tokens.select("item_row", F.posexplode(F.arrays_zip("tokens", "values")).alias("at", "t")).select("item_row", "at", F.col("t.tokens").alias("kind"), F.col("t.values").alias("value")).where(_is_slot(F.col("kind")))
    return materialize(windows, "item-windows"), materialize(slots, "item-slots")


def _checked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """For each group: its pairs of an item's and a document's value, the item's values (as many if consistent), and whether any differ."""
    both = pairs.groupBy(*by, "kind", "value", "own").agg(F.count("*").alias("n"))
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_distinct("kind", "value").alias("values"), F.max(F.col("value") != F.col("own")).alias("changed"))


def _parts(matched: DataFrame, pairs: DataFrame, broken: DataFrame) -> DataFrame:
    """Of the alignments in `broken`, which aren't consistent: their windows and whether those changed, by what counts of them."""
    key = ["rid", "item_row", "shift"]
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("at"))
    parts = materialize(matched.join(broken, key, "left_semi").withColumn("run", F.col("at") - rank), "parts")
    inside = parts.select(*key, "run", "at", "width").join(pairs.withColumnRenamed("at", "slot"), key).where("slot >= at AND slot < at + width")
    inside = materialize(inside, "part-slots")
    runs = parts.groupBy(*key, "run").agg(F.max("literals").alias("most")).join(_checked(inside, [*key, "run"]), [*key, "run"], "left")
    differs = inside.groupBy(*key, "at").agg(F.max(F.col("value") != F.col("own")).alias("differs"))
    judged = parts.join(runs, [*key, "run"]).join(differs, [*key, "at"], "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
    whole_run = (F.col("pairs").isNull() | (F.col("pairs") == F.col("values"))) & ((F.col("most") >= LITERALS) | ~F.coalesce("changed", F.lit(False)))
    verbatim = ~F.col("differs") & (F.col("literals") >= LITERALS)
    return judged.where(whole_run | verbatim).groupBy("rid", "item", "item_row", "shift").agg(F.count_distinct("at").alias("windows"), F.max("differs").alias("changed"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rid_col: str = "rid") -> DataFrame:
    """(rid, item, windows, changed) for each document row and item with an alignment that counts, whole or in part. rid: the row's number, which `docs` must hold as a written column `rid_col`."""
    windows, slots = benchmark_windows(items, item_col, item_text_col)
    keys = materialize(windows.select("hash", "width", "words").distinct(), "item-keys")
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # at most WINDOW values
    if not widths:
        return docs.sparkSession.createDataFrame([], f"rid long, item {dict(items.dtypes)[item_col]}, windows long, changed boolean")
    tokens = docs.select(F.col(rid_col).alias("rid"), template(text_or_empty(text_col)).alias("tokens"))
    every = tokens.select("rid", F.explode(_windows(F.col("tokens"), widths)).alias("w")).select("rid", "w.pos", "w.width", "w.hash")
    hits = materialize(every.join(broadcast_if_small(keys, 256), ["hash", "width"]), "hits")
    hits = materialize(_verified(hits, docs, rid_col, text_col), "verified-hits")
    matched = hits.join(windows, ["hash", "width", "words"]).select("rid", "pos", "item", "item_row", "at", "width", "literals")
    matched = materialize(matched.withColumn("shift", F.col("pos") - F.col("at")), "matched")

    covered = matched.select("rid", "item_row", "shift", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)).alias("at")).distinct()
    needed = materialize(covered.join(slots, ["item_row", "at"]), "slots")
    rows = materialize(needed.select("rid").distinct(), "slot-rows")
    texts = docs.select(F.col(rid_col).alias("rid"), text_or_empty(text_col).alias("text")).join(broadcast_if_small(rows, 24), "rid", "left_semi")
    pairs = texts.select("rid", values(F.col("text")).alias("values")).join(needed, "rid").select("rid", "item_row", "shift", "at", "kind", "value", F.element_at("values", F.col("at") + F.col("shift") + 1).alias("own"))
    pairs = materialize(pairs, "slot-pairs")
    checked = _checked(pairs, ["rid", "item_row", "shift"])
    alignments = matched.groupBy("rid", "item", "item_row", "shift").agg(F.count_distinct("at").alias("windows"), F.max("literals").alias("literals"), F.max(F.col("width") < WINDOW).alias("short"))
    whole = alignments.join(checked, ["rid", "item_row", "shift"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    whole = materialize(whole, "alignments")
    consistent = F.col("pairs").isNull() | (F.col("pairs") == F.col("values"))
    judged = whole.where(consistent & ((F.col("literals") >= LITERALS) | ~F.col("changed"))).select("rid", "item", "item_row", "shift", "windows", "changed")
    judged = judged.unionByName(_parts(matched, pairs, whole.where(~consistent).select("rid", "item_row", "shift")))
    return materialize(judged.groupBy("rid", "item").agg(F.max("windows").alias("windows"), F.min("changed").alias("changed")), "contaminated")


def flag_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, contaminated, n_items, n_windows, item_id (most windows, then least) and reparameterised (that item's values differ)."""
    docs, rid = numbered(docs.select(id_col, text_col))
    found = contamination(docs, items, id_col, text_col, item_col, item_text_col, rid)
    best = F.max(F.struct("windows", F.col("item").isNotNull().alias("named"), (~F.col("changed")).alias("same")))
    top = found.groupBy("rid").agg(F.count("*").alias("n_items"), F.sum("windows").alias("n_windows"), best.alias("best"), F.min_by("item", F.struct(-F.col("windows"), F.col("item").isNull(), "item")).alias("item_id"))
    rows = docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("id")).join(top, "rid", "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "item_id", F.coalesce(~F.col("best.same"), F.lit(False)).alias("reparameterised")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without contaminated rows."""
    rows, rid = numbered(docs)
    return without_rows(rows, rid, contamination(rows, items, rid_col=rid))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As flag_contaminated; item_id is -1 for clean documents."""
    flagged = flag_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.withColumn("item_id", F.coalesce("item_id", F.lit(-1)))


def _sql() -> str:
    """The same in SQL, token by token (its regular expressions can't look around)."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return rf"""
WITH t AS (
  SELECT TRUE AS own, doc_id AS id, coalesce(text, '') AS x FROM documents UNION ALL SELECT FALSE, item_id, coalesce(text, '') FROM benchmark),
m AS (
  SELECT own, id, row_number() OVER () AS r, regexp_extract_all(x, '({_NUMBER}|[\p{{L}}\p{{M}}]+)') AS v,
    regexp_extract_all(regexp_replace(regexp_replace(x, '{_NUMBER}', ' {NUMBER} ', 'g'), '{NUMBER} +(?:{units})([^\p{{L}}\p{{M}}]|$)', '{NUMBER} {UNIT}\1', 'g'), '([\p{{L}}\p{{M}}{NUMBER}{UNIT}]+)') AS raw
  FROM t),
k AS (SELECT own, id, r, v, list_transform(raw, lambda y: CASE WHEN regexp_full_match(y, '\p{{Lu}}\p{{Ll}}+') THEN '{NAME}' ELSE lower(y) END) AS k FROM m WHERE len(raw) > 0),
b AS (SELECT id AS item, r AS item_row, v, k, least(len(k), {WINDOW}) AS width, unnest(range(0, len(k) - least(len(k), {WINDOW}) + 1)) AS spot FROM k WHERE NOT own),
bw AS (
  SELECT item, item_row, spot, width, array_to_string(k[spot + 1:spot + width], ' ') AS words,
    len(list_filter(k[spot + 1:spot + width], lambda y: y NOT IN ('{NUMBER}', '{NAME}', '{UNIT}'))) AS literals FROM b),
d AS (SELECT id, r, k, width, unnest(range(0, len(k) - width + 1)) AS pos FROM k, (SELECT DISTINCT width FROM bw) WHERE own AND len(k) >= width),
h AS (
  SELECT d.id, d.r, d.pos, bw.item, bw.item_row, bw.spot, bw.width, bw.literals, d.pos - bw.spot AS shift
  FROM d JOIN bw ON bw.width = d.width AND bw.words = array_to_string(d.k[d.pos + 1:d.pos + d.width], ' ')),
c AS (SELECT DISTINCT r, item_row, shift, unnest(range(spot, spot + width)) AS spot FROM h),
s AS (
  SELECT c.r, c.item_row, c.shift, i.k[c.spot + 1] AS kind, i.v[c.spot + 1] AS value, o.v[c.spot + c.shift + 1] AS own
  FROM c JOIN k i ON i.r = c.item_row JOIN k o ON o.r = c.r WHERE i.k[c.spot + 1] IN ('{NUMBER}', '{NAME}', '{UNIT}')),
q AS (
  SELECT r, item_row, shift, count(DISTINCT (kind, value, own)) AS pairs, count(DISTINCT (kind, value)) AS vals, count(DISTINCT (kind, own)) AS owns, bool_or(value <> own) AS changed
  FROM s GROUP BY r, item_row, shift),
a AS (SELECT id, r, item, item_row, shift, count(DISTINCT spot) AS windows, max(literals) AS literals FROM h GROUP BY id, r, item, item_row, shift),
j AS (
  SELECT a.*, coalesce(q.changed, FALSE) AS changed FROM a LEFT JOIN q USING (r, item_row, shift)
  WHERE (q.pairs IS NULL OR (q.pairs = q.vals AND q.pairs = q.owns)) AND (a.literals >= {LITERALS} OR NOT coalesce(q.changed, FALSE))),
f AS (SELECT id, r, item, max(windows) AS windows, bool_and(changed) AS changed FROM j GROUP BY id, r, item),
top AS (
  SELECT id, count(*) AS n_items, CAST(sum(windows) AS BIGINT) AS n_windows, arg_min(item, (-windows, item)) AS item_id, arg_max(changed, (windows, NOT changed)) AS reparameterised FROM f GROUP BY id, r)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(n_windows, 0) AS n_windows, coalesce(item_id, -1) AS item_id, coalesce(reparameterised, FALSE) AS reparameterised
FROM documents LEFT JOIN top ON top.id = documents.doc_id
"""


ORACLE_SQL = _sql()
