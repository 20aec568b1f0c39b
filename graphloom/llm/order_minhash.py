"""Near-dedup with Order MinHash.

A text is its sequence of words, and its k-mers are pairs of neighbouring words, each labelled with the number of its earlier occurrences in the text, so that labelled
k-mers are unique within a text. A sketch is the `LENGTH` k-mers that come first under one of `SKETCHES` random orders, *in the order of the text*; two texts are candidates if one of
their sketches is equal. That is likely for texts a small edit distance apart, and sensitive to order as well as to content.

Candidates are verified by banded alignment: the longest common subsequence of both texts' words, whose matches may lie no further off the diagonal than the threshold leaves
room for. The similarity is the number of aligned words divided by the words of the longer text (for replaced, inserted or deleted words alone that is one less the edit distance by the
longer text), and texts are linked from 0.8 on. Single words are aligned, not 5-word shingles: one edited word costs five shingles, so a text with one word in twenty
replaced would fall under 0.8.

What a sketch misses: with a share e of the words replaced, one by one, all sketches of a pair differ with a probability below 0.0001 up to e = 0.1, below 0.01 at 0.15, and 0.12 at the
threshold itself (0.2). A class is missed only if all its links are. Texts of up to `SHORT` words have no sketches and leave no link to chance: they, and texts long enough to be
similar to one, are candidates if they share a word of their prefixes. A prefix is the n - ceil(0.8 n) + 1 rarest of a text's n labelled words (by the number of such texts that hold them, then by
hash); two similar texts share at least ceil(0.8 n) words of either, so the rarest shared one is in both prefixes.

No candidate is left out, and no pairs of all members of a bucket (equal sketches or prefix words) are made. Texts with the same words are one node; all nodes of a bucket are compared with one of it,
the first by a hash of the node. What is still in several classes then is compared within the bucket, in tiles of `TILE` by `TILE` nodes whose words a task holds: each two nodes of different classes are aligned, once for all keys that they share, unless
their lengths or their bags of words (counts of hashed words in `BINS` bins, which two similar texts can't differ in by more than in their words) show that they are under the threshold. A
tile gives only the links that join two classes, so fewer than it has nodes, however many pairs it compares. Its time still grows with the square of the nodes that are in different classes of a bucket.

Words are runs of letters, digits, underscores and non-ASCII characters of the lower-case text. Defined cases: null texts count as empty; texts
without a word are one class; repeated rows and texts with equal words share a class; identifiers may be null or repeated; an empty table gives no rows; columns other than identifier
and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, broadcast_if_small, materialize, numbered, without_rows
from graphloom.storage import delete, recorded

#: Words in a k-mer, k-mers in a sketch, sketches of a text.
KMER, LENGTH, SKETCHES = 2, 3, 30
SIMILARITY = 0.8
#: Texts of so many words have exact candidates; `PARTNER` is the most words that a text similar to one of them can have.
SHORT = 40
PARTNER = math.floor(SHORT / SIMILARITY + 1e-9)
#: Pairs with one head that a task compares in a row before it needs the head again.
CHUNK = 256
#: Bins of a text's bag of words (a power of two); rows and words of a bucket's part, two of which a task compares at a time.
BINS, TILE, TILE_WORDS = 256, 256, 2_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * _U(2) + _U(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_BASE), -1, 1 << 64)
_cache = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest text so far."""
    if _cache["n"] < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _cache.update(n=size, up=_powers(int(_BASE), size), down=_powers(_INVERSE, size))
    return _cache["up"], _cache["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> tuple[np.ndarray, bytes]:
    """A 32-bit hash of each word, and a digest of all words in order."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, np.int32), hashlib.blake2b(b"", digest_size=16).digest()
    raw = np.frombuffer(data, np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    normal = np.where(inside, raw, 32).astype(np.uint8).tobytes()
    return (words >> _U(32)).astype(np.uint32).view(np.int32), hashlib.blake2b(b" ".join(normal.split()), digest_size=16).digest()


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """The labelled k-mers in the order of the text; unique. A text of fewer than k words is one k-mer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.view(np.uint32).astype(np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return _mix(h)
    begins = np.flatnonzero(new)
    seen = np.empty(n, np.uint64)
    seen[order] = np.arange(n) - np.repeat(begins, np.diff(np.concatenate([begins, [n]])))
    return _mix(h + seen * _BASE)


def sketch(words: np.ndarray) -> np.ndarray:
    """A key for each of the sketches; none for short texts."""
    if len(words) <= SHORT:
        return np.zeros(0, np.int64)
    items = labelled(words, KMER)
    keys = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 18) // len(items))
    for low in range(0, SKETCHES, step):  # a bounded amount of memory for very long texts
        ranks = items[None, :] * _MULTIPLIERS[low : low + step, None]
        first = np.sort(np.argpartition(ranks, LENGTH - 1, axis=1)[:, :LENGTH], axis=1)
        chosen = items[first]
        key = np.arange(low, low + len(ranks), dtype=np.uint64)
        for i in range(chosen.shape[1]):
            key = _mix(key * _BASE + chosen[:, i])
        keys[low : low + step] = key
    return keys.view(np.int64)


def _common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence within the band, with a column of the alignment table as the bits of one number."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    column, window = full, (1 << (2 * band + 1)) - 1
    for j, w in enumerate(b):
        if hit := places.get(w):
            hit &= window << (j - band) if j >= band else window >> (band - j)
            step = column & hit
            column = ((column + step) | (column - step)) & full
    return len(a) - column.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, items_a: np.ndarray | None = None, items_b: np.ndarray | None = None) -> int:
    """How many words of two texts a banded alignment matches; 0 if it can't reach the threshold, and perhaps fewer than all if it does."""
    need = math.ceil(SIMILARITY * max(len(a), len(b)) - 1e-9)
    if min(len(a), len(b)) < need:
        return 0
    items_a = labelled(a, 1) if items_a is None else items_a
    items_b = labelled(b, 1) if items_b is None else items_b
    _, at_a, at_b = np.intersect1d(items_a, items_b, assume_unique=True, return_indices=True)
    if len(at_a) < need:
        return 0
    at_b = at_b[np.argsort(at_a)]
    if (at_b[1:] > at_b[:-1]).all():
        return len(at_b)
    tails: list[int] = []  # the longest ascending run of equally labelled words is an alignment, though not always the longest one
    for x in at_b.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    if len(tails) >= need:
        return len(tails)
    m = _common(a.tolist(), b.tolist(), max(len(a), len(b)) - need)
    return m if m >= need else 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two texts' word hashes; values below the threshold are given as 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return aligned(a, b) / max(len(a), len(b))


def _sketches(docs: DataFrame) -> DataFrame:
    """rid, id, sig, n, keys and words of each row; `docs` has id and text, and rid if it is numbered."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                found = [word_hashes(text) for text in batch["text"].to_pylist()]
                keys = [sketch(words) for words, _ in found]
                columns = [pa.array([s for _, s in found], pa.binary()), pa.array([len(w) for w, _ in found], pa.int32()), _lists(keys, pa.int64()), _lists([w for w, _ in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch["rid"], batch["id"], *columns], ["rid", "id", "sig", "n", "keys", "words"])

    kind = dict(docs.dtypes)["id"]
    return docs.select(F.col("rid") if "rid" in docs.columns else F.monotonically_increasing_id().alias("rid"), "id", "text").mapInArrow(rows, f"rid long, id {kind}, sig binary, n int, keys array<long>, words array<int>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return [flat[ends[i] : ends[i + 1]] for i in range(len(column))]


def _prefixes(nodes: DataFrame, name: str) -> DataFrame:
    """node and item for each word of a text's prefix that another text of `nodes` (node, n, words) holds too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, words in zip(batch["node"].to_pylist(), batch["n"].to_pylist(), _arrays(batch["words"]), strict=True):
                items = labelled(words, 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node)), pa.array(np.full(n, n, np.int32)), pa.array(items)], ["node", "n", "item"])

    held = materialize(nodes.select("node", "n", "words").where("n > 0").mapInArrow(rows, "node long, n int, item long"), f"{name}-items")
    often = materialize(held.groupBy("item").agg(F.count("*").alias("texts")).where("texts > 1"), f"{name}-shared")
    ranked = held.join(broadcast_if_small(often, 24), "item").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "item"))).alias("items"))
    # the words that no other text holds are the rarest and come first; they can't be shared
    length = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int") + 1 - (F.col("n") - F.size("items"))
    return ranked.where(length > 0).select("node", F.explode(F.slice("items", F.lit(1), length)).alias("item")).select("node", "item.item")


def _linked(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of `pairs` (a, b, chunks) whose texts are similar. A head a with many pairs is split into as many chunks as its pairs say; its words are sent once for each.

    The joins with words shuffle whatever their size, so that what a small input costs carries over to a large one.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    heads = dealt.select("a", "chunk").distinct().join(words.withColumnRenamed("node", "a").hint("merge"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "words")
    others = dealt.join(words.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "chunk", "b", "words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = items = None
        for batch in batches:
            found: tuple[list[int], list[int]] = [], []
            for a, b, own in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), _arrays(batch["words"]), strict=True):
                if b is None:  # the head of the rows that follow
                    head = own.copy()
                    items = labelled(head, 1)
                elif aligned(head, own, items):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return heads.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "words").mapInArrow(rows, "a long, b long")


class _Tile:
    """Rows of one bucket (part, node, root, all keys, words), of one part or of two, and the links that are needed to join what is similar in them."""

    def __init__(self, key: int) -> None:
        self.key = key
        self.part: list[int] = []
        self.node: list[int] = []
        self.root: list[int] = []
        self.keys: list[set[int]] = []
        self.words: list[np.ndarray] = []

    def add(self, part: int, node: int, root: int, keys: list[int], words: np.ndarray) -> None:
        self.part.append(part)
        self.node.append(node)
        self.root.append(root)
        self.keys.append(set(keys))
        self.words.append(words)

    def links(self) -> Iterator[tuple[int, int]]:
        """Compares each two rows of different classes, until all that is similar is in one class: by length, by bags of words, then by alignment. Two rows that share several keys are
        aligned for the least of them alone.

        A bag holds how many words fall in each of `BINS` bins, 255 at most. Two texts with s words in common differ in n + m - 2s words, and their bags by no more than that.
        """
        n = np.array([len(w) for w in self.words])
        order = np.argsort(n, kind="stable")
        n, part, root = n[order], np.array(self.part)[order], np.array(self.root)[order]
        words, keys = [self.words[i] for i in order], [self.keys[i] for i in order]
        if (root == root[0]).all():
            return
        both = (part != part[0]).any()  # pairs within a part are for the tile of that part
        bags = np.stack([np.minimum(np.bincount(w & (BINS - 1), minlength=BINS), 255).astype(np.int16) for w in words])
        ends = np.searchsorted(n, np.floor(n / SIMILARITY + 1e-9), "right")
        need = np.ceil(SIMILARITY * n - 1e-9)  # by the longer text, which is the later one
        items: dict[int, np.ndarray] = {}
        for x in range(len(n) - 1):
            fit = root[x + 1 : ends[x]] != root[x]
            if both:
                fit &= part[x + 1 : ends[x]] != part[x]
            others = np.flatnonzero(fit) + x + 1
            for low in range(0, len(others), 1024):
                some = others[low : low + 1024]
                far = np.abs(bags[some] - bags[x]).sum(axis=1, dtype=np.int64)
                for y in some[n[x] + n[some] - far >= 2 * need[some]].tolist():
                    if root[x] == root[y] or min(keys[x] & keys[y]) != self.key:
                        continue
                    for k in (x, y):
                        if k not in items:
                            items[k] = labelled(words[k], 1)
                    if aligned(words[x], words[y], items[x], items[y]):
                        root[root == root[y]] = root[x]
                        yield self.node[order[x]], self.node[order[y]]


def _rest(rows_of: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar texts of a bucket; `rows_of` has key, parts, node, root, keys (all that `rows_of` has of the node) and words. A bucket's rows are cut into `parts` parts, and each two parts are compared in a tile of their own."""
    tiles = rows_of.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    tiles = tiles.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "keys", "words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(tile: _Tile) -> pa.RecordBatch:
            found = list(tile.links())
            return pa.RecordBatch.from_arrays([pa.array([link[k] for link in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        last, tile = None, _Tile(0)
        for batch in batches:
            for key, i, j, *row, words in zip(*(c.to_pylist() for c in batch.columns[:-1]), _arrays(batch["words"]), strict=True):
                if (key, i, j) != last:
                    if len(tile.node) > 1:
                        yield given(tile)
                    last, tile = (key, i, j), _Tile(key)
                tile.add(*row, words.copy())
        if len(tile.node) > 1:
            yield given(tile)

    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(rows, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (one node of its component) for every node of `edges` (a, b).

    Each round, a node moves to the least of itself and its neighbours, by a fixed random order; then the edges are drawn between the nodes that were moved to. A star is
    one node after two rounds, and a path loses a share of its nodes in each.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("to"))
        step = least.select(F.col("u").alias("node"), F.when(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")) < F.col("to"), F.col("u")).otherwise(F.col("to.v")).alias("to"))
        step = materialize(step, "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            labels = materialize(labels.join(step.withColumnsRenamed({"node": "root"}), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        one, two = step.toDF("u", "x"), step.toDF("v", "y")
        edges = edges.join(one, "u").join(two, "v").where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        edges = materialize(edges, "contracted")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if labels is None else labels


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: id, class_id (the least identifier of its class), class_size (rows), kept (true for one row of the class) and rid (that of the written column `rid_col`, if given)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(rid_col).alias("rid")] if rid_col else []))
    sketches = materialize(_sketches(source), "sketches")
    by_id = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first")
    nodes = materialize(sketches.groupBy("sig").agg(F.min("rid").alias("node"), F.count("*").alias("rows"), by_id), "nodes")
    heads = sketches.join(nodes.select(F.col("node").alias("rid")).hint("merge"), "rid", "left_semi").withColumnRenamed("rid", "node")
    by_word = _prefixes(heads.where(F.col("n") <= PARTNER), "short").select(F.xxhash64(F.lit("prefix"), "item").alias("key"), "node")
    dealt = heads.select(F.explode("keys").alias("key"), "node").unionByName(by_word).repartition("key")  # the one shuffle of all keys: both sides of the join read it
    shared = dealt.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(dealt.hint("shuffle_hash").join(shared, "key").select("key", "node", "leader", "size"), "buckets")
    ids = broadcast_if_small(materialize(buckets.select("node").distinct(), "wanted-nodes"), 24)  # the words of all other texts need not be shuffled
    wanted = materialize(sketches.withColumnRenamed("rid", "node").join(ids, "node").select("node", "n", "words"), "wanted")
    words = wanted.select("node", "words")

    def joined(roots: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """`roots` (node, n, root) with the components that `edges` connect as one."""
        ends = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = components(ends).toDF("root", "to")
        return materialize(roots.join(moved, "root", "left").select("node", "n", F.coalesce("to", "root").alias("root")), f"{name}-roots")

    pairs = buckets.where("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max(F.ceil(F.col("size") / CHUNK)).alias("chunks"))
    roots = joined(wanted.select("node", "n", F.col("node").alias("root")), materialize(_linked(pairs, words), "first-links"), "first")

    # a leader was compared with all of its bucket; of the others, those in different classes may still be similar
    rest = materialize(buckets.where("size > 2 and node <> leader").select("key", "node").join(roots, "node"), "rest")
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_WORDS)).alias("parts")
    mixed = rest.groupBy("key").agg(parts, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "parts")
    rest = materialize(rest.join(materialize(mixed, "open"), "key").select("key", "parts", "node", "root"), "rest-open")
    held = rest.groupBy("node").agg(F.collect_list("key").alias("keys")).join(words.hint("merge"), "node")
    roots = joined(roots, materialize(_rest(rest.join(held.hint("merge"), "node")), "rest-links"), "rest")

    own = nodes.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"), "rows", "first")
    own = materialize(own, "node-roots")
    classes = materialize(own.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size")), "classes")
    labels = materialize(own.select("sig", "root").join(classes, "root"), "class-labels")
    return sketches.select("rid", "id", "sig").join(labels, "sig").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "rid")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each class."""
    rows, rid = numbered(docs)
    with recorded() as tables:
        classes = near_classes(rows, id_col, text_col, rid)
    kept = without_rows(rows, rid, classes.where("not kept"))  # writes the numbers of the dropped rows; nothing reads the classes after that
    delete(docs.sparkSession, tables)
    return kept


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
