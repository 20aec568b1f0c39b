"""Classification by compression: which zstandard dictionary makes a text smallest.

* `language_of` (language ID): a raw-content dictionary for each language, cut from texts of that language. The predicted language is
  that of the smallest size; the score falls with the margin to the second. `rejected` marks texts without letters (`und`) and texts
  whose margin is narrow: the second size within `NARROW` of the smallest, ties included. Ties predict the language with the most rows to learn from.
* `quality_of` (quality): trained dictionaries of good and of bad texts. The difference of the two sizes for each byte of text, with the smaller size for
  each byte (it shows repetition), goes through a logistic function that was fitted on labelled texts that the dictionaries have not seen.

Texts are compressed whole, in blocks, so that a long text can't hide its character behind what it says itself. The models are fitted on the driver
on a bounded sample: at most `LANG_PER_CLASS` or `QUALITY_PER_CLASS` texts of each class, those with the smallest hash of their identifier, of each at most `SAMPLE_CHARS` characters;
a language's dictionary holds a piece of each of its texts. All else covers all rows.

Defined cases: null and empty texts are `und` with score 0 for language, and get the score of a text of no bytes for quality; repeated rows and ties get equal
results; an empty table gives no rows; if no training text exists, every language is `und` and every quality score 0.5; columns other than identifier and text (and label, for the sample) are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, broadcast_if_small

#: Texts of each class in the sample that models are fitted on.
LANG_PER_CLASS, QUALITY_PER_CLASS = 96, 1000
#: Characters of a text in the sample: with the rows, this bounds what the driver gathers.
SAMPLE_CHARS = 20_000
#: Bytes of a dictionary and of a block.
LANG_DICT, LANG_BLOCK = 48 << 10, 1024
QUALITY_DICT, QUALITY_BLOCK = 110 << 10, 2048
#: Hashes of identifiers are taken modulo this number.
HASHES = 1 << 40
#: A margin below this share of the smallest size is narrow.
NARROW = 0.005
UNDETERMINED = "und"


def crc_mod(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def sample_by_class(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> list[tuple[str, str]]:
    """(label, text; of a longer one SAMPLE_CHARS characters from a place that a hash picks) of at most `per_class` texts of each label, in the order of a hash. `labels`: id, label; only rows to learn from.

    Labels are counted first. Of each, only rows whose hash is below a cut are ranked: one that leaves a few more than `per_class`, however large the table
    is. Then only the chosen texts are read.
    """
    labels = labels.where("label is not null and id is not null")
    cuts = [(r["label"], int(min(1.0, (per_class + 5 * per_class**0.5 + 20) / r["count"]) * HASHES)) for r in labels.groupBy("label").count().collect()]  # a row for each label
    if not cuts:
        return []
    below = labels.sparkSession.createDataFrame(cuts, f"label {dict(labels.dtypes)['label']}, cut long")
    labels = labels.join(broadcast_if_small(below, 64), "label").where(F.pmod(F.xxhash64("id"), F.lit(HASHES)) < F.col("cut")).select("id", "label")
    order = [F.pmod(F.xxhash64("id"), F.lit(HASHES)), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    ids = labels.withColumn("n", rank).where(F.col("n") <= per_class).select("id", "label")
    chosen = labels.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most per_class a label, and labels are few
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(broadcast_if_small(chosen, 64), "id")
    begin = 1 + F.pmod(F.xxhash64("id", F.lit("begin")), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int")
    rows = found.select("label", F.xxhash64("id").alias("h"), "id", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    return [(r["label"], r["text"]) for r in sorted(rows, key=lambda r: (r["h"], r["id"], r["text"]))]


def blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


# Language

#: Keeps ASCII letters and bytes of other characters; everything else becomes a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The lower-case words of a text, one space apart."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _pieces(texts: list[bytes], size: int) -> list[bytes]:
    """A piece of each text, from a place that its hash picks, all of the length at which they add up to `size` bytes (shorter texts whole): many texts, so that no one's own words dominate."""
    low, high = 1, size
    while low < high:  # the greatest length that fits
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(middle, len(t)) + 1 for t in texts) <= size else (low, middle - 1)
    out = []
    for t in texts:
        begin = zlib.crc32(t) % (len(t) - low + 1) if len(t) > low else 0
        if begin:
            begin = t.find(b" ", begin, begin + low) + 1 or begin
        out.append(t[begin : begin + low])
    return out


class LanguageModel:
    def __init__(self, sample: list[tuple[str, str]], rows: dict[str, int] | None = None):
        """`rows`: the number of rows of each language that may be learned from; the most frequent wins ties."""
        rows = rows or {}
        texts: dict[str, list[bytes]] = {}
        for label, text in sample:
            if data := letters(text):
                texts.setdefault(label, []).append(data)
        #: In the order of preference for ties.
        self.names = sorted(texts, key=lambda k: (-rows.get(k, 0), k))
        self.contents = []
        for name in self.names:
            self.contents.append(b" ".join(_pieces(texts[name], LANG_DICT)))
        self.compressors: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def sizes(self, text: str) -> list[int]:
        if self.compressors is None:
            params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False)
            self.compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for c in self.contents]
        own = blocks(letters(text), LANG_BLOCK)
        return [sum([len(c.compress(b)) for b in own]) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.names or not has_letter(text):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        at = min(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[at]
        score = 1 / sum(math.exp(min(0.0, (best - s) * 0.25)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != at), default=2 * best + 1)
        return self.names[at], score, second == best or second - best < NARROW * best


def fit_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fitted on rows for which `learn` holds and whose language isn't null."""
    labels = docs.where(learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    rows = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # a row for each language
    return LanguageModel(sample_by_class(docs, labels, LANG_PER_CLASS, id_col, text_col), rows)


def language_of(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """id, lang_pred, score and rejected; `docs` has the two columns identifier and text."""
    return _scores(docs, model.predict, "lang_pred string, score double, rejected boolean", (pa.string(), pa.float64(), pa.bool_()))


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose language is rejected; columns and rows are otherwise as they were."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield batch.filter(pa.array([not model.predict(t)[2] for t in batch[text_col].to_pylist()], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(kept, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit_language(docs, ~held)
    found = language_of(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def _scores(docs: DataFrame, score, schema: str, kinds: tuple) -> DataFrame:
    """id (the first column) and what `score` gives for text (the second); the text isn't sent back."""
    id_col, text_col = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [score(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names)

    bounded_batches(docs.sparkSession)
    names = [id_col, *(p.split()[0] for p in schema.split(", "))]
    return docs.mapInArrow(scored, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, {schema}")


# Quality


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str]) -> zstandard.ZstdCompressionDict:
    parts = [b for t in texts for b in blocks(t.encode("utf-8", "replace"), QUALITY_BLOCK)]
    try:
        return zstandard.train_dictionary(QUALITY_DICT, parts, level=3)
    except zstandard.ZstdError:  # too few texts to train on: their plain content
        return zstandard.ZstdCompressionDict(b"".join(parts)[-QUALITY_DICT:] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class QualityModel:
    """Every second text of a class goes into its dictionary, the others into the calibration."""

    def __init__(self, sample: list[tuple[int, str]]):
        good, bad = ([t for k, t in sample if k == label] for label in (1, 0))
        self.dictionaries = [_dictionary(good[::2]).as_bytes(), _dictionary(bad[::2]).as_bytes()] if good and bad else []
        self.compressors: list[zstandard.ZstdCompressor] | None = None
        if self.dictionaries:
            rest = [(1, t) for t in good[1::2]] + [(0, t) for t in bad[1::2]]
            x = np.array([self.features(t) for _, t in rest] or [(0.0, 0.0, 0.0)])
            y = np.array([float(k) for k, _ in rest] or [1.0])
            self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
            self.weights = _logistic((x - self.shift) / self.scale, y, 0.3)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Difference of the sizes for each byte, the smaller size for each byte, and the former as evidence (it grows with the text, to a bound)."""
        if self.compressors is None:
            self.compressors = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in self.dictionaries]
        parts = blocks((text or "").encode("utf-8", "replace"), QUALITY_BLOCK)
        good, bad = (sum([len(c.compress(b)) for b in parts]) - 9 * len(parts) for c in self.compressors)
        n = sum(map(len, parts)) + 32  # a few bytes say little
        return (bad - good) / n, min(1.0, (max(0, min(good, bad)) + 32) / n), math.tanh((bad - good) / 16)

    def score(self, text: str | None) -> float:
        if not self.dictionaries:
            return 0.5
        z = float((np.array(self.features(text)) - self.shift) / self.scale @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """`labels`: id, label (1 good, 0 bad); only rows to learn from."""
    return QualityModel([(int(k), t) for k, t in sample_by_class(docs, labels, QUALITY_PER_CLASS, id_col, text_col)])


def quality_of(docs: DataFrame, model: QualityModel) -> DataFrame:
    """id and score; `docs` has the two columns identifier and text."""
    return _scores(docs, lambda t: (model.score(t),), "score double", (pa.float64(),))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    found = quality_of(docs.select("doc_id", "text"), fit_quality(docs, labels))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
