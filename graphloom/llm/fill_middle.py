"""Fill-in-middle transformation over run-length classes.

A text's tokens are its maximal runs of ASCII letters and each other code point by itself. Tokens are never listed. A block of texts lies in one array of code points; what is stored of it are the maximal
runs of one class (letters or others) with the cumulative number of units before each: a run of letters is one unit, a run of others as many as it has code points. The run that holds a
cut is found by binary search over the cumulative units, and the cut's place in the text is the run's start, plus the units into it if it isn't a run of letters.

A text is cut twice, at places that hashes of its identifier give, into prefix, middle and suffix, which are written with markers as prefix, suffix, middle (`psm`) or suffix, prefix, middle (`spm`). Texts
that are empty or hold a marker, and a share of the others, stay as they are (`plain`). As no part holds a marker, and none can arise where parts meet, `restored` reads the text back from the output and
its form alone.

Defined cases: null texts count as empty; a null identifier is hashed as no digits; rows are transformed each by itself, so ties, repeated rows and extra columns don't matter; texts are cut whole, whatever
their length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many are transformed; of a hundred of those, so many in the form spm.
TRANSFORMED, SPM = 90, 20
#: Code points whose runs are found together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20


class Runs:
    """The class runs of several texts, one after another."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = points | 32
        letter = (lower >= 97) & (lower <= 122)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        first = np.zeros(len(points) + 1, bool)
        first[1:-1] = letter[1:] != letter[:-1]
        first[self.begins] = True  # a run ends with its text
        first = first[: len(points)]
        self.starts = np.flatnonzero(first)
        self.letters = letter[self.starts]
        sizes = np.diff(np.append(self.starts, len(points)))
        #: Units before each run, and in the end those of all.
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, sizes))])
        self.starts = np.append(self.starts, len(points))
        self.letters = np.append(self.letters, False)
        at = np.searchsorted(self.starts, np.append(self.begins, len(points)))
        #: Units before each text, and how many it has.
        self.base = self.before[at[:-1]]
        self.units = self.before[np.searchsorted(self.starts, self.ends)] - self.base

    def places(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before a cut after so many units, for each text."""
        units = self.base + cuts
        run = np.searchsorted(self.before, units, "right") - 1
        into = np.where(self.letters[run], 0, units - self.before[run])
        return np.minimum(self.starts[run] + into, self.ends) - self.begins


def _hashes(key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(keys: list[str], texts: list[str]) -> list[tuple[int, str, int | None, int | None, str]]:
    """(units, form, code points of the prefix, of the middle, output) of each text."""
    runs = Runs(texts)
    units = runs.units.tolist()
    hashes = [_hashes(k) for k in keys]
    cuts = np.array([(h[0] % (n + 1), h[1] % (n + 1)) for h, n in zip(hashes, units, strict=True)], np.int64).reshape(-1, 2)
    low, high = runs.places(cuts.min(axis=1)).tolist(), runs.places(cuts.max(axis=1)).tolist()
    out = []
    for h, n, text, i, j in zip(hashes, units, texts, low, high, strict=True):
        if not text or h[2] % 100 >= TRANSFORMED or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            out.append((n, "plain", None, None, text))
        elif h[3] % 100 < SPM:
            out.append((n, "spm", i, j - i, f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"))
        else:
            out.append((n, "psm", i, j - i, f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"))
    return out


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(one):
        raise ValueError(f"not an output of the form {form}")
    a, rest = output[len(one) :].split(two, 1)
    b, middle = rest.split(MIDDLE, 1)
    return b + middle + a if form == "spm" else a + middle + b


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of at most BLOCK_CHARS code points, or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > BLOCK_CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if texts:
        yield slice(begin, len(texts))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n (tokens), form, prefix_chars, middle_chars, output_sha256, restored_sha256 (of the text read back from the output), and with `with_text` output itself."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch["key"].to_pylist(), batch["text"].to_pylist()
            for block in _blocks(texts):
                n, form, prefix, middle, output = zip(*transform(keys[block], texts[block]), strict=True)
                back = [_sha(restored(o, f)) for o, f in zip(output, form, strict=True)]
                columns = [batch["id"].slice(block.start, block.stop - block.start), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([_sha(o) for o in output]), pa.array(back)]
                names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                if with_text:
                    columns.append(pa.array(output, pa.string()))
                    names.append("output")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {dict(source.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_text
    return source.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tok,
  CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b FROM h),
p AS (SELECT doc_id, t, n, h3, h4, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid, array_to_string(tok[b + 1:], '') AS suf FROM c),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256 FROM f"""
