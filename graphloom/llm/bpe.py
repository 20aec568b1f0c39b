"""BPE encoding and decoding with a pair occurrence index.

Merges are applied to all new words of a block at once. The words' symbols lie in one array, linked to their
neighbours; an index maps each pair of symbols to all its positions. A heap holds the ranks that occur. The lowest
rank is taken, all its positions are merged from left to right, and the index gains the pairs that this makes. A merge can only
make pairs of a higher rank (its product is an input of later merges alone; this is checked when a vocabulary is loaded), so taking
ranks in ascending order over the block gives each word what merging it alone would give.

The vocabulary is a tokenizers file of the kind BPE with a word-end suffix, byte-level symbols, and the steps NFC, white space to one
space, lower case. Its path is a parameter; each worker loads it once. The encoding of a white-space-separated chunk is kept in a
bounded cache, as no token spans white space.

Defined cases: null and empty texts have no tokens and decode to the empty text; ties, repeated rows and extra columns don't matter, each row is
encoded by itself; texts are encoded whole; strings of special tokens become those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches

#: Rows that are encoded together, and the number of chunks after which the cache starts anew.
BLOCK_ROWS, CACHE_CHUNKS = 500, 120_000
#: Unicode's white space, as the tokenizers library has it.
WHITE = "\t-\r \x85\xa0  -     　"
_WHITE = regex.compile(f"[{WHITE}]+")
#: Characters that str.split() takes for white space and Unicode does not.
_OTHER_WHITE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", WHITE))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols, vocab, suffix = byte_symbols(), self.vocab, self.suffix
        self.first = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + suffix] for s in symbols])
        #: By rank: left id, right id, id of the merged symbol.
        self.parts: list[tuple[int, int, int]] = []
        born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(left, -1), born.get(right, -1)) >= r or out in born:
                raise ValueError("a merge comes before one that makes its input; ranks can't be applied in ascending order")
            born[out] = r
            self.parts.append((left, right, out))
        keys = np.array([a << 32 | b for a, b, _ in self.parts], np.int64)
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        #: The cache: a chunk's ids as bytes, and its decoded text.
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's ids start (with the end of the last)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = starts[1:] - 1
        sym = self.first[data]
        sym[ends] = self.last[data[ends]]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends], left[starts[:-1]] = -1, -1
        inner = np.flatnonzero(right >= 0)
        ranks = self._ranks(sym[inner], sym[inner + 1])
        inner, ranks = inner[ranks >= 0], ranks[ranks >= 0]
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> its positions, in pieces
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for r, low, high in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
                if r in index:
                    index[r].append(places[low:high])
                else:
                    index[r] = [places[low:high]]
                    heapq.heappush(active, r)

        if len(ranks):
            add(ranks, inner)
        while active:
            r = heapq.heappop(active)
            a, b, out = self.parts[r]
            pieces = index.pop(r)
            i = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
            if a == b:
                i = np.unique(i)
            j = right[i]
            live = (sym[i] == a) & (j >= 0) & (sym[j] == b)  # another merge may have used one of the two
            if not live.all():
                i, j = i[live], j[live]
            if not len(i):
                continue
            if a == b and len(i) > 1:  # of overlapping pairs in a run, every other one, from the left
                begins = np.flatnonzero(np.concatenate([[True], i[1:] != j[:-1]]))
                offset = np.arange(len(i)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(i)]])))
                i, j = i[offset % 2 == 0], j[offset % 2 == 0]
            after = right[j]
            sym[i], sym[j], right[i] = out, -1, after
            follows = after >= 0
            left[after[follows]] = i[follows]
            before = left[i]
            precedes = before >= 0
            firsts, seconds = np.concatenate([before[precedes], i[follows]]), np.concatenate([i[precedes], after[follows]])
            if len(firsts):
                found = self._ranks(sym[firsts], sym[seconds])
                new = found >= 0
                if new.any():
                    add(found[new], firsts[new])
        alive = sym >= 0
        counts = np.concatenate([[0], np.cumsum(alive)])[starts]
        return sym[alive], counts

    def learn(self, chunks: set[str]) -> None:
        """Put the encodings of chunks without white space into the cache, merging all their words together."""
        fresh = chunks.difference(self.ids)
        split = {c: self.words.findall(c) for c in fresh if not c.isalpha()}  # a chunk of letters is one word
        words = list({w for ws in split.values() for w in ws}.union(fresh.difference(split)))
        if words:
            ids, starts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
            data, names, at = ids.astype("<u4").tobytes(), list(map(self.strings.__getitem__, ids.tolist())), starts.tolist()
            known = {w: data[4 * low : 4 * high] for w, low, high in zip(words, at, at[1:], strict=False)}
            texts = {w: " ".join(names[low:high]) for w, low, high in zip(words, at, at[1:], strict=False)}
            for c, ws in split.items():
                self.ids[c], self.text[c] = b"".join([known[w] for w in ws]), " ".join([texts[w] for w in ws])
            for c in fresh.difference(split):
                self.ids[c], self.text[c] = known[c], texts[c]
        else:
            self.ids.update(dict.fromkeys(fresh, b""))
            self.text.update(dict.fromkeys(fresh, ""))

    @staticmethod
    def normalize(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # sigma has no final form here: each character is lowered by itself

    def _chunks(self, text: str) -> list[str]:
        """The text's chunks; special tokens are chunks of their own, marked by a leading space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if k % 2:
                out.append(" " + part)
                continue
            part = self.normalize(part)
            out += [c for c in _WHITE.split(part) if c] if _OTHER_WHITE.search(part) else part.split()
        return out

    def encode_block(self, texts: list[str | None]) -> list[tuple[bytes, str, int]]:
        """(ids as little-endian 32-bit integers, decoded text, number of tokens) of each text."""
        if len(self.ids) > CACHE_CHUNKS:
            self.ids, self.text = {}, {}
        if not self.ids:
            for s, i in self.special.items():
                self.ids[" " + s], self.text[" " + s] = i.to_bytes(4, "little"), s
        split = [self._chunks(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        ids, text = self.ids.__getitem__, self.text.__getitem__
        data = [b"".join(map(ids, cs)) for cs in split]
        return [(d, " ".join(filter(None, map(text, cs))), len(d) // 4) for d, cs in zip(data, split, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        data = self.encode_block([text])[0][0]
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: what the library gives for a file without a decoder."""
        return " ".join(self.strings[i] for i in ids)


_loaded: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and if asked for token_ids and decoded. `path` is the vocabulary's place on every worker."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                yield whole.slice(at, BLOCK_ROWS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in blocks(batches):
            found = bpe.encode_block(batch["text"].to_pylist())
            columns = [batch["id"], pa.array([n for _, _, n in found], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d, _, _ in found]), pa.array([hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for _, s, _ in found])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(n for _, _, n in found), [None, pa.py_buffer(b"".join(d for d, _, _ in found))])
                ends = [0]
                for _, _, n in found:
                    ends.append(ends[-1] + n)
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("token_ids")
            if with_text:
                columns.append(pa.array([s for _, s, _ in found], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.ids, bpe.text = {}, {}  # workers live on, with other tasks to do

    schema = f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded string" * with_text
    return source.mapInArrow(encoded, schema).withColumnRenamed("id", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), with_ids=False, with_text=False)
