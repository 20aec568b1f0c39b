"""SentencePiece encoding and decoding for vocabularies of the merge type, with a score-ordered agenda.

A text's characters are symbols, linked to their neighbours. The agenda holds each two adjacent symbols that together are a piece of the vocabulary, the highest score first and of equal scores
the leftmost. The first entry is merged if both its symbols are still as they were; then the pairs that the new symbol makes with its neighbours enter the agenda. What remains are the tokens; a character that
is no piece becomes the pieces of its bytes. The agenda is a heap; that of a chunk of up to `SHORT` symbols is a row of a matrix with the place of each pair in the order of scores, so that in one round all
chunks of a batch take the first entry of their agendas.

A text is normalised as the vocabulary says (a space at the front, spaces as U+2581), then cut where no piece can reach across: before a run of spaces, as no piece holds a space after another character,
around line feeds, tabs and returns, if no longer piece holds them, and before a last sign that no piece holds behind the character before it (all checked when the vocabulary is loaded). Merges on either side of a cut don't affect each other, so a chunk is encoded once and
kept in a bounded cache of two generations: when the newer one is full, it becomes the older, and chunks that occur again move on. The texts of an Arrow batch are cut, numbered by chunk and put together by
Arrow's functions, so that Python sees each chunk of a batch once; texts with runs of spaces are cut one by one. In each Arrow batch the library encodes and decodes every chunk that is new there, and `agrees` says whether all chunks of a text have the same ids and surface both ways. (To run the
library over whole texts again costs as much as all else; the tests do that.)

The vocabulary's path is a parameter; each worker loads it once. Vocabularies of another type, with a character map, user-defined or unused pieces, or without byte pieces are refused.

Defined cases: null and empty texts have no tokens and decode to the empty text; ties, repeated rows and extra columns don't matter, each row is encoded by itself; texts are encoded whole, a long
text without spaces too; strings that look like control or byte pieces are ordinary text, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from graphloom.llm.common import bounded_batches

SPACE = "▁"
#: Rows that are encoded together; chunks of a generation of the cache, and the most characters of a chunk that is kept.
BLOCK_ROWS, CACHE_CHUNKS, CACHE_CHARS = 500, 200_000, 64
#: The most symbols of a chunk whose agenda is a row of a matrix.
SHORT = 24
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2


class AgendaBpe:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kinds = {p.type for p in spec.pieces}
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != BPE or not spec.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a vocabulary of merges with byte pieces and without user-defined or unused ones")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the vocabulary's normalisation isn't supported")
        self.dummy = SPACE if rules.add_dummy_prefix else ""
        self.kinds = [p.type for p in spec.pieces]
        self.pieces = [p.piece for p in spec.pieces]
        self.unknown = spec.trainer_spec.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        #: By piece of several characters: its score, the sign changed, as the agenda takes the least first.
        self.order = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL and len(p.piece) > 1}
        self.bytes = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
        if SPACE not in self.ids or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character, so texts can't be cut before spaces")
        within = {c for p in self.order for c in p}
        #: Two characters that are side by side in some piece; between others, nothing is ever merged.
        self.pairs = {p[i : i + 2] for p in self.order for i in range(len(p) - 1)}
        self.alone = alone = "".join(c for c in "\n\t\r" if c not in within)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + f"|[{alone}]" * bool(alone))
        #: For agendas in a matrix: ids by code point, ids of the longer pieces in the order of scores, and the pairs of pieces that make one.
        ranked = sorted(self.order, key=self.order.__getitem__)
        self.by_place = np.array([self.ids[p] for p in ranked], np.int32)
        place = {p: i for i, p in enumerate(ranked)}
        made = [(self.ids[p[:k]] * len(self.pieces) + self.ids[p[k:]], place[p]) for p in ranked for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        made.sort()
        self.pair_keys, self.pair_places = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = [self.order[p] for p in ranked]
        #: Pieces of equal scores have no order among themselves, so chunks that hold one aren't merged in a matrix.
        self.equal = [p for i, p in enumerate(ranked) if scores[i] in (scores[i - 1 : i] + scores[i + 1 : i + 2])]
        self.numbers, self.surfaces = pa.array([f",{i}" for i in range(len(self.pieces))]), pa.array([p.replace(SPACE, " ") for p in self.pieces])
        self.odd = [p for p in self.equal if p.strip(SPACE)]
        #: What a piece gives: its id as text, after a comma, and its surface.
        self.given = {p: (f",{i}", p.replace(SPACE, " ")) for p, i in self.ids.items()}
        #: The cache, newer and older: a chunk's ids as decimal numbers, each after a comma, what they stand for, and whether the library gives the same (None: not asked).
        self.known: dict[str, tuple[str, str, bool | None]] = {}
        self.older: dict[str, tuple[str, str, bool | None]] = {}

    def short_merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short chunks whose characters are all pieces, one after another, and how many each has. All chunks take one entry of their agendas in a round: the least place, of equal ones the leftmost."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(lengths.max())
        symbols = np.full((len(chunks), width + 1), -1, np.int32)
        symbols[np.arange(width + 1) < lengths[:, None]] = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        agenda = self._places(symbols[:, :-1], symbols[:, 1:])
        done, counts = np.full((len(chunks), width), -1, np.int32), np.zeros(len(chunks), np.int64)
        row = np.arange(len(chunks))
        while len(row):
            at = agenda.argmin(axis=1)
            best = agenda[np.arange(len(row)), at]
            live = best < len(self.by_place)
            if not live.all():
                ended = ~live
                done[row[ended], : symbols.shape[1] - 1] = symbols[ended, :-1]
                row, symbols, agenda, at, best = row[live], symbols[live], agenda[live], at[live], best[live]
                if not len(row):
                    break
            n, columns = np.arange(len(row)), np.arange(symbols.shape[1])
            # the right symbol goes, and with it the pair; what is behind moves up
            moved = np.minimum(columns + (columns > at[:, None]), symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, moved, 1)
            symbols[n, at] = self.by_place[best]
            moved = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), agenda.shape[1] - 1)
            agenda = np.take_along_axis(agenda, moved, 1)
            agenda[:, -1] = len(self.by_place)
            symbols[:, -1] = -1
            agenda[n, at] = self._places(symbols[n, at], symbols[n, np.minimum(at + 1, symbols.shape[1] - 1)])
            left = np.flatnonzero(at)
            agenda[left, at[left] - 1] = self._places(symbols[left, at[left] - 1], symbols[left, at[left]])
        counts = (done >= 0).sum(axis=1)
        return done[done >= 0], counts

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the order of scores of what two symbols make together; behind all if that is no piece, or one of them is none."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_places[at], len(self.by_place)).astype(np.int32)

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk, by an agenda that is a heap."""
        order, symbols = self.order, list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in order:
                agenda.append((order[piece], i, i + 1, piece))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != len(piece):  # one of the two was merged since
                continue
            symbols[i], symbols[j] = piece, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (grown := piece + symbols[k]) in order:
                    heapq.heappush(agenda, (order[grown], i, k, grown))
            if h >= 0 and (grown := symbols[h] + piece) in order:
                heapq.heappush(agenda, (order[grown], h, i, grown))
        return [s for s in symbols if s]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """A chunk's ids as decimal numbers, each after a comma, and what they stand for."""
        numbers, surface = [], []
        for piece in self.merge(chunk):
            own = self.given.get(piece)
            if own is None:
                data = piece.encode("utf-8", "surrogatepass")
                numbers += [f",{self.bytes[b]}" for b in data]
                surface.append(bytes(int(self.pieces[self.bytes[b]][3:-1], 16) for b in data).decode("utf-8", "surrogatepass"))
            else:
                numbers.append(own[0])
                surface.append(own[1])
        return "".join(numbers), "".join(surface)

    def _chunks(self, chunks: list[str]) -> list[tuple[str, str]]:
        """What each chunk gives; short ones by one matrix for each length up to 8, 16 and `SHORT`."""
        out: list[tuple[str, str] | None] = [None] * len(chunks)
        sizes: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if 1 < len(c) <= SHORT and c[:2] != SPACE * 2:
                sizes.setdefault(next(n for n in (8, 12, 16, SHORT) if len(c) <= n), []).append(i)
        for own in sizes.values():
            points = np.frombuffer("".join(chunks[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter((len(chunks[i]) for i in own), np.int64, len(own))
            known = np.logical_and.reduceat(self.of_char[points] >= 0, np.cumsum(lengths) - lengths)
            fit = [i for i, k in zip(own, known.tolist(), strict=True) if k and not any(p in chunks[i] for p in self.odd)]
            if fit:
                ids, counts = self.short_merge([chunks[i] for i in fit])
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                numbers, surfaces = (pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(ids))), "").to_pylist() for names in (self.numbers, self.surfaces))
                for i, own_numbers, surface in zip(fit, numbers, surfaces, strict=True):
                    out[i] = own_numbers, surface
        return [self._chunk(c) if o is None else o for o, c in zip(out, chunks, strict=True)]

    def _asked(self, chunks: list[str], given: list[tuple[str, str]]) -> list[bool]:
        """Whether the library gives the same for each chunk. It puts a space at the front itself; what doesn't begin with one is asked for behind a line feed."""
        behind = "\n" if "\n" in self.alone else ""
        plain = [self.dummy and c[0] == SPACE and len(c) > 1 for c in chunks]
        if not behind and not all(plain):
            raise ValueError("chunks of this vocabulary can't be given to the library by themselves")
        lead = self.library.encode(behind) if behind else []
        texts = [c[1:].replace(SPACE, " ") if p else behind + c.replace(SPACE, " ") for c, p in zip(chunks, plain, strict=True)]
        theirs = self.library.encode(texts, num_threads=1)
        surfaces = self.library.decode(theirs, num_threads=1)
        same = []
        for (numbers, surface), ids, text, p in zip(given, theirs, surfaces, plain, strict=True):
            if p:
                same.append(_text(ids) == numbers[1:] and text == surface[1:])
            else:
                same.append(ids[: len(lead)] == lead and _text(ids[len(lead) :]) == numbers[1:] and text == behind + surface)
        return same

    def _learn(self, chunks: list[str], check: bool) -> dict[str, tuple[str, str, bool | None]]:
        """What new chunks give; put into the cache but for long ones. A sign at the end, where no piece holds it behind the character before, is a chunk by itself, so that a word with and without it is merged once."""
        stems = {c: c[:-1] for c in chunks if len(c) > 2 and not c[-1].isalnum() and c[-2:] not in self.pairs}
        parts = {*chunks, *stems.values(), *(c[-1] for c in stems)}.difference(stems)
        new = [c for c in parts if c not in self.known and c not in self.older]
        given = self._chunks(new)
        verdicts = self._asked(new, given) if check and new else [None] * len(new)
        found = {c: (*g, v) for c, g, v in zip(new, given, verdicts, strict=True)}
        self.known.update((c, f) for c, f in found.items() if len(c) <= CACHE_CHARS)
        for c in sorted(stems, key=len):  # a stem may end with such a sign, too
            (n, s, v), (m, t, w) = (found.get(x) or self.known.get(x) or self.older[x] for x in (stems[c], c[-1]))
            found[c] = n + m, s + t, v and w
            if len(c) <= CACHE_CHARS:
                self.known[c] = found[c]
        return found

    def encode_texts(self, texts: list[str | None], check: bool = False) -> list[tuple[str, str, bool | None]]:
        """Of each text, the ids as decimal numbers joined by commas, the text that they decode to, and with `check` whether the library agrees."""
        split = [self.cut.findall(self.dummy + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, older = self.known, self.older
        missing = list(set().union(*split).difference(known))
        if older:
            known.update((c, older[c]) for c in missing if c in older)
            missing = [c for c in missing if c not in older]
        fresh = self._learn(missing, check)
        out = []
        for chunks in split:
            found = list(map(known.get, chunks))
            if None in found:
                found = [f or fresh[c] for f, c in zip(found, chunks, strict=True)]
            numbers, surface, same = zip(*found, strict=True) if found else ((), (), ())
            out.append(("".join(numbers)[1:], "".join(surface)[len(self.dummy) :], all(same) if check else None))
        return out

    def encode_array(self, texts: pa.Array, check: bool = False) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Of an array of texts, the ids as decimal numbers joined by commas, how many there are, the texts that they decode to, and whether the library agrees.

        A line feed gets a space in front, and texts are cut at spaces: a part is a chunk behind a space, or if it begins with a line feed, one without.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))
        if not (self.dummy and "\n" in self.alone):
            odd = pa.array([True] * len(texts))
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        uses = coded.dictionary.to_pylist()
        chunks = [c if c[:1] == "\n" else SPACE + c for c in uses]
        missing = [c for c in chunks if c not in self.known]
        if self.older:
            self.known.update((c, self.older[c]) for c in missing if c in self.older)
            missing = [c for c in missing if c not in self.older]
        fresh = self._learn(missing, check)
        known = self.known
        found = [known.get(c) or fresh[c] for c in chunks]
        numbers, surface, same = zip(*found, strict=True) if found else ((), (), ())

        def joined(values: tuple[str, ...]) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, pa.array(values, pa.string()).take(coded.indices)), "")

        empty = pc.equal(texts, "")
        ids = pc.if_else(empty, "", pc.utf8_slice_codeunits(joined(numbers), 1))
        decoded = pc.if_else(empty, "", pc.utf8_slice_codeunits(joined(surface), len(self.dummy)))
        agrees = pa.nulls(len(texts), pa.bool_())
        if check:
            bad = np.add.reduceat(np.append(~np.array(same, bool)[coded.indices.to_numpy()], False).astype(np.int64), parts.offsets.to_numpy()[:-1]) if len(texts) else []
            agrees = pc.or_(pa.array(bad == 0 if len(texts) else [], pa.bool_()), empty)
        if pc.any(odd).as_py():
            own = iter(self.encode_texts([t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True) if o], check))
            rows = [next(own) if o else None for o in odd.to_pylist()]
            ids, decoded, agrees = (pa.array([r[k] if r else x for r, x in zip(rows, column.to_pylist(), strict=True)], column.type) for k, column in enumerate((ids, decoded, agrees)))
        n = pc.if_else(pc.equal(ids, ""), 0, pc.add(pc.count_substring(ids, ","), 1))
        return ids, n.cast(pa.int64()), decoded, agrees

    def encode_text(self, text: str | None) -> tuple[str, str]:
        return self.encode_texts([text])[0][:2]

    def trim(self) -> None:
        if len(self.known) > CACHE_CHUNKS:
            self.known, self.older = {}, self.known

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return _numbers(self.encode_text(text)[0])

    def decode(self, ids: list[int]) -> str:
        """Any ids as text: control pieces give nothing, bytes that aren't UTF-8 one replacement character each, and one space at the front goes."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                at += size
            run.clear()

        front = bool(self.dummy)
        taken = False
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][3:-1], 16))
                continue
            flush()
            front = front and not taken and not any(out)
            taken = False
            if kind == UNKNOWN:
                out.append(self.unknown)
            elif kind != CONTROL:
                piece = self.pieces[i]
                if front and piece.startswith(SPACE):
                    piece, taken = piece[1:], True
                out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


_loaded: dict[str, AgendaBpe] = {}


def loaded(path: str) -> AgendaBpe:
    if path not in _loaded:
        _loaded[path] = AgendaBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, check: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256; with `check` agrees (the library gives the same), and with `with_ids` token_ids and decoded. `path` is the vocabulary's place on every worker."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                bpe.trim()
                ids, n, decoded, agrees = bpe.encode_array(batch["text"], check)
                columns = {"id": batch["id"], "n_tokens": n, "ids_sha256": pa.array(map(sha, ids.to_pylist())), "decoded_sha256": pa.array(map(sha, decoded.to_pylist()))}
                if check:
                    columns["agrees"] = agrees
                if with_ids:
                    columns |= {"token_ids": pa.array(map(_numbers, ids.to_pylist()), pa.list_(pa.int32())), "decoded": decoded.cast(pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        bpe.forget()  # workers live on, with other tasks to do

    schema = f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", agrees boolean" * check + ", token_ids array<int>, decoded string" * with_ids
    return source.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def _numbers(ids: str) -> list[int]:
    return list(map(int, ids.split(","))) if ids else []


def _text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), with_ids=False)
