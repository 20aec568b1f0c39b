"""Fill-in-middle, the Merkle manifest and SentencePiece against plain versions, and their edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import agenda, fill_middle, merkle

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `_row0` int, `key` string, grp string, path int"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 3000
ODD = [None, "", " \t\n", "a", "a", "A", "a b", "é", "ab1cd..ef\r\n", LONG, "x" * 100_000, ".é" * 20_000, "<P>", "a <S> b", "<M", "ab<\n<P", "▁a ▁", "<s> </s> <0x0A>", "日本 語\x00😀", "\n\n a  b \n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, tmp_path, rows, name="docs"):
    """(doc_id, text, source, n_chars) as a table read from files, with extra columns of awkward names."""
    path = str(tmp_path / name)
    spark.createDataFrame([(i, t, "en", s, n, "x", 5, "k", "g", 1) for i, t, s, n in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd(spark, tmp_path):
    return table(spark, tmp_path, [*((i, t, "s", 1) for i, t in enumerate(ODD)), (3, "a", None, None), (3, "a", None, None), (None, "abc def", "s", 2), (None, None, None, None)])


def nothing(spark, tmp_path):
    return table(spark, tmp_path, [(1, "a", "s", 1)]).where("doc_id > 1")


# Fill-in-middle


def fim_plain(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(tokens), [int(sha(f"1:{key}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chars", [1 << 20, 50])
def test_cuts(monkeypatch, chars):
    monkeypatch.setattr(fill_middle, "BLOCK_CHARS", chars)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abZ \n.é日<PSM>1_") for _ in range(rnd.randrange(40))) for _ in range(2000)] + ["", "a", "é"]
    keys = list(map(str, range(len(texts))))
    got = [row for block in fill_middle._blocks(texts) for row in fill_middle.transform(keys[block], texts[block])]
    assert got == [fim_plain(k, t) for k, t in zip(keys, texts, strict=True)]
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert [fill_middle.restored(r[4], r[1]) for r in got] == texts
    with pytest.raises(ValueError, match="form"):
        fill_middle.restored("abc", "psm")


def test_fill_in_middle(spark, tmp_path):
    docs = odd(spark, tmp_path)
    got = fill_middle.fill_in_middle(docs).collect()
    want = []
    for r in docs.collect():
        n, form, p, m, out = fim_plain("" if r.doc_id is None else r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or ""), out))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fill_middle.fill_in_middle(nothing(spark, tmp_path / "none")).count() == 0


# Merkle manifest


def leaf_plain(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree_plain(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way_plain(levels, i):
    out = []
    for nodes in levels[:-1]:
        low = i // 3 * 3
        out.append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])))
        i //= 3
    return out


def manifest_plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_plain(r)))
    trees = {s: tree_plain([leaf_plain(r) for r in groups[s]]) for s in order}
    top = tree_plain([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            way, seen = way_plain(trees[s], i) + way_plain(top, k), dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                seen["text"] = r["text"].replace("\n", "")
            x = leaf_plain(seen)
            for left, right in way:
                x = sha(left + x + right)
            yield r["doc_id"], leaf_plain(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), x, x == top[-1][0]


def same_manifest(docs):
    got = merkle.manifest(docs, merkle.without_lines("doc_id")).drop("path")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    # rows that are equal are leaves in any order, so their proofs are compared as a whole
    assert sorted(map(tuple, got.collect()), key=str) == sorted(manifest_plain([r.asDict() for r in docs.collect()]), key=str)


@pytest.mark.parametrize("span", [6, 1, 2])
def test_manifest(spark, tmp_path, monkeypatch, span):
    """One group of a third of all rows, groups of 1 to 9 rows, and as many blocks as a small span makes."""
    monkeypatch.setattr(merkle, "SPAN", span)
    rnd = random.Random(span)
    rows = [(i, rnd.choice(["a\nb", "x", None, "line\n\n"]), "hot" if i % 3 == 0 else f"s{rnd.randrange(12)}", i) for i in range(120)] + [(1000, "a", None, 1), (1001, "\n", "", 1), (1002, "\n", "é", None)]
    same_manifest(table(spark, tmp_path, rows))


@pytest.mark.parametrize("n", [1, 3, 4, 9, 10, 27, 28])
def test_manifest_of_one_group(spark, tmp_path, n):
    same_manifest(table(spark, tmp_path, [(i * 7 % 29, f"t\n{i}", "s", i) for i in range(n)]))


def test_manifest_of_odd_rows(spark, tmp_path):
    same_manifest(odd(spark, tmp_path))
    assert merkle.manifest(nothing(spark, tmp_path / "none"), merkle.without_lines("doc_id")).count() == 0
    untouched = merkle.manifest(odd(spark, tmp_path / "again"))
    assert untouched.where("not verified").count() == 0 and untouched.where(F.size("path") > 12).count() == 0


def test_no_task_ranks_a_group(spark, tmp_path):
    """A third of all rows lies in one group; its places come from several partitions, and no window holds more than a block of it."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("grp"))
    got = merkle.ranked(docs, "grp", ["doc_id"], "ranked")
    hot = got.where("grp = 'hot'")
    assert sorted(r.idx for r in hot.collect()) == list(range(1000)) and {r.m for r in hot.select("m").distinct().collect()} == {1000}
    assert [r.doc_id for r in hot.orderBy("idx").limit(5).collect()] == [0, 3, 6, 9, 12]


# SentencePiece


@pytest.fixture(scope="module")
def piece():
    return agenda.loaded(agenda.vocabulary())


def test_agenda_is_the_library(piece):
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choice("ab  \n\t\r▁é日�<0xA>s/\x00​1.😀eēthein") for _ in range(rnd.randrange(30)))
        ids = piece.library.encode(text)
        assert piece.encode(text) == ids
        assert piece.encode_text(text)[1] == piece.decode(ids) == piece.library.decode(ids)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3), 259, 28705]) for _ in range(rnd.randrange(8))]
        assert piece.decode(ids) == piece.library.decode(ids)


def test_agenda_takes_the_best_score_first(piece):
    """With scores of our own: the pair in the middle is worth more than the first, and equal scores go from the left."""
    own = agenda.AgendaBpe(agenda.vocabulary())
    own.order = {"bc": 1.0, "ab": 2.0, "cd": 2.0, "aa": 3.0, "bcd": 4.0}
    assert own.merge("abcd") == ["a", "bcd"]
    assert own.merge("aaaaa") == ["aa", "aa", "a"]
    assert own.merge("abxcd") == ["ab", "x", "cd"]


def test_sentencepiece(spark, tmp_path):
    docs = odd(spark, tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=agenda.vocabulary())
    got = agenda.encode_documents(docs, agenda.vocabulary()).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True, ids, library.decode(ids)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert agenda.encode_documents(nothing(spark, tmp_path / "none"), agenda.vocabulary()).count() == 0


def test_cache_is_bounded(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(agenda, "CACHE_CHUNKS", 10)
    own = agenda.AgendaBpe(agenda.vocabulary())
    for k in range(50):
        own.trim()
        text = f"word{k} other{k} " + "y" * 500
        assert own.encode(text) == piece.library.encode(text)
        assert len(own.known) + len(own.older) <= 40 and all(len(c) <= agenda.CACHE_CHARS for c in own.known)


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(agenda.vocabulary(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        agenda.AgendaBpe(str(path))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_agrees_with_the_library(spark):
    from graphloom.llm.queries import queries

    library = sentencepiece.SentencePieceProcessor(model_file=agenda.vocabulary())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op13_sentencepiece"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)


def test_arrays_of_texts(piece):
    """Texts that Arrow cuts and texts with runs of spaces, side by side; what the library is asked for chunk by chunk agrees with what it gives for whole texts."""
    rnd = random.Random(5)
    own = agenda.AgendaBpe(agenda.vocabulary())
    for _ in range(200):
        texts = [rnd.choice([None, ""]) if rnd.random() < 0.1 else "".join(rnd.choice("abc   \n\t\r▁é日\x00.") for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(1, 9))]
        ids, n, decoded, agrees = (x.to_pylist() for x in own.encode_array(pa.array(texts, pa.string()), True))
        for t, i, k, d, a in zip(texts, ids, n, decoded, agrees, strict=True):
            want = piece.library.encode(t or "")
            assert (i, k, d, a) == (",".join(map(str, want)), len(want), t.replace("▁", " ") if t else "", True)
    assert [len(x) for x in own.encode_array(pa.array([], pa.string()), True)] == [0, 0, 0, 0]


def test_agendas_in_a_matrix(piece):
    """Chunks of all lengths in one matrix, against the heap."""
    rnd = random.Random(7)
    words = [p.strip("▁") for p in piece.ids if 0 < len(p.strip("▁")) < 9]
    for _ in range(60):
        chunks = {rnd.choice(["▁", ""]) + "".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(40)}
        chunks = [c for c in chunks if 1 < len(c) <= agenda.SHORT and all(x in piece.ids for x in c)]
        ids, counts = piece.short_merge(chunks)
        found = [piece.pieces[i] for i in ids]
        assert found == [p for c in chunks for p in piece.merge(c)] and counts.tolist() == [len(piece.merge(c)) for c in chunks]
    assert not piece.odd  # no two longer pieces but runs of spaces share a score


def test_a_wrong_encoding_is_told(piece):
    own = agenda.AgendaBpe(agenda.vocabulary())
    own.order, own.pair_keys = {}, np.array([-1])  # nothing is ever merged
    _, _, _, agrees = own.encode_array(pa.array(["x", "the end", "\n", "  the"]), True)
    assert agrees.to_pylist() == [False, False, True, False]
