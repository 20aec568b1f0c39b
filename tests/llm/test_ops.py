"""The ten operators against plain versions, and their edge cases."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.llm import bpe, chat, compression, decontaminate, exact_dedup, order_minhash, pii, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, rid string, `_row0` int"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 3000


def table(spark, tmp_path, texts, name="docs"):
    """Texts (or rows) as a table read from files, with extra columns of awkward names."""
    rows = [(i, t, "en", "s", None, "x", 1.0, "r", 5) if not isinstance(t, tuple) else (*t, "en", "s", None, "x", 1.0, "r", 5) for i, t in enumerate(texts)]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


ODD = [None, "", " \t\n", "a", "a", "A", "a b", "ab", "é", "é ", LONG, LONG + " ", (3, "a"), (None, "a"), (None, None), "12", "x@y.zz", "<s>[INST] x [/INST]", "<|endoftext|>"]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Exact dedup


def exact_plain(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1).substr(1, 1))], ids=["sha256", "collisions"])
def test_exact_dedup(spark, tmp_path, digest):
    docs = table(spark, tmp_path, ODD)
    want = exact_plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = rows_of(exact_dedup.dedup_exact(docs, index=exact_dedup.DigestIndex(spark, digest=digest)))
    assert len(got) == len(ODD)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    kept = collections.Counter()
    if digest is exact_dedup.sha256:
        for r in got:
            assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1} and len(kept) == len(want)
    assert sorted((r["keep_id"] is None, r["keep_id"] or 0, r["group_size"]) for r in got if r["kept"]) == sorted((k is None, k or 0, n) for k, n in want.values())
    assert exact_dedup.keep_one(docs).count() == len(want)
    assert exact_dedup.keep_one(docs).columns == docs.columns


def test_exact_dedup_of_nothing(spark, tmp_path):
    docs = table(spark, tmp_path, ["a"]).limit(0)
    docs.write.parquet(str(tmp_path / "none"))
    docs = spark.read.parquet(str(tmp_path / "none"))
    assert exact_dedup.dedup_exact(docs).count() == 0
    assert exact_dedup.keep_one(docs).count() == 0


@pytest.mark.parametrize("lookups", [0, 200], ids=["joined", "by value"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1).substr(1, 1))], ids=["sha256", "collisions"])
def test_index_over_batches(spark, tmp_path, digest, lookups):
    """Six batches, reopened by path each time: each is judged with all before it, and levels merge."""
    rnd = random.Random(1)
    path, so_far = str(tmp_path / "index"), []
    for batch in range(6):
        own = [(100 * batch + i, rnd.choice(["a", "b", "c", "a b", " b", "ab ", "d" + str(rnd.randrange(30)), None, ""])) for i in range(12)]
        so_far += own
        docs = table(spark, tmp_path, own, f"batch{batch}")
        index = exact_dedup.DigestIndex(spark, path, digest=digest, texts=True, fanout=3, lookups=lookups)
        got = {r["doc_id"]: r for r in rows_of(exact_dedup.dedup_exact(docs, index=index))}
        want = exact_plain(so_far)
        assert set(got) == {i for i, _ in own}
        for i, t in own:
            keep, n = want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, n, keep == i)
    names = [n.removeprefix(path) for n in index.runs()]
    assert names == ["/level=1/run=5", "/level=1/run=2"] or sorted(names) == ["/level=1/run=2", "/level=1/run=5"]
    with pytest.raises(ValueError, match="second batch"):
        exact_dedup.dedup_exact(docs, index=exact_dedup.DigestIndex(spark, path))


# Near-dedup


def prose(rnd, n):
    return [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rnd.randrange(40)) for _ in range(n)]


def words_of(text):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def plain_similarity(a, b):
    """By a full alignment table, without a band."""
    a, b = words_of(a), words_of(b)
    if not a or not b:
        return float(len(a) == len(b))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(a), len(b))


def bag_allows(a, b):
    """Whether the words of two texts, whatever their order, leave room for a similarity of 0.8."""
    return sum((a & b).values()) >= 0.8 * max(sum(a.values()), sum(b.values())) - 1e-9


def edited(rnd, words, share):
    """Words replaced (mostly), dropped or put in, one by one."""
    out = []
    for w in words:
        if rnd.random() >= share:
            out.append(w)
            continue
        kind = rnd.random()
        out += ["e" + str(rnd.randrange(10**6))] if kind < 0.8 else [w, "i" + str(rnd.randrange(10**6))] if kind < 0.9 else []
    return out


def classes_of(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_similarity_is_the_alignments(spark):
    rnd = random.Random(3)
    linked = 0
    for _ in range(150):
        base = prose(rnd, rnd.randrange(1, 90)) if rnd.random() < 0.7 else [rnd.choice("the of a".split()) for _ in range(40)]  # few words: labels shift
        other = list(base)
        for _ in range(rnd.randrange(0, 12)):
            i = rnd.randrange(len(other) + 1)
            other[i : i + rnd.randrange(2)] = prose(rnd, rnd.randrange(3)) if rnd.random() < 0.5 else ["the"]
        a, b = " ".join(base), " ".join(other)
        want = plain_similarity(a, b)
        x, y = (order_minhash.word_hashes(t)[0] for t in (a, b))
        assert len(x) == len(words_of(a)) and len(set(order_minhash.labelled(x, 2).tolist())) == max(1, len(x) - 1)
        got = order_minhash.similarity(x, y)
        assert (got >= 0.8 - 1e-9) == (want >= 0.8 - 1e-9) and got <= want + 1e-9
        linked += got > 0
    assert 30 < linked < 140


def test_near_classes_agree_with_all_pairs(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", "...", "one two", "One, two!", LONG, LONG + " end"]
    for _ in range(6):
        base = prose(rnd, 120)
        for _ in range(9):  # copies with up to a third of the words edited: some links hold, some don't
            texts.append(" ".join(edited(rnd, base, rnd.choice([0.02, 0.05, 0.08, 0.1, 0.35]))))
    texts += [(7, texts[10]), (None, texts[11]), " ".join(prose(rnd, 300))]
    docs = table(spark, tmp_path, texts)
    got = docs.select("doc_id", "text").join(order_minhash.near_classes(docs).select(F.col("doc_id").alias("i"), "class_id", "class_size", "kept"), F.col("doc_id").eqNullSafe(F.col("i")))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            short = max(len(a), len(b)) < 5000
            if a == b or short and plain_similarity(a, b) >= 0.8 or not short and min(len(a), len(b)) > 5000:
                links.append((i, j))
    groups = collections.defaultdict(list)
    for (doc_id, _), root in zip(rows, classes_of(links, len(rows)), strict=True):
        groups[root].append(doc_id)
    want = {d: (min(x for x in g if x is not None), len(g)) for g in groups.values() for d in g if d is not None and d != 7}
    found = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got.collect() if r["doc_id"] in want}
    assert found == want
    assert order_minhash.keep_one(docs).count() == len(groups)
    assert order_minhash.keep_one(docs).columns == docs.columns


def test_recall_of_edited_copies(spark, tmp_path):
    """At least 90 % of the copies with 2, 5, 8 and 12 % of their words edited are found, and texts that only share a passage or a style are left alone."""
    rnd = random.Random(8)
    passage = prose(rnd, 50)
    texts, want = [], []
    for share in (0.02, 0.05, 0.08, 0.12):
        for _ in range(60):
            base = prose(rnd, rnd.randrange(60, 400))
            want.append((share, len(texts)))
            texts += [" ".join(base), " ".join(edited(rnd, base, share))]
    clean = len(texts)
    texts += [" ".join([*prose(rnd, 60), *passage, *prose(rnd, 60)]) for _ in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in rows_of(order_minhash.near_classes(table(spark, tmp_path, texts)))}
    for share in (0.02, 0.05, 0.08, 0.12):
        found = [got[i] == got[i + 1] for s, i in want if s == share]
        assert sum(found) >= 0.9 * len(found), share
    assert len({got[i] for i in range(clean, len(texts))}) == len(texts) - clean
    assert len(set(got.values())) >= clean // 2 + len(texts) - clean  # no two originals meet


def test_a_large_group_around_one_text(spark, tmp_path):
    """Copies of copies that are each near the original, many of them not near each other; and as many texts that share half of it."""
    rnd = random.Random(12)
    base = prose(rnd, 100)
    near = [" ".join(base)] + [" ".join(edited(rnd, base, 0.13)) for _ in range(300)]
    half = [" ".join([*base[:45], *prose(rnd, 55)]) for _ in range(300)]
    rows = near + half
    bags = [collections.Counter(words_of(t)) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bag_allows(bags[i], bags[j]) and order_minhash.similarity(*(order_minhash.word_hashes(rows[k])[0] for k in (i, j)))]
    want = classes_of(links, len(rows))
    got = {r["doc_id"]: r["class_id"] for r in rows_of(order_minhash.near_classes(table(spark, tmp_path, rows)))}
    found = collections.defaultdict(set)
    for i, w in enumerate(want):
        found[got[i]].add(w)
    assert all(len(w) == 1 for w in found.values())
    assert len(found) - len(set(want)) <= 0.01 * len(rows)  # classes left apart that brute force joins


def test_no_link_within_a_bucket_is_lost(spark, tmp_path, monkeypatch):
    """All texts in one bucket, and in one of two more, in which pairs and chains are similar to each other but to no other text: the classes are those of all pairs."""

    def few_keys(words):
        return np.array([0, 1 + int(words[0]) % 2])

    monkeypatch.setattr(order_minhash, "sketch", few_keys)
    rnd = random.Random(31)
    rows = []
    for i in range(90):
        words = prose(rnd, rnd.choice([45, 60, 300]))
        rows.append(" ".join(words))
        for _ in range(i % 4):
            words = edited(rnd, words, 0.12)
            rows.append(" ".join(words))
    hashes = [order_minhash.word_hashes(t)[0] for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if order_minhash.similarity(hashes[i], hashes[j])]
    want = classes_of(links, len(rows))
    assert len(links) > 100 and len(set(want)) > 80
    docs = table(spark, tmp_path, rows)
    for tile in (order_minhash.TILE, 50):  # in one tile, and in several
        monkeypatch.setattr(order_minhash, "TILE", tile)
        got = {r["doc_id"]: r["class_id"] for r in rows_of(order_minhash.near_classes(docs))}
        assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_near_dedup_leaves_only_what_its_result_reads(spark, tmp_path):
    rnd = random.Random(5)
    texts = [" ".join(prose(rnd, 60)) for _ in range(20)]
    texts += [" ".join(edited(rnd, t.split(), 0.05)) for t in texts[:5]] + texts[:3]
    with storage.recorded() as tables:
        kept = order_minhash.keep_one(table(spark, tmp_path, texts))
    left = [t for t in tables if __import__("os").path.isdir(t.removeprefix("file://").removeprefix("file:"))]
    assert len(tables) > 10 and sorted(t.rsplit("/", 1)[1].split("-")[0] for t in left) == ["dropped", "numbered"]
    assert kept.count() == 20


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test tables")
def test_near_classes_of_the_documents(spark):
    """All pairs of the 0.01 documents by a plain word alignment: no link joins two classes that a brute-force search would call one, but for one in ten at most, and no class is larger."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    hashes = [order_minhash.word_hashes(t)[0] for _, t in rows]
    bags = [collections.Counter(h.tolist()) for h in hashes]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if min(len(hashes[i]), len(hashes[j])) >= 0.8 * max(len(hashes[i]), len(hashes[j])) - 1e-9 and bag_allows(bags[i], bags[j]) and (not len(hashes[i]) or order_minhash._common(hashes[i].tolist(), hashes[j].tolist(), len(hashes[i]) + len(hashes[j])) >= 0.8 * max(len(hashes[i]), len(hashes[j])) - 1e-9)]
    want = classes_of(links, len(rows))
    got = {r["doc_id"]: r["class_id"] for r in rows_of(order_minhash.near_classes(docs))}
    different = [(i, j) for i, j in links if not np.array_equal(hashes[i], hashes[j])]
    assert len(different) > 30
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in different) >= 0.95 * len(different)
    roots = collections.defaultdict(set)
    for (doc_id, _), w in zip(rows, want, strict=True):
        roots[got[doc_id]].add(w)
    assert all(len(w) == 1 for w in roots.values())


def test_near_copies_of_short_texts(spark, tmp_path):
    """One word replaced, more or less in texts of 4 words to the longest with exact candidates; a line that they share links nothing."""
    rnd = random.Random(11)
    line = prose(rnd, 7)
    texts, linked = [], []
    for n in (*[4] * 4, *[5] * 6, *range(6, 32), *[8] * 8, *[14] * 8, *[20] * 8):
        base = prose(rnd, n)
        more = [base[:-1], base[1:], [*base, "end"], ["start", *base], [*base[:2], "new", *base[3:]]][rnd.randrange(5)]
        linked += [plain_similarity(" ".join(base), " ".join(more)) >= 0.8] * 2
        texts += [" ".join(base), " ".join(more)]
    for _ in range(12):
        texts.append(" ".join([*line, *prose(rnd, 8)]))
        linked.append(False)
    assert sum(linked[:20]) > 8 and not all(linked[:20])
    docs = table(spark, tmp_path, texts)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows_of(order_minhash.near_classes(docs))}
    assert got == {i: (i - i % 2, 2) if both else (i, 1) for i, both in enumerate(linked)}


def test_sketches_of_longer_texts_miss_few(spark):
    """The chance that all sketches differ, with single words replaced so far apart that each costs two pairs of words."""
    import math

    def chance(n, share):
        pairs, lost = n - 1, min(n - 1, 2 * math.floor(n * share))
        shared, union = pairs - lost, pairs + lost
        return (1 - math.comb(shared, order_minhash.LENGTH) / math.comb(union, order_minhash.LENGTH)) ** order_minhash.SKETCHES

    lengths = range(order_minhash.SHORT + 1, 500)
    assert max(chance(n, 0.1) for n in lengths) < 0.0001
    assert max(chance(n, 0.15) for n in lengths) < 0.01
    assert max(chance(n, 0.2) for n in lengths) < 0.12


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + rnd.randrange(80), 2000 + rnd.randrange(80)) for _ in range(70)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in rows_of(order_minhash.components(spark.createDataFrame(pairs, "a long, b long")))}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    want = dict(zip(nodes, classes_of([(nodes.index(a), nodes.index(b)) for a, b in pairs if a != b], len(nodes)), strict=True))
    assert set(got) == set(nodes) and len({(got[n], want[n]) for n in nodes}) == len(set(got.values())) == len(set(want.values()))
    assert order_minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_of_nothing(spark, tmp_path):
    table(spark, tmp_path, ["a"]).limit(0).write.parquet(str(tmp_path / "none"))
    assert order_minhash.near_classes(spark.read.parquet(str(tmp_path / "none"))).count() == 0


# BPE


def test_bpe_is_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*ODD[:12], "ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "½²٣ 𝟘 x\x1cy\x1d z\x85q", "'s don't we'LL", "日本語 ﷽ é é", "aaaaaaa aaaa a", "🤖🤖 👩‍👩‍👧", "Ǆ ŉ a b　c"]
    docs = table(spark, tmp_path, texts)
    got = {r["doc_id"]: r for r in rows_of(bpe.encode_documents(docs, path))}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["token_ids"], got[i]["decoded"], got[i]["n_tokens"]) == (ids, text, len(ids))
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    tool = bpe.PairIndexBpe(path)
    assert tool.decode(tool.encode("hello world")) == library.decode(library.encode("hello world", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


# Chat


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "[", "<", "[ROLE ", "] ", "[SYS]", "[/SYS]", "x", "\n", "[\\INST]", "[/ROLE]", "é"]
    roles = ["user", "assistant", "system", "tool", None, ""]
    turns = [(rnd.choice(roles), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))) for _ in range(3000)]
    text = "".join(chat.render(*t)[0] for t in turns)
    reader = chat.Reader()
    assert [t[:2] for i in range(0, len(text), 37) for t in reader.feed(text[i : i + 37])] == turns
    assert chat.render("user", "plain")[1] == 0 and chat.render("user", "a [/INST] b")[1] == 1
    for broken in ("x", "<s>[USER] x", "<s>[ROLE zz"):
        with pytest.raises(ValueError):
            list(chat.Reader().feed(broken))


def test_chat_digests(spark):
    rows = [(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", "[/INST] ok"), (1, 1, "assistant", "[/INST] ok"), (1, None, "system", None), (None, 0, "user", ""), (2, 5, None, LONG), (2, 6, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in rows_of(chat.read_back(chat.format_turns(turns)))}
    ordered = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        ordered[c].append((role or "", text or ""))
    for c, own in ordered.items():
        loss = "".join(x for role, x in own if role == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.format_turns(turns).collect():
        assert chat.unescape(r["segment"][r["loss_start"] : r["loss_end"]]) == ((r["text"] or "") if r["role"] == "assistant" else "")
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_loss_is_read_through_the_mask(spark):
    """A mask that is shifted, empty or on another turn shows in what is read back; columns with the names of the result do no harm."""
    rows = [(1, 0, "user", "a [/INST] b", "x", 9, 0), (1, 1, "assistant", "yes </s> no", "y", 8, 1), (1, 2, "assistant", "", None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss_start int, conv int")
    formatted = chat.format_turns(turns)

    def loss(df):
        r = chat.read_back(df).first()
        return r["loss_chars"], r["loss_sha256"]

    def digest(text):
        return len(text), hashlib.sha256(text.encode()).hexdigest()

    assert loss(formatted) == digest("yes </s> no")
    assert loss(formatted.withColumn("loss_start", F.col("loss_start") + 1).where("turn < 2")) == digest("es </s> no")
    assert loss(formatted.withColumn("loss_start", F.lit(0)).withColumn("loss_end", F.lit(0))) == digest("")
    on_user = formatted.withColumn("loss_start", F.when(F.col("turn") == 0, 10).otherwise(0)).withColumn("loss_end", F.when(F.col("turn") == 0, 11).otherwise(0))
    assert loss(on_user) == digest("a")


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_chat_query_against_plain_python(spark):
    """All conversations, and conversation -1."""
    folder = "/root/testdata/sf0.001"
    own = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        own[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    own[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in rows_of(chat.op5_chat_format(spark, folder))}
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in sorted(turns)).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.render(role, t)[0]) for _, role, t in turns)


# Sharding


def test_sharding(spark, tmp_path):
    docs = table(spark, tmp_path, [*ODD, *[f"text {i}" for i in range(40)]])
    got = rows_of(sharding.hilbert_shards(docs, 7))
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(ODD) + 40 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by_place = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in by_place] == sorted(r["curve"] for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] != 3 and r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] in texts:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0
    few = rows_of(sharding.hilbert_shards(docs.where("doc_id in (0, 1)"), 16))
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]
    sharding.write_shards(docs, str(tmp_path / "out"), 4)  # with identifiers that repeat or are null
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (tuple(r)[:-1] for r in out.collect()))) == sorted(map(str, map(tuple, docs.collect())))
    assert {r["count"] for r in out.groupBy("shard").count().collect()} <= {14, 15}


def test_equal_texts_share_a_shard_and_files_can_be_skipped(spark, tmp_path):
    rnd = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, curve long, digest string, rid long, shard string"
    rows = [(i, f"group {i % 150}" if i < 600 else f"text {i} " * rnd.randrange(1, 40), rnd.choice([None, "de", "en", "fr", "es"]), f"host{rnd.randrange(40):02d}", 1, "x", 2, "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, schema)
    got = rows_of(sharding.hilbert_shards(docs, 16))
    text, meta = {r[0]: r[1] for r in rows}, {r[0]: r for r in rows}
    groups = collections.defaultdict(list)
    for r in got:
        groups[text[r["doc_id"]]].append(r["position"])
    assert all(max(p) - min(p) == len(p) - 1 for p in groups.values())  # each group is a run, so at most one group lies across each cut
    assert sum(len({r["shard"] for r in got if text[r["doc_id"]] == g}) > 1 for g in {f"group {i}" for i in range(150)}) <= 15
    # a reader that wants one language, or one source, skips most of the shards
    for col, most in ((2, 0.6), (3, 0.6)):
        held = collections.defaultdict(set)
        for r in got:
            if r["doc_id"] >= 600:
                held[meta[r["doc_id"]][col]].add(r["shard"])
        assert sum(map(len, held.values())) / len(held) <= most * 16
    out = str(tmp_path / "clash")
    sharding.write_shards(docs, out, 3)
    assert spark.read.parquet(out).count() == 3000 and set(spark.read.parquet(out).columns) == set(docs.columns)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_hilbert_curve_is_one(n, bits):
    import numpy as np

    grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")])
    order = np.argsort(sharding.hilbert_index(grid, bits))
    assert sorted(sharding.hilbert_index(grid, bits).tolist()) == list(range(1 << bits * n))
    assert (np.abs(np.diff(grid[:, order], axis=1)).sum(0) == 1).all()


# Decontamination

ITEMS = [(0, "Alice bought 12 apples for 5 km and gave Bob 12 of the remaining fruit yesterday evening."), (1, "short item only."), (2, None), (3, ""), (3, "what is the name of the river that flows through the old town near here")]


def test_decontamination(spark, tmp_path):
    texts = [
        "noise before. Alice bought 12 apples for 5 km and gave Bob 12 of the remaining fruit yesterday evening. noise",
        "Carol bought 7 apples for 9 kg and gave Dave 7 of the remaining fruit yesterday evening.",  # other values, consistent
        "Carol bought 7 apples for 9 kg and gave Dave 8 of the remaining fruit yesterday evening.",  # 12 stands for 7 and 8
        "WHAT IS THE NAME OF THE RIVER THAT FLOWS THROUGH the old town near here",
        "a short item only.",
        "nothing of the kind at all is in this text about rivers and towns", None, "", LONG, (3, "7 8 9 10 11 12 13 14 15 16"),
    ]
    docs = table(spark, tmp_path, texts)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["n_windows"] and r["doc_id"]: r for r in rows_of(decontaminate.flag_contaminated(docs, items)) if r["contaminated"]}
    assert {k: (r["item_id"], r["reparameterised"]) for k, r in got.items()} == {0: (0, False), 1: (0, True), 3: (3, False), 4: (1, False)}
    clean = decontaminate.keep_clean(docs, items)
    assert clean.count() == len(texts) - 4 and clean.columns == docs.columns
    for empty_docs, some_items in ((docs.limit(0), items), (docs, items.limit(0))):
        assert not any(r["contaminated"] for r in rows_of(decontaminate.flag_contaminated(empty_docs, some_items)))


def test_hits_are_compared_with_the_tokens(spark, tmp_path):
    """A window that only shares a hash with an item's is no hit."""
    docs = table(spark, tmp_path, ["one two three four five six seven eight nine"]).withColumn("rid", F.lit(4).cast("long"))
    words = "two three four five six seven eight nine".split()
    hits = spark.createDataFrame([(4, 1, 8, 9, words), (4, 0, 8, 9, words), (4, 5, 8, 9, words)], "rid long, pos int, width int, hash long, words array<string>")
    assert [tuple(r)[:4] for r in decontaminate._verified(hits, docs, "rid", "text").collect()] == [(4, 1, 8, 9)]


def test_rows_keep_their_numbers(spark, tmp_path):
    """The files are cut differently between the first scan and the last."""
    docs = table(spark, tmp_path, ["same"] * 9 + [f"other {i}" for i in range(9)])
    items = spark.createDataFrame([(0, "same")], "item_id long, text string")
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "64")
        one, clean = exact_dedup.keep_one(docs), decontaminate.keep_clean(docs, items)
        near, flagged = order_minhash.keep_one(docs), decontaminate.flag_contaminated(docs, items)
        spark.conf.set(key, "1")
        assert sorted(r["doc_id"] for r in near.collect()) == [0, *range(9, 18)]
        assert sorted(r["doc_id"] for r in flagged.where("contaminated").collect()) == list(range(9))
        assert sorted(r["doc_id"] for r in one.collect()) == [0, *range(9, 18)]
        assert sorted(r["doc_id"] for r in clean.collect()) == [*range(9, 18)]
    finally:
        spark.conf.unset(key)


def test_decontamination_of_edited_copies(spark, tmp_path):
    long = "That first box held 12 red marbles which the children counted twice before lunch and then again in the late afternoon. That second box held 12 blue ones and nobody counted them at all because it was raining and everyone had gone home to sleep."
    two = "the farmer sold 3 apples in the morning and then 5 apples in the evening to the same old lady"
    texts = [
        long.replace("held 12 blue", "held 13 blue"),  # a copy but for one value
        long.replace("That second", "Another second"),
        two.replace("3", "4").replace("5", "4"),  # two values meet in one
        two.replace("3", "9").replace("5", "8"),
        long.replace("12 red", "17 red").replace("nobody counted", "nobody ever counted").replace("12 blue", "18 blue"),  # verbatim in its plain windows
        "nothing of the kind is in here at all, whatever 12 or That may stand for",
    ]
    docs = table(spark, tmp_path, texts)
    items = spark.createDataFrame([(0, long), (1, two)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["reparameterised"]) for r in rows_of(decontaminate.flag_contaminated(docs, items)) if r["contaminated"]}
    assert got == {0: (0, False), 1: (0, False), 2: (1, True), 3: (1, True), 4: (0, False)}


def test_template_and_values_correspond(spark):
    rnd = random.Random(2)
    pieces = ["Ab", "ab", "12", "3.5", " ", "\n", ",", "km", "É", "éa", "É́", "", "", "İ", "!", "A", "ß"]
    rows = [("".join(rnd.choice(pieces) for _ in range(30)),) for _ in range(400)]
    df = spark.createDataFrame(rows, "text string").select(decontaminate.template(F.col("text")).alias("t"), decontaminate.values(F.col("text")).alias("v"))
    for r in df.collect():
        assert len(r["t"]) == len(r["v"])


# Compression


@pytest.fixture(scope="module")
def languages():
    rnd = random.Random(4)
    words = {"xx": "kola mira tuna sepo lira".split(), "yy": "bruck stamp gleif worst pfand".split()}
    return [(k, " ".join(rnd.choice(v) + rnd.choice(["", "a", "e"]) for _ in range(60))) for k, v in words.items() for _ in range(40)]


def test_language(spark, tmp_path, languages):
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(languages)], "doc_id long, text string, lang string")
    model = compression.fit_language(docs, F.col("doc_id") % 2 == 0)
    odd = [None, "", "123 !!", languages[1][1], languages[-1][1], LONG]
    got = {r["doc_id"]: r for r in rows_of(compression.language_of(table(spark, tmp_path, odd).select("doc_id", "text"), model))}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "xx", "yy"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and [got[i]["rejected"] for i in range(5)] == [True, True, True, False, False]
    kept = compression.keep_known(table(spark, tmp_path, odd, "more"), model)
    assert {r["doc_id"] for r in kept.collect()} >= {3, 4} and kept.where("doc_id < 3").count() == 0
    none = compression.fit_language(docs, F.lit(False))
    assert none.predict("text") == ("und", 0.0, True)
    assert compression.language_of(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_quality_and_toxicity_edges(spark, tmp_path):
    rnd = random.Random(6)
    good = [" ".join(prose(rnd, 80)) + "." for _ in range(60)]
    bad = ["!!! " + " ### ".join(w.upper() for w in prose(rnd, 60)) for _ in range(60)]
    docs = table(spark, tmp_path, [*good, *bad, None, "", LONG])
    labels = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") < 60, 1).when(F.col("doc_id") < 120, 0).alias("label")).where("id % 4 <> 0")
    got = {r["doc_id"]: r["score"] for r in rows_of(compression.quality_of(docs.select("doc_id", "text"), compression.fit_quality(docs, labels)))}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum(got[i] > 0.5 for i in range(0, 60, 4)) >= 14 and sum(got[i] < 0.5 for i in range(60, 120, 4)) >= 14
    assert compression.QualityModel([]).score("x") == 0.5
    assert toxicity.OrdinalModel([]).predict("x")[0] < 1e-6
    model = toxicity.OrdinalModel([(0, t) for t in good] + [(1, t + " nasty" * (1 + i % 5)) for i, t in enumerate(good)])
    severe = [model.predict("calm words " + "nasty " * n)[0] for n in (0, 1, 5)]
    assert severe[0] < 0.5 < severe[1] < severe[2] and list(model.thresholds) == sorted(model.thresholds)
    assert toxicity.severity_of(docs.select("doc_id", "text"), model).count() == 123


# Personal data


def pii_plain(t):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans(spark):
    rnd = random.Random(1)
    for _ in range(4000):
        t = "".join(rnd.choice("a1.@+- ()%9_2 55.x-") for _ in range(60))
        assert pii.base_spans(t) == pii_plain(t)
    assert pii.base_spans("9" * 200_000 + "." + "a" * 200_000) == []


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(2)

    def phone():
        return f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"

    train = []
    for i in range(200):
        p, m, n = phone(), f"u{i}@host.example.org", rnd.randrange(10**8)
        train.append(f"call {p} or see {rnd.randrange(9999)} and mail {m} at 10.0.0.{rnd.randrange(255)}, total {n}. That is {p}, or {m}, for {n:08d} and {n:08d}")
    return pii.SkipChainField(train)


def test_field_adds_repeats(spark, tmp_path, field):
    text = "call +1 (974) 555-3436 now. Again: (974) 555-3436, in 2024, item 12345678"
    base, spans = field.spans(text)
    assert base == pii_plain(text)
    assert [text[s:e] for s, _, e in set(spans) - set(base)] == ["(974) 555-3436"]
    assert field.spans(None) == ([], []) and pii.SkipChainField([]).spans(text)[1] == base
    docs = table(spark, tmp_path, [*ODD, text])
    got = {r["doc_id"]: r for r in rows_of(pii.personal_data(docs.select("doc_id", "text"), field))}
    assert got[len(ODD)]["n_phone"] == 1 and got[len(ODD)]["n_added"] == 1 and got[1]["spans"] == ""
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.fit_field(docs.limit(0)).weights is None
    assert pii.fit_field(docs).weights is not None


def test_field_reaches_any_distance(field):
    """Thirty repeats without the prefix, far apart, with other numbers between them."""
    text = "call +1 (974) 555-3436 now. " + " ".join(f"word {i} and (974) 555-3436 and {7 * i + 1000}," for i in range(30))
    _, spans = field.spans(text)
    assert [text[s:e] for s, _, e in spans] == ["+1 (974) 555-3436", *["(974) 555-3436"] * 30]


def test_field_finds_spelled_signs_and_glued_cards(field):
    _, spans = field.spans("write to jane.doe (at) host.example.org today")
    assert pii.joined(spans) == "email:9:39"
    valid = next(f"4{n:015d}" for n in range(10**14, 10**15) if pii.luhn(f"4{n:015d}"))
    cards = pii.SkipChainField([f"paid with {valid}, no. {i:016d} and {valid}; 1234" for i in range(90)])
    base, spans = cards.spans(f"1111222233334441 {valid} and {valid}")
    assert pii.joined(base) == "card:38:54" and pii.joined(spans) == "card:17:33,card:38:54"


def test_field_gives_exact_marginals_on_chains(field):
    """Without skip links the messages are exact: compared with a sum over all labellings."""
    import itertools

    for text in ("a 12345678 b 2024 c 555 1234 d", "x +1 (974) 555-3436 y 98765 z 10.0.0.1 w 4321 v 777"):
        found = pii.mentions(text, pii.base_spans(text))
        edges = pii.links(text, found)
        assert all(kind == 0 for _, _, kind in edges) and len(found) >= 3
        node = np.array([pii.unary(text, s, e) for s, e, _ in found], float) @ field.weights
        total = np.zeros(node.shape)
        for labels in itertools.product(range(len(pii.LABELS)), repeat=len(found)):
            if all(fixed < 0 or fixed == own for own, (_, _, fixed) in zip(labels, found, strict=True)):
                weight = np.exp(sum(node[i, own] * (found[i][2] < 0) for i, own in enumerate(labels)) + sum(field.pair[0, labels[a], labels[b]] for a, b, _ in edges))
                for i, own in enumerate(labels):
                    total[i, own] += weight
        assert np.abs(field.beliefs(text, found) - total / total.sum(1, keepdims=True)).max() < 1e-3
