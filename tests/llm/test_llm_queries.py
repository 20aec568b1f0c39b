"""The registered queries on small tables: schemas, held-out accuracy, and SQL."""

import collections
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from graphloom.llm import common, compression, order_minhash, toxicity
from graphloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, DATA)
    got = df.toPandas()
    table, key = ("conversations", "conv_id") if name.startswith("op5") else ("documents", "doc_id")
    ids = {r[0] for r in db.sql(f"select distinct {key} from {table}").fetchall()} | ({-1} if name.startswith("op5") else set())
    assert set(got[key]) == ids and len(got) == len(ids)
    if name in oracle_sql():
        want = db.sql(oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(tuple(r[c] for c in columns) for r in queries()[name](spark, DATA).collect()) == sorted(want.select(*columns).fetchall())


def test_held_out_accuracy(spark):
    big = DATA.replace("0.001", "0.01")
    lang = duckdb.sql(f"select doc_id, lang from '{big}/documents.parquet'").df()
    got = queries()["op6_language_id"](spark, big).toPandas().merge(lang, on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    labels = duckdb.sql(f"select * from '{big}/labels.parquet'").df()
    quality = queries()["op1_quality"](spark, big).toPandas().merge(labels, on="doc_id")
    assert (quality[quality.held_out].predicted == quality[quality.held_out].quality).mean() > 0.94
    toxic = queries()["op8_toxicity"](spark, big).toPandas().merge(labels, on="doc_id", suffixes=("", "_label"))
    assert (toxic[toxic.held_out].toxic == toxic[toxic.held_out].toxic_label).mean() > 0.9


def documents(spark, columns):
    return spark.read.parquet(f"{DATA}/documents.parquet").select(*columns).collect()


def held(key, n, rest):
    return zlib.crc32(str(key).encode()) % n == rest


def test_language_against_plain_compression(spark):
    """The model's dictionaries, compressed with one by one; the texts of documents that are held out aren't in them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = compression.fit_language(docs, F.coalesce(compression.crc_mod("doc_id", 4) != 2, F.lit(False)))
    got = {r["doc_id"]: r for r in queries()["op6_language_id"](spark, DATA).collect()}
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False)
    for r in documents(spark, ["doc_id", "text"]):
        text, row = r["text"] or "", got[r["doc_id"]]
        assert row["held_out"] == held(r["doc_id"], 4, 2)
        words = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip()
        if not any(map(str.isalpha, text)):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        sizes = {}
        for name, content in zip(model.names, model.contents, strict=True):
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[name] = sum(len(tool.compress(words[i : i + 1024])) for i in range(0, len(words), 1024))
        best, second = sorted(sizes.values())[:2]
        assert sizes[row["lang_pred"]] == best and row["rejected"] == (second == best or second - best < 0.005 * best)
        assert row["score"] == pytest.approx(1 / sum(math.exp((best - s) / 4) for s in sizes.values()))


def test_quality_against_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(compression.crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = compression.fit_quality(docs, labels)
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in model.dictionaries]
    got = {r["doc_id"]: r for r in queries()["op1_quality"](spark, DATA).collect()}
    for r in documents(spark, ["doc_id", "text"]):
        data, row = (r["text"] or "").encode(), got[r["doc_id"]]
        good, bad = (sum(len(t.compress(data[i : i + 2048])) - 9 for i in range(0, len(data), 2048)) for t in tools)
        x = [(bad - good) / (len(data) + 32), min(1.0, (max(0, min(good, bad)) + 32) / (len(data) + 32)), math.tanh((bad - good) / 16)]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.shift, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert row["predicted"] == int(row["score"] >= 0.3) and row["held_out"] == held(r["doc_id"], 5, 0)


def test_severity_against_plain_regression(spark):
    """Scores by the formula; and the weights are where the penalised likelihood has its maximum: no step improves it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(compression.crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in queries()["op8_toxicity"](spark, DATA).collect()}
    for r in documents(spark, ["doc_id", "text"]):
        counts = {}
        for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()):
            for f in {w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)}:
                counts[f] = counts.get(f, 0) + 1
        z = sum(math.log1p(n) * model.weights[model.index[f]] for f, n in counts.items() if f in model.index)
        over = [1 / (1 + math.exp(-max(-30.0, min(30.0, z - t)))) for t in model.thresholds]
        row = got[r["doc_id"]]
        assert row["severity"] == pytest.approx(sum(over)) and row["p_toxic"] == pytest.approx(over[0])
        each = [a - b for a, b in zip([1.0, *over], [*over, 0.0], strict=True)]
        assert each[row["grade"]] == pytest.approx(max(each))
    assert set(model.grades) <= set(range(toxicity.GRADES))


def test_ordinal_fit_against_another_optimiser():
    rnd = np.random.default_rng(2)
    rows = [{j: float(v) for j, v in enumerate(x) if v} for x in rnd.integers(0, 3, (300, 4))]
    z = np.array([2 * r.get(0, 0) - r.get(1, 0) for r in rows]) + rnd.logistic(size=300)
    grades = (z[:, None] > [0.0, 1.5, 3.0]).sum(1)
    model = toxicity.OrdinalModel([])
    model.index = {str(j): j for j in range(4)}
    model._fit(rows, grades, steps=3000)

    def loss(w, theta):
        x = np.array([[r.get(j, 0.0) for j in range(4)] for r in rows])
        p = 1 / (1 + np.exp(-(x @ w)[:, None] + theta))
        above = grades[:, None] > np.arange(3)
        return -(np.log(np.where(above, p, 1 - p)).sum(1).mean()) + 1e-5 * (w @ w)

    best, step = (model.weights.copy(), model.thresholds.copy()), 0.5
    own = loss(*best)
    while step > 1e-4:  # coordinate search, without gradients
        for part in best:
            for j in range(len(part)):
                for d in (step, -step):
                    before = loss(*best)
                    part[j] += d
                    if loss(*best) >= before:
                        part[j] -= d
        step /= 2
    assert own - loss(*best) < 1e-3 and list(model.thresholds) == sorted(model.thresholds)


def test_repeated_labels(spark, tmp_path):
    """Identifiers that repeat, contradict each other or are null in the labels do no harm."""
    docs = spark.createDataFrame([(i, f"{'good words here' if i % 2 else 'BAD!!! ###'} {i} " * 9) for i in range(40)] + [(None, "x"), (3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(1, 0), (None, 1), (2, None), (99, 1)], "id long, label int")
    for fit, score in ((compression.fit_quality, compression.quality_of), (toxicity.fit_toxicity, toxicity.severity_of)):
        assert score(docs, fit(docs, labels)).count() == 42


def test_pipeline_agrees_with_plain_stages(spark):
    """What each stage keeps of the whole documents that the one before it kept, computed plainly."""
    import corpus_pipeline
    import test_ops as plain
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    model = compression.fit_language(docs, F.coalesce(compression.crc_mod("doc_id", 4) != 2, F.lit(False)))
    rows = [r.asDict() for r in docs.collect()]
    kept = {r["doc_id"]: r for r in rows if not model.predict(r["text"])[2]}
    assert 0.9 * len(rows) < len(kept) < len(rows)

    groups = {}
    for i, r in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), i))
    kept = {i: kept[i] for _, i in (min(g) for g in groups.values())}

    ids = sorted(kept)
    hashes = [order_minhash.word_hashes(kept[i]["text"])[0] for i in ids]
    bags = [collections.Counter(h.tolist()) for h in hashes]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if plain.bag_allows(bags[a], bags[b]) and order_minhash.similarity(hashes[a], hashes[b])]
    firsts = {}
    for i, root in zip(ids, plain.classes_of(links, len(ids)), strict=True):
        firsts.setdefault(root, i)
    kept = {i: kept[i] for i in firsts.values()}

    def tokens(text):
        return re.findall(r"[a-z]+|[0-9]+", text.lower())

    passages = [" ".join(tokens(t)) for t in items]
    held = {i for i, r in kept.items() if any(p and p in " ".join(tokens(r["text"] or "")) for p in passages)}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    before = docs
    for name in ("language_id", "exact_dedup", "near_dedup", "decontamination"):
        before = common.materialize(stages[name](spark, before, DATA), f"test-{name}")
        assert before.columns == docs.columns
        if name == "near_dedup":
            assert {r["doc_id"] for r in before.collect()} == set(kept)
    clean = {r["doc_id"]: r.asDict() for r in before.collect()}
    assert set(clean) <= set(kept) - held and len(kept) - len(clean) <= 1.2 * len(held) + 2
    assert all(clean[i] == kept[i] for i in clean)

    library = Tokenizer.from_file(corpus_pipeline.bpe.vocabulary())
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(out) == set(clean)
    for i, r in out.items():
        assert r["token_ids"] == library.encode(clean[i]["text"] or "", add_special_tokens=False).ids
