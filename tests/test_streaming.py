import random

import brute
import pytest

from graphloom.operators.match import track
from graphloom.plans.pattern import Motif
from graphloom.streaming.runner import MotifStream

SCHEMA = "src long, dst long, w int"


def changes_of(frame):
    return sorted(tuple(r) for r in frame.select(*sorted(c for c in frame.columns if c[0] == "x"), "w", "t").collect())


def test_stream_agrees_with_batch_and_replays(spark, tmp_path):
    motif = Motif.clique(3)
    base = brute.random_edges(1, 6, 10)
    # inserts of present edges, deletes of absent ones, and both at once
    batches = [[(s, d, 1) for s, d in brute.random_edges(2, 6, 8)], [(s, d, -1) for s, d in sorted(base)[:4]] + [(0, 1, 1), (0, 1, -1), (5, 4, -3)]]
    edges = spark.createDataFrame(sorted(base), "src long, dst long")
    stream = MotifStream(spark, motif, str(tmp_path / "m"), edges, keep_versions=5)
    source = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "100").parquet(str(source)))
        query.processAllAvailable()
        query.stop()
    log = [(s, d, -1, 1) for s, d in base] + [(s, d, t, w) for t, rows in enumerate(batches) for s, d, w in rows]
    want = changes_of(track(motif, spark.createDataFrame(log, "src long, dst long, t int, w int"), 0))
    assert changes_of(stream.changes()) == want
    stream.process(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert changes_of(stream.changes()) == want
    assert {r["t"] for r in stream.counts().collect()} <= {0, 1}


@pytest.mark.parametrize(("motif", "share"), [(Motif.clique(4), 0.25), (Motif.of((0, 1), (1, 2), (2, 3)), 100.0)], ids=["K4", "path"])
def test_many_batches(spark, tmp_path, motif, share):
    """Random inserts and deletes, with a base that is merged again and again or never, and a stream object that is made anew in between."""
    rnd = random.Random(motif.width)
    batches = [[(a, b, rnd.choice([1, 1, -1])) for a, b in ((rnd.randrange(7), rnd.randrange(7)) for _ in range(12))] for _ in range(5)]
    path = str(tmp_path / "m")
    stream = MotifStream(spark, motif, path, merge_share=share, buckets=3)
    for t, rows in enumerate(batches):
        if t == 3:
            stream = MotifStream(spark, motif, path, merge_share=share, buckets=3)
        stream.process(spark.createDataFrame(rows, SCHEMA), t)
    log = [(a, b, t, w) for t, rows in enumerate(batches) for a, b, w in rows if a != b]
    assert changes_of(stream.changes()) == changes_of(track(motif, spark.createDataFrame(log, "src long, dst long, t int, w int")))
    assert {tuple(r) for r in stream.edges().collect()} == brute.snapshots(log, [4])[4]
    assert (len(stream._numbers("base", "v")) > 1) == (share < 1)


def test_a_batch_reads_the_buckets_that_it_needs(spark, tmp_path):
    edges = spark.range(4000).selectExpr("id AS src", "id + 1 AS dst")
    stream = MotifStream(spark, Motif.clique(3), str(tmp_path / "m"), edges, buckets=40)
    nodes = spark.createDataFrame([(17,)], "node long")
    nodes.write.parquet(str(tmp_path / "nodes"))
    near = stream._around(spark.read.parquet(str(tmp_path / "nodes")), -1, stream._tail(-1, 0))
    assert {tuple(r) for r in near.collect()} == {(16, 17), (17, 18)}
    files, todo = [], [near._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numFiles") and node.metrics().contains("numPartitions"):
            files.append(node.metrics().apply("numPartitions").value())
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert files == [1, 1]


def versions(stream):
    """The version of each bucket, each way, that holds rows or was merged."""
    state = stream._state(max(stream._manifests()))
    return {(way, int(b)): v for way, held in state["base"].items() for b, (v, _, _) in held.items()}


def test_a_change_at_one_node_rewrites_one_bucket_each_way(spark, tmp_path):
    edges = spark.range(400).selectExpr("id AS src", "id + 1 AS dst")
    stream = MotifStream(spark, Motif.clique(3), str(tmp_path / "m"), edges, merge_share=0.5, buckets=8, keep_versions=1)
    before = versions(stream)
    assert len(before) == 16 and set(before.values()) == {-1}
    # many edges between two nodes' buckets alone: one grows from its sources, the other from its targets
    stream.process(spark.createDataFrame([(17, 17 + 1000 * k, 1) for k in range(1, 3)], SCHEMA), 0)
    assert versions(stream) == before  # not enough yet
    stream.process(spark.createDataFrame([(17, 10**6 + k, 1) for k in range(60)], SCHEMA), 1)
    moved = {b for b, v in versions(stream).items() if v != before[b]}
    assert len([b for b in moved if b[0] == "forward"]) == 1 and len(moved) == 1  # the targets are spread over all buckets, none of which has grown by half
    stream.process(spark.createDataFrame([(2 * 10**6 + k, 23, 1) for k in range(60)], SCHEMA), 2)
    after = versions(stream)
    assert len({b for b, v in after.items() if v == 2}) == 1 and {b[0] for b, v in after.items() if v == 2} == {"reverse"}
    assert stream.edges().count() == 400 + 2 + 60 + 60
    nodes = spark.createDataFrame([(17,), (23,)], "node long")
    near = stream._around(nodes, 2, stream._tail(2, 3))
    assert near.count() == 2 + 2 + 62 + 60
    # what the merged bucket replaced is gone once no replay can need it
    stream.process(spark.createDataFrame([(1, 5, 1)], SCHEMA), 3)
    stream.process(spark.createDataFrame([(1, 6, 1)], SCHEMA), 4)
    bucket = next(b for b in moved)[1]
    assert not (tmp_path / "m" / "base" / "v=-1" / "way=forward" / f"bucket={bucket}").exists()
    assert stream._manifests() == [3, 4]


def test_buckets_double_as_the_base_grows_and_the_tail_is_folded(spark, tmp_path):
    rnd = random.Random(4)
    motif = Motif.cycle(3)
    stream = MotifStream(spark, motif, str(tmp_path / "m"), merge_share=0.3, buckets=2, bucket_rows=5, fold=2, keep_versions=2)
    log = []
    for t in range(6):
        rows = [(a, b, rnd.choice([1, 1, 1, -1])) for a, b in ((rnd.randrange(7), rnd.randrange(7)) for _ in range(12)) if a != b]
        log += [(a, b, t, w) for a, b, w in rows]
        stream.process(spark.createDataFrame(rows, SCHEMA), t)
        if t == 4:  # a replay starts from the state before it, whatever was merged or folded since
            stream.process(spark.createDataFrame(rows, SCHEMA), t)
        assert {tuple(r) for r in stream.edges().collect()} == brute.snapshots(log, [t])[t]
    state = stream._state(5)
    assert state["buckets"] > 2 and len(state["tail"]) <= 3
    assert changes_of(stream.changes()) == changes_of(track(motif, spark.createDataFrame(log, "src long, dst long, t int, w int")))
