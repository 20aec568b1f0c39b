"""Streams with epochs in the rows, against the same log in one piece."""

import random

import pytest
from test_match import random_log
from test_streaming import changes_of

from graphloom.operators.match import track
from graphloom.operators.versioned import FOREVER
from graphloom.plans.pattern import Motif
from graphloom.streaming.epochs import ROWS, EpochStream

TRIANGLE = Motif.clique(3)
LOG = "src long, dst long, t int, w int"


def wanted(spark, log):
    return changes_of(track(TRIANGLE, spark.createDataFrame(log, LOG)))


def batch(spark, rows):
    """(src, dst, t, w, sender) and marks (t, sender)."""
    return spark.createDataFrame([r if len(r) == 5 else (None, None, r[0], 0, r[1]) for r in rows], ROWS)


def dealt(log, epochs, seed):
    """The rows of a log in one batch an epoch, each up to two batches early and in any order."""
    rnd = random.Random(seed)
    out = [[] for _ in range(epochs)]
    for r in log:
        out[max(0, r[2] - rnd.randrange(3))].append((*r, ""))
    for rows in out:
        rnd.shuffle(rows)
    return out


@pytest.mark.parametrize("span", [1])
def test_epochs_out_of_order(spark, tmp_path, span):
    """Several epochs complete in one micro-batch, micro-batches that complete none, replays, and a stream made anew in between."""
    log = random_log(2, 6, 120, 6)
    batches = dealt(log, 6, 1)
    path = str(tmp_path / "s")
    stream = EpochStream(spark, TRIANGLE, path, span=span, buckets=2, keep_versions=5)
    marks = {0: [], 1: [(2, "")], 2: [], 3: [(1, ""), (4, "")], 4: [], 5: [(FOREVER, "")]}
    for b, rows in enumerate(batches):
        if b == 3:
            stream = EpochStream(spark, TRIANGLE, path, span=span, buckets=2, keep_versions=5)
        stream.process(batch(spark, [*rows, *marks[b]]), b)
        if b in (3, 4):  # again, as after a failure
            stream.process(batch(spark, [*rows, *marks[b]]), b)
        if b == 3:
            assert stream.frontier() == 4 and stream.complete(3) and not stream.complete(4)
            assert changes_of(stream.changes()) == [r for r in wanted(spark, log) if r[-1] < 4]
    assert changes_of(stream.changes()) == wanted(spark, log) != []


def test_an_epoch_is_open_until_all_senders_have_left_it(spark, tmp_path):
    stream = EpochStream(spark, TRIANGLE, str(tmp_path / "s"), senders=("a", "b"), buckets=2)
    triangle = [(1, 2, 1, 1, "a"), (1, 3, 1, 1, "b"), (2, 3, 1, 1, "a")]
    stream.process(batch(spark, [triangle[0], triangle[2], (5, "a")]), 0)
    assert not stream.complete(1) and changes_of(stream.changes()) == []
    stream.process(batch(spark, [triangle[1], (2, "b"), (9, "nobody")]), 1)
    assert stream.frontier() == 2 and changes_of(stream.changes()) == [(1, 2, 3, 1, 1)]
    with pytest.raises(ValueError, match="senders"):
        stream.session("c")


@pytest.mark.parametrize("late", ["next", "error"])
def test_late_rows(spark, tmp_path, late):
    stream = EpochStream(spark, TRIANGLE, str(tmp_path / "s"), late=late, buckets=2)
    stream.process(batch(spark, [(1, 2, 1, 1, ""), (1, 3, 1, 1, ""), (3, "")]), 0)
    rows = batch(spark, [(2, 3, 1, 1, ""), (FOREVER, "")])
    if late == "error":
        with pytest.raises(Exception, match="too late"):
            stream.process(rows, 1)
    else:
        stream.process(rows, 1)
        assert changes_of(stream.changes()) == [(1, 2, 3, 1, 3)]
    with pytest.raises(ValueError, match="late"):
        EpochStream(spark, TRIANGLE, str(tmp_path / "t"), late="drop")


def test_watermark(spark, tmp_path):
    """With a lateness of 2, what came two epochs late at most is told as if it had come in time."""
    log = random_log(4, 6, 70, 5)
    stream = EpochStream(spark, TRIANGLE, str(tmp_path / "s"), lateness=2, buckets=2)
    rnd = random.Random(5)
    batches = [[] for _ in range(7)]
    for r in log:
        batches[r[2] + rnd.randrange(3)].append((*r, ""))
    for b, rows in enumerate(batches[:5]):
        stream.process(batch(spark, rows), b)
        done = stream.frontier()
        assert changes_of(stream.changes()) == [r for r in wanted(spark, [x for x in log if x[2] < done]) if r[-1] < done]
    assert stream.frontier() == 2


def test_pending_parts_go_when_nothing_can_need_them(spark, tmp_path):
    stream = EpochStream(spark, TRIANGLE, str(tmp_path / "s"), span=1, buckets=2, keep_versions=1)
    for b in range(5):
        stream.process(batch(spark, [(b, b + 1, b, 1, ""), (b, b + 1, 50, -1, ""), (b + 1, "")]), b)
    left = {(b, p) for b in stream._numbers("pending", "b") for p in stream._numbers(f"pending/b={b}", "part")}
    assert {x for x in left if x[1] == 50} == {(b, 50) for b in range(5)}
    assert max(len({b for b, p in left if p == k}) for k in range(5)) <= 1 and (0, 0) not in left
    stream.process(batch(spark, [(FOREVER, "")]), 5)
    assert stream.edges().count() == 0


def test_sessions(spark, tmp_path):
    """Rows sent through sessions by two senders, through Structured Streaming."""
    log = random_log(9, 6, 80, 4)
    stream = EpochStream(spark, TRIANGLE, str(tmp_path / "s"), senders=("a", "b"), buckets=2)
    sessions = [stream.session("a"), stream.session("b")]
    for t in range(4):
        for k, session in enumerate(sessions):
            session.send([(a, b, w) for a, b, at, w in log if at == t and a % 2 == k], t)
        if t == 1:
            for session in sessions:
                session.advance_to(2)
            query = stream.start()
            query.processAllAvailable()
            query.stop()
            assert stream.frontier() == 2
    with pytest.raises(ValueError, match="over"):
        sessions[0].send([(1, 2, 1)], 1)
    for session in sessions:
        session.close()
    query = stream.start()
    query.processAllAvailable()
    query.stop()
    assert changes_of(stream.changes()) == wanted(spark, log)
