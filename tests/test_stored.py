"""CSR in blocks and files that tasks write, and the stored index."""

import random

import brute
import numpy as np
import pytest
from test_match import random_log, rows

from graphloom.operators.stored import StoredEdges
from graphloom.sources import edges as S

PAIRS = "src long, dst long"


def plain_csr(pairs):
    """offsets and targets of a set of edges."""
    n = max(s for s, _ in pairs) + 1
    ordered = sorted(pairs)
    return [sum(s < v for s, _ in ordered) for v in range(n + 1)], [d for _, d in ordered]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_csr_files_are_written_by_tasks(spark, tmp_path, monkeypatch, block):
    """Hubs over several blocks, nodes without edges between and before blocks, more tasks than nodes."""
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", lambda *a, **k: pytest.fail("rows through the driver"))
    pairs = {(2, d) for d in range(9)} | {(7, 1), (7, 2), (8, 2), (30, 4)} | {(12, d) for d in range(5, 9)}
    frame = spark.createDataFrame(sorted(pairs), PAIRS)
    S.write_csr(frame, str(tmp_path / "g"), block)
    offsets, targets = plain_csr(pairs)
    assert np.fromfile(tmp_path / "g.offsets", np.uint64).tolist() == offsets
    assert np.fromfile(tmp_path / "g.targets", np.uint32).tolist() == targets
    assert rows(S.read_csr(spark, str(tmp_path / "g"), 3)) == pairs
    S.write_csr_blocks(frame, str(tmp_path / "b"), block)
    assert rows(S.read_csr_blocks(spark, str(tmp_path / "b"))) == pairs
    assert rows(S.read_csr_blocks(spark, str(tmp_path / "b"), 7, 12)) == {(s, d) for s, d in pairs if 7 <= s <= 12}


def test_csr_of_nothing_and_of_numbers_out_of_range(spark, tmp_path):
    none = spark.createDataFrame([], PAIRS)
    S.write_csr(none, str(tmp_path / "g"))
    assert S.read_csr(spark, str(tmp_path / "g")).count() == 0
    S.write_csr_blocks(none, str(tmp_path / "b"))
    assert S.read_csr_blocks(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(Exception, match="numbers from 0"):
        S.csr_blocks(spark.createDataFrame([(1, -1)], PAIRS)).count()


def test_blocks_dont_bridge_wide_gaps(spark, tmp_path):
    pairs = {(0, 1), (1, 2), (4_000_000_000, 3), (4_000_000_001, 4)}
    S.write_csr_blocks(spark.createDataFrame(sorted(pairs), PAIRS).coalesce(1), str(tmp_path / "b"))
    assert rows(S.read_csr_blocks(spark, str(tmp_path / "b"))) == pairs
    assert max(len(r["counts"]) for r in spark.read.parquet(str(tmp_path / "b")).select("counts").collect()) <= 8


def test_stored_index(spark, tmp_path):
    raw = sorted(random_log(6, 7, 200, 12), key=lambda r: r[2])
    snaps = brute.snapshots(raw, range(-1, 12))
    index = StoredEdges(spark, str(tmp_path / "i"), span=3)
    frame = lambda low, high: spark.createDataFrame([r for r in raw if low <= r[2] < high], f"{PAIRS}, t int, w int")
    index.append(frame(0, 5))
    index.snapshot(4)
    index.append(frame(5, 12))
    index = StoredEdges(spark, str(tmp_path / "i"), span=3)
    index.snapshot(9)
    assert index.snapshots() == [4, 9]
    for t in random.Random(1).sample(range(12), 6):
        assert rows(index.as_of(t)) == snaps[t] and rows(index.as_of(t, strict=True)) == snaps[t - 1]
    with pytest.raises(Exception, match="snapshot"):
        index.append(frame(9, 10))


def test_reads_as_of_an_epoch_take_few_files(spark, tmp_path):
    log = spark.range(4000).selectExpr("id AS src", "id + 1 AS dst", "cast(id % 100 AS int) AS t", "1 AS w")
    index = StoredEdges(spark, str(tmp_path / "i"), span=5)
    index.append(log)
    everything = len(index.as_of(99).inputFiles())
    index.snapshot(89)
    assert everything >= 20 and {f.split("/")[-2] for f in index.as_of(91).inputFiles()} == {"t=89", "part=18"}
    assert {f.split("/")[-2] for f in index.as_of(89).inputFiles()} <= {"t=89", "part=17"} and index.as_of(91).count() == 92 * 40
