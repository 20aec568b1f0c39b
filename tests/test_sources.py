import pytest

from graphloom.sources import edges as E


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_text(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("# a comment\n1 2\n\n3\t4  extra fields\n  5   6\n#7 8\n")
    assert rows(E.edge_text(spark, str(path))) == [(1, 2), (3, 4), (5, 6)]
    held, rest = E.preload_and_batches(spark, str(path), 4, 1)
    assert rows(held) == [(1, 2), (3, 4)]
    assert rows(rest) == [(5, 6, 1, 1)]
    assert rows(E.update_batches(spark, str(path), 3)) == [(1, 2, 1, 1), (3, 4, 2, 1), (5, 6, 2, 1)]


def test_malformed_lines_are_errors(spark, tmp_path):
    for i, text in enumerate(("1 x\n", "1\n", "-1 2\n")):
        path = tmp_path / f"bad{i}.txt"
        path.write_text(text)
        with pytest.raises(Exception, match="not an edge"):
            E.edge_text(spark, str(path)).collect()


def test_parts(spark, tmp_path):
    for i in range(3):
        (tmp_path / E.part_name("p", i)).write_text(f"{i} {i + 1}\n")
    assert rows(E.edge_parts(spark, str(tmp_path / "p"), 2)) == [(0, 1), (1, 2)]


def test_csr_round_trip(spark, tmp_path):
    edges = [(0, 3), (0, 1), (2, 0), (5, 4)]
    E.write_csr(spark.createDataFrame(edges, "src long, dst long"), str(tmp_path / "g"))
    for size in (1, 2, 100):
        assert rows(E.read_csr(spark, str(tmp_path / "g"), size)) == sorted(edges)
    E.write_csr(spark.createDataFrame([], "src long, dst long"), str(tmp_path / "none"))
    assert rows(E.read_csr(spark, str(tmp_path / "none"))) == []


def test_feeding(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    assert {r["t"] for r in E.node_batches(edges, 10).collect()} == {1, 2}
    held, rest = E.percent_split(edges, 50)
    assert (held.count(), rest.count()) == (11, 9)
    dealt = E.shuffled_batches(edges, 5, 1)
    assert dealt.count() == 20
    assert rows(dealt) == rows(E.shuffled_batches(edges, 5, 1)) != rows(E.shuffled_batches(edges, 5, 2))


def test_transitions_cross_buckets_and_keep_nulls_apart(spark):
    from pyspark.sql import functions as F

    events = spark.createDataFrame([(1, 0, 7), (2, 1, None), (3, 10, 8), (4, 11, 9), (5, 35, 7)], "event_id int, ts int, user_id int")
    pairs = E.transitions(events, "user_id", ["ts", "event_id"], F.floor(F.col("ts") / 10))
    assert sorted(map(tuple, pairs.collect()), key=str) == [(7, None), (8, 9), (9, 7), (None, 8)] or rows(pairs.where("src is not null")) == [(8, 9), (9, 7)]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.cli import main, parse

    (tmp_path / "g.txt").write_text("0 1\n0 2\n1 2\n1 3\n2 3\n0 3\n")
    assert main(["motif", *"3 0 1 0 2 1 2".split(), str(tmp_path / "g.txt"), "2", "2", "inspect"]) == 4
    assert "epoch 1: 1 changes" in capsys.readouterr().out
    (tmp_path / "p00000").write_text("0 1\n0 2\n")
    assert main(["motif", *"3 0 1 0 2 1 2".split(), str(tmp_path / "p"), "2", "1", "--parts", "1", "--updates", str(tmp_path / "g.txt")]) == 4
    (tmp_path / "p00001").write_text("1 2\n1 3\n2 3\n0 3\n")
    assert main(["motif", *"3 0 1 0 2 1 2".split(), str(tmp_path / "p"), "2", "2", "--parts", "2"]) == 4  # the lines after PRELOAD are the updates
    assert main(["motif", *"3 0 1 0 2 1 2".split(), str(tmp_path / "p"), "3", "2", "--parts", "2"]) == 3
    with pytest.raises(SystemExit):
        parse(["motif", "1", "0", "2", "f", "1", "1"])


def test_lines_keep_their_numbers(spark, tmp_path):
    """The files are cut differently between the first scan and the last."""
    for i in range(3):
        (tmp_path / f"f{i}").write_text("".join(f"{i} {k}\n" for k in range(5000)))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for key in keys:
            spark.conf.set(key, "4096")
        lines = E.edge_lines(spark, str(tmp_path))
        for key in keys:
            spark.conf.set(key, "1000000")
        assert rows(lines) == [(i * 5000 + k, f"{i} {k}") for i in range(3) for k in range(5000)]
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_percent_of_lines_leaves_the_line_at_the_cut_out(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("# c\n1 2\n2 3\n3 4\n4 5\n")
    held, rest = E.percent_of_lines(spark, str(path), 40, 2)
    assert rows(held) == [(1, 2)] and rows(rest) == [(2, 3, 1, 1), (3, 4, 1, 1), (4, 5, 2, 1)]


def test_intermediate_tables_can_be_forgotten(spark):
    import os

    from graphloom.storage import forget, fresh_path, materialize

    rows_ = materialize(spark.range(3), "some")
    assert rows_.count() == 3
    folder = os.path.dirname(fresh_path(spark, "x"))
    assert os.listdir(folder)
    forget(spark)
    assert not os.path.exists(folder)
