"""The query catalogue over the graph of consecutive clicks, with equivalent SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import part_name, total
from graphloom.operators import cliques as C
from graphloom.operators.counting import count_matches
from graphloom.operators.graph import Graph
from graphloom.operators.join import Extender, Index, extend, nominate
from graphloom.operators.match import epoch_counts, match, raw_changes, running_total, track, track_cliques_by_triangles
from graphloom.operators.parts import track_in_parts
from graphloom.operators.shares import match_by_shares
from graphloom.operators.stored import StoredEdges
from graphloom.operators.versioned import VersionedEdges, consolidate, effective_changes
from graphloom.plans.pattern import EDGES, Motif
from graphloom.sources.edges import edge_parts, edge_text, following, in_order, node_batches, percent_of_lines, percent_split, preload_and_batches, read_csr, read_csr_blocks, shuffled_batches, transitions, update_batches, write_csr, write_csr_blocks
from graphloom.storage import fresh_path, materialize
from graphloom.streaming.epochs import EpochStream
from graphloom.streaming.runner import MotifStream

FIRST_EPOCH, EPOCHS = 5, 10
#: Epochs of the log with repeated inserts and deletes of absent edges.
REPEATED_EPOCHS = 7


def click_graph(spark: SparkSession, sf_dir: str, only: str | None = "click") -> Graph:
    """From each event's user to the next event's user; `only`: events of one type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if only:
        events = events.where(F.col("event_type") == only)
    events = events.select("user_id", "ts", "event_id")
    graph = Graph.of(transitions(events, "user_id", ["ts", "event_id"]))
    return Graph(materialize(graph.edges, "click-graph"))  # every join of a query reads it


def edge_log(spark: SparkSession, sf_dir: str, kind: str = "click", folded: bool = False) -> DataFrame:
    """(src, dst, t, w): each transition between events of one type enters at its tenth of these events; some leave two epochs later.

    `folded` takes users by their remainder, for fewer nodes and a denser graph: with n events n ** 0.625 nodes or so, among which large cliques neither vanish nor explode as n grows.
    """
    clicks = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    n = clicks.count()
    if folded:
        clicks = clicks.withColumn("user_id", F.col("user_id") % max(1, math.ceil((n / 1.85) ** 0.625)))
    placed = in_order(clicks, ["ts", "event_id"])
    pairs = following(placed.select(F.struct("user_id", F.col("place").alias("rn")).alias("key"), F.col("place").alias("at"), F.col("part").alias("bucket")))
    first = pairs.select(F.col("src.user_id").alias("src"), F.col("dst.user_id").alias("dst"), F.col("src.rn").alias("rn")).where("src <> dst").groupBy("src", "dst").agg(F.min("rn").alias("rn"))
    entered = first.select("src", "dst", F.floor((F.col("rn") - 1) * EPOCHS / max(n, 1)).cast("int").alias("t"), F.lit(1).alias("w"))
    left = entered.where(((F.col("src") * 31 + F.col("dst")) % 7 == 0) & (F.col("t") + 2 <= EPOCHS - 1)).select("src", "dst", (F.col("t") + 2).alias("t"), F.lit(-1).alias("w"))
    return entered.unionByName(left)


def repeated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, t, w): every transition between users of two consecutive events of any type enters in its day's epoch, whether it is there or not, and some leave, whether they are there or not."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    placed = events.select(F.struct("user_id", "event_type", "ts").alias("event"), "ts", "event_id")
    pairs = transitions(placed, "event", ["ts", "event_id"])
    t = F.pmod(F.dayofmonth("src.ts"), F.lit(REPEATED_EPOCHS)).cast("int")
    rows = pairs.select((F.col("src.user_id") % 60).alias("src"), (F.col("dst.user_id") % 60).alias("dst"), t.alias("t"), F.when(F.col("src.event_type") == "click", -1).otherwise(1).alias("w"))
    return rows.where("src <> dst")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


TRIANGLE, CYCLE3, K4, K5, K6 = Motif.clique(3), Motif.cycle(3), Motif.clique(4), Motif.clique(5), Motif.clique(6)
PATH3, SYMMETRIC = Motif.of((0, 1), (1, 2)), Motif.of((0, 1), (1, 0), (1, 2))
PATH4, LOLLIPOP = Motif.of((0, 1), (1, 2), (2, 3), (3, 4)), Motif.of((0, 1), (0, 2), (1, 2), (2, 3), (3, 4))
SYMMETRIC3, SYMMETRIC4 = (Motif(tuple((a, b) for a in range(k) for b in range(k) if a != b)) for k in (3, 4))
#: Queries about the graph of clicks: an edge of the relation `asked`, closed by two edges of `edges`.
TWO_RELATIONS = Motif.of((0, 1, "asked"), (0, 2), (1, 2))
#: What the second relation of the catalogue holds, and how the edges of a stream of queries are dealt: so many hundredths are there at the outset, the others come in so many epochs.
ASKED, HELD_PERCENT, QUERY_EPOCHS = "view", 60, 6


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g, log = click_graph, edge_log

    def folded(spark: SparkSession, d: str) -> DataFrame:
        return materialize(edge_log(spark, d, folded=True), "log")

    def mutual(spark: SparkSession, d: str) -> DataFrame:
        """The folded log, a third of its edges both ways."""
        rows = folded(spark, d)
        return rows.unionByName(rows.where((F.col("src") + F.col("dst")) % 3 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t", "w"))

    def motif(m: Motif, strategy: str = "generic") -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: match(m, g(spark, d).edges, strategy=strategy)

    def delta(m: Motif) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: track(m, log(spark, d), FIRST_EPOCH)

    def preload_stream(spark: SparkSession, d: str) -> DataFrame:
        """95 % of the nodes' edges at epoch 0, the others in epochs of 10 nodes."""
        held, rest = percent_split(g(spark, d).edges, 95)
        log = held.select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w")).unionByName(node_batches(rest, 10))
        return epoch_counts(track(TRIANGLE, log, 1))

    def fans(spark: SparkSession, d: str) -> DataFrame:
        graph = g(spark, d)
        return C.count_fans(C.triangles(graph), C.cliques(graph, 4))

    def separate_load(spark: SparkSession, d: str) -> DataFrame:
        """Triangles with the two directions of the index built from tables of their own."""
        edges = g(spark, d).edges
        reverse = Index.reverse(edges)
        rows = extend(edges.toDF("x1", "x2"), [Extender("x1", reverse), Extender("x2", reverse)], "x0")
        return rows.select("x0", "x1", "x2")

    def static_build(spark: SparkSession, d: str) -> DataFrame:
        """Triangles over given bindings of the first edge (here all edges) in an index that never changes."""
        edges = g(spark, d).edges
        return match(TRIANGLE, edges, seeds=edges)

    def routed(spark: SparkSession, d: str) -> DataFrame:
        """Triangles whose joins are dealt by a route of their own (neighbouring nodes together), and keys of more than 20 prefixes to several tasks."""
        edges = g(spark, d).edges
        near = Index.forward(edges)
        sides = [Extender(x, near, route=lambda key: F.floor(key / 8), spread=20) for x in ("x0", "x1")]
        return extend(edges.toDF("x0", "x1"), sides, "x2")

    def nominated(spark: SparkSession, d: str) -> DataFrame:
        edges = g(spark, d).edges
        return nominate(edges, [Extender("src", Index.forward(edges)), Extender("dst", Index.forward(edges))]).select("src", "dst", "cnt", "who")

    def semijoin(spark: SparkSession, d: str) -> DataFrame:
        edges = g(spark, d).edges
        return Extender("dst", Index.forward(edges)).intersect(edges, "src")

    def text_scan(spark: SparkSession, d: str) -> DataFrame:
        """The graph written as edge-list text, with a comment, and read again."""
        path = fresh_path(spark, "edge-text")
        lines = g(spark, d).edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
        lines.unionByName(spark.createDataFrame([("# src dst",), ("",)], "value string")).write.text(path)
        return edge_text(spark, path)

    def text_batches(spark: SparkSession, d: str) -> DataFrame:
        """The same text by raw lines: how many edges are preloaded (t = 0) and in each batch of 500 lines."""
        path = fresh_path(spark, "edge-text")
        g(spark, d).edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
        held, rest = preload_and_batches(spark, path, 100, 500)
        return held.select(F.lit(0).alias("t")).unionByName(rest.select("t")).groupBy("t").agg(F.count("*").alias("n"))

    def written(spark: SparkSession, d: str, parts: int = 1) -> str:
        """The graph as edge-list text: a folder of files, or with `parts` files prefix00000, prefix00001, ... by source."""
        path, edges = fresh_path(spark, "edge-text"), g(spark, d).edges
        line = F.concat_ws(" ", "src", "dst").alias("value")
        for i in range(parts) if parts > 1 else ():
            edges.where(F.pmod("src", F.lit(parts)) == i).select(line).write.text(part_name(path, i))
        if parts == 1:
            edges.select(line).write.text(path)
        return path

    def part_files(spark: SparkSession, d: str) -> DataFrame:
        return edge_parts(spark, written(spark, d, 3), 3)

    def splits(spark: SparkSession, d: str) -> DataFrame:
        """A graph in three files by number, and a file of updates of its own in epochs of 100 lines: the triangles that the updates add."""
        edges, path, updates = g(spark, d).edges, fresh_path(spark, "edge-parts"), fresh_path(spark, "updates")
        line, asked = F.concat_ws(" ", "src", "dst").alias("value"), (F.col("src") + F.col("dst")) % 5 == 0
        for i in range(3):
            edges.where(~asked & (F.col("src") % 3 == i)).select(line).write.text(part_name(path, i))
        edges.where(asked).select(line).write.text(updates)
        log = edge_parts(spark, path, 3).select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w")).unionByName(update_batches(spark, updates, 100))
        return epoch_counts(track(TRIANGLE, log, 1)).agg(total("net").alias("n"))

    def update_file(spark: SparkSession, d: str) -> DataFrame:
        """All edges from a file of updates of their own, in one epoch each 400 lines, onto no graph: the triangles in the end."""
        log = update_batches(spark, written(spark, d), 400)
        return running_total(epoch_counts(track(TRIANGLE, log))).agg(F.max_by("total", "t").alias("n"))

    def csr(spark: SparkSession, d: str) -> DataFrame:
        """Written as offsets and targets, and read again."""
        with_loops_out = g(spark, d).edges
        path = fresh_path(spark, "csr").removeprefix("file:")
        write_csr(with_loops_out, path)
        return read_csr(spark, path, 40)

    def layout_csr(spark: SparkSession, d: str) -> DataFrame:
        """The layout by degree as a table of CSR blocks, and read again."""
        path = fresh_path(spark, "csr-blocks")
        write_csr_blocks(g(spark, d).layout(), path, 500)
        return read_csr_blocks(spark, path)

    def asof_pruned(spark: SparkSession, d: str) -> DataFrame:
        """The edges as of epoch 7 from a stored index with a snapshot of epoch 5: the log's parts of epochs 6 and 7 alone are read."""
        rows = log(spark, d)
        index = StoredEdges(spark, fresh_path(spark, "stored"), span=1)
        index.append(rows)
        index.snapshot(2)
        index.snapshot(FIRST_EPOCH)
        return index.as_of(7)

    def percent_preload(spark: SparkSession, d: str) -> DataFrame:
        """Triangles with 90 % of an edge list's lines preloaded and the rest in epochs of 20: how many there are after each stage."""
        held, rest = percent_of_lines(spark, written(spark, d), 90, 20)
        log = held.select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w")).unionByName(rest)
        return epoch_counts(track(TRIANGLE, log)).agg(total("net").alias("n"))

    def shuffled(m: Motif, batch: int) -> Callable[[SparkSession, str], DataFrame]:
        """Edges fed in a random order: how many matches there are in the end."""
        return lambda spark, d: epoch_counts(track(m, shuffled_batches(g(spark, d).edges, batch, 7))).agg(total("net").alias("n"))

    def streamed_log(spark: SparkSession, rows: DataFrame, epochs: range, base: DataFrame | None, **options) -> MotifStream:
        """The triangles' changes by Structured Streaming: files of changes dropped epoch by epoch."""
        rows = materialize(rows, "log")
        path = fresh_path(spark, "stream")
        stream = MotifStream(spark, TRIANGLE, path, base, buckets=4, **options)
        for t in epochs:
            rows.where(F.col("t") == t).select("src", "dst", "w").coalesce(1).write.mode("append").parquet(f"{path}/in")
            query = stream.start(spark.readStream.schema("src long, dst long, w int").parquet(f"{path}/in"))
            query.processAllAvailable()
            query.stop()
        return stream

    def streamed(spark: SparkSession, d: str) -> DataFrame:
        rows = materialize(log(spark, d), "log")
        stream = streamed_log(spark, rows, range(FIRST_EPOCH, EPOCHS), VersionedEdges(rows).as_of(FIRST_EPOCH - 1))
        return stream.changes().withColumn("t", (F.col("t") + FIRST_EPOCH).cast("int"))

    def streamed_repeated(spark: SparkSession, d: str) -> DataFrame:
        stream = streamed_log(spark, repeated_log(spark, d), range(REPEATED_EPOCHS), None)
        return stream.changes().select("x0", "x1", "x2", "w", F.col("t").cast("int").alias("t"))

    def streamed_epochs(spark: SparkSession, d: str) -> DataFrame:
        """The same changes with their epochs in the rows, out of order: each file has rows of three epochs from one of two senders, whose marks come later and complete several epochs at once."""
        rows = materialize(log(spark, d), "log")
        stream = EpochStream(spark, TRIANGLE, fresh_path(spark, "epochs"), VersionedEdges(rows).as_of(FIRST_EPOCH - 1), senders=("even", "odd"), buckets=4)
        early = F.greatest(F.lit(0), F.col("t") - FIRST_EPOCH - F.pmod(F.col("dst"), F.lit(3)))  # a row comes up to two files before its epoch is over
        later = materialize(rows.where(F.col("t") >= FIRST_EPOCH).withColumn("file", early.cast("int")), "dealt")
        sessions = {name: stream.session(name) for name in stream.senders}
        for file in range(EPOCHS - FIRST_EPOCH):
            for odd, session in enumerate(sessions.values()):
                for t in range(EPOCHS - 1, FIRST_EPOCH - 1, -1):
                    if t >= FIRST_EPOCH + file and file + 2 >= t - FIRST_EPOCH:
                        session.send(later.where((F.col("t") == t) & (F.col("file") == file) & (F.pmod("src", F.lit(2)) == odd)).select("src", "dst", "w"), t)
                # the odd sender says what it has done only after every other file
                session.advance_to(FIRST_EPOCH + file + 1 if not odd or file % 2 else session.time)
            if file == EPOCHS - FIRST_EPOCH - 1:
                for session in sessions.values():
                    session.close()
            query = stream.start()
            query.processAllAvailable()
            query.stop()
        return stream.changes()

    def two_relations(spark: SparkSession, d: str) -> DataFrame:
        """Triangles whose first edge is in a relation of its own, both relations with logs of their own."""
        return track(TWO_RELATIONS, {EDGES: log(spark, d), "asked": edge_log(spark, d, ASKED)}, FIRST_EPOCH)

    def query_stream(spark: SparkSession, d: str) -> DataFrame:
        """5-cliques over an index of the graph and the queries together, followed for the queries alone: six tenths of the edges are the graph, the others are asked for in six epochs."""
        edges = folded(spark, d).where("w = 1").select("src", "dst")
        spread = (F.col("src") * 7919 + F.col("dst") * 104729) % 100
        held = edges.where(spread < HELD_PERCENT).select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w"))
        asked = edges.where(spread >= HELD_PERCENT).select("src", "dst", (1 + spread % QUERY_EPOCHS).cast("int").alias("t"), F.lit(1).alias("w"))
        return track(K5, held.unionByName(asked), driven_by={EDGES: asked})

    def merged_track(spark: SparkSession, d: str) -> DataFrame:
        return track(TRIANGLE, VersionedEdges(repeated_log(spark, d)).merge_to(3).log, 4)

    return {
        "edge_text_scan": text_scan,
        "edge_text_batches": text_batches,
        "edge_parts": part_files,
        "update_file": update_file,
        "motif_splits": splits,
        "csr_round_trip": csr,
        "layout_csr": layout_csr,
        "percent_of_edges": percent_preload,
        "shuffled_k4": shuffled(K4, 400),
        "shuffled_k5": shuffled(K5, 400),
        "streaming_triangle": streamed,
        "streaming_repeated": streamed_repeated,
        "streaming_epochs": streamed_epochs,
        "q0_triangle": lambda s, d: C.triangles(g(s, d)),
        "q1_four_cycle": lambda s, d: C.four_cycles(g(s, d)),
        "q2_strut": lambda s, d: C.struts(C.triangles(g(s, d))),
        "q2_star": lambda s, d: C.count_struts(C.triangles(g(s, d))),
        "q3_four_clique": lambda s, d: C.cliques(g(s, d), 4),
        "q3_count": lambda s, d: C.count_cliques(g(s, d), 4),
        "q3_seeded": lambda s, d: C.cliques_from_triangles(C.triangles(g(s, d)), 4),
        "q5_fan": fans,
        "q6_hat": lambda s, d: C.hats(g(s, d)),
        "q6_star": lambda s, d: C.count_hats(g(s, d)),
        "q6_alt": lambda s, d: C.count_hats_by_common(g(s, d)),
        "q6_seeded": lambda s, d: C.count_hats(g(s, d), "triangles"),
        "q6_seeded_alt": lambda s, d: C.count_hats(g(s, d), "index"),
        "q7_five_clique": lambda s, d: C.cliques(g(s, d), 5),
        "q7_seeded": lambda s, d: C.cliques_from_triangles(C.triangles(g(s, d)), 5),
        "diamonds": lambda s, d: C.diamonds(g(s, d)),
        "triangles_lean": lambda s, d: C.common_sources(g(s, d).edges),
        "triangles_per_edge": lambda s, d: C.common_targets(g(s, d).edges),
        "triangles_by_vertex": lambda s, d: C.triangles_by_vertex(g(s, d).edges),
        "motif_triangle": motif(TRIANGLE),
        "motif_triangle_array": motif(TRIANGLE, "array"),
        "motif_triangle_native": motif(TRIANGLE, "native"),
        "motif_cycle3": motif(CYCLE3),
        "motif_k4": motif(K4),
        "motif_path3": lambda s, d: _count(match(PATH3, g(s, d).edges)),
        "motif_symmetric": motif(SYMMETRIC),
        "count_motif_path4": lambda s, d: count_matches(PATH4, g(s, d).edges),
        "count_motif_lollipop": lambda s, d: count_matches(LOLLIPOP, g(s, d).edges),
        "shares_triangle": lambda s, d: match_by_shares(TRIANGLE, g(s, d).edges),
        "shares_k4": lambda s, d: match_by_shares(K4, g(s, d).edges),
        "k5_motif": motif(K5),
        "k6_motif": motif(K6),
        "motif_separate_load": separate_load,
        "motif_static_build": static_build,
        "triangles_preload_stream": preload_stream,
        "delta_triangle": delta(TRIANGLE),
        "delta_cycle3": delta(CYCLE3),
        "delta_k4": lambda s, d: track(K4, log(s, d), FIRST_EPOCH, copartition=True),
        "delta_seed_k4": lambda s, d: track_cliques_by_triangles(log(s, d), FIRST_EPOCH),
        "delta_k5": delta(K5),
        "delta_k6": lambda s, d: track_in_parts(K6, folded(s, d), fresh_path(s, "parts"), FIRST_EPOCH),
        "delta_symmetric_triangle": lambda s, d: track(SYMMETRIC3, mutual(s, d)),
        "delta_symmetric_k4": lambda s, d: track(SYMMETRIC4, mutual(s, d)),
        "delta_two_relations": two_relations,
        "query_stream_k5": query_stream,
        "delta_epoch_counts": lambda s, d: epoch_counts(track(TRIANGLE, log(s, d), FIRST_EPOCH)),
        "delta_raw_counts": lambda s, d: raw_changes(TRIANGLE, log(s, d), FIRST_EPOCH).groupBy("t").agg(F.count("*").alias("n_raw"), total("w").alias("net")),
        "delta_running_total": lambda s, d: running_total(epoch_counts(track(TRIANGLE, log(s, d)))),
        "asof_snapshot": lambda s, d: VersionedEdges(log(s, d)).as_of(7),
        "asof_pruned": asof_pruned,
        "asof_before": lambda s, d: VersionedEdges(log(s, d)).as_of(7, strict=True),
        "effective_changes": lambda s, d: effective_changes(log(s, d)).where(F.col("t") >= FIRST_EPOCH),
        "merge_to": lambda s, d: VersionedEdges(log(s, d)).merge_to(6).as_of(EPOCHS),
        "asof_repeated": lambda s, d: VersionedEdges(repeated_log(s, d)).as_of(4),
        "merge_repeated": lambda s, d: VersionedEdges(repeated_log(s, d)).merge_to(3).as_of(5),
        "track_repeated": lambda s, d: track(TRIANGLE, repeated_log(s, d)),
        "track_merged": merged_track,
        "first_change": lambda s, d: VersionedEdges(log(s, d)).first_change_after(6),
        "index_update": lambda s, d: VersionedEdges.initial(g(s, d).edges).update(g(s, d).edges.where("src < 5").withColumn("w", F.lit(-1)), 3).as_of(3),
        "consolidate": lambda s, d: consolidate(log(s, d).select("src", "dst", "w"), keep_positive=True),
        "single_extender_propose": lambda s, d: _count(Extender("dst", Index.forward(g(s, d).edges)).propose(g(s, d).edges, "x")),
        "nominate_min_count": nominated,
        "routed_triangle": routed,
        "intersect_semijoin": semijoin,
        "degrees": lambda s, d: g(s, d).degrees(),
        "non_isolated_sources": lambda s, d: g(s, d).sources(),
        "total_degree": lambda s, d: g(s, d).total_degrees(),
        "smaller_neighbours": lambda s, d: g(s, d).smaller_neighbours(),
        "layout_relabel": lambda s, d: g(s, d).relabelled_by_degree(),
        "layout_edges": lambda s, d: g(s, d).layout(),
        "fragment": lambda s, d: g(s, d).fragment(1, 4),
    }


_G = """g AS (
  SELECT DISTINCT s AS src, d AS dst FROM (SELECT user_id AS s, lead(user_id) OVER (ORDER BY ts, event_id) AS d FROM events WHERE event_type = 'click') WHERE d IS NOT NULL AND s <> d),
f AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM g),
u AS (SELECT s AS a, d AS b FROM f UNION ALL SELECT d, s FROM f),
tri AS (SELECT x.s AS a, x.d AS b, y.d AS c FROM f x JOIN f y ON y.s = x.d JOIN f z ON z.s = x.s AND z.d = y.d),
k4 AS (SELECT p.a, p.b, p.c, q.c AS d FROM tri p JOIN tri q ON p.a = q.a AND p.b = q.b AND p.c < q.c JOIN f ON f.s = p.c AND f.d = q.c),
sup AS (SELECT f.s, f.d, x.b AS v FROM f JOIN u x ON x.a = f.s JOIN u y ON y.a = f.d AND y.b = x.b),
k AS (SELECT s, d, count(*) AS n FROM sup GROUP BY s, d)"""

def _log_sql(kind: str = "click", mark: str = "", user: str = "user_id") -> str:
    """The log of one event type and its snapshots, under names with a mark."""
    return f"""tr{mark} AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS rn, {user} AS src, lead({user}) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = '{kind}'),
ins{mark} AS (SELECT src, dst, CAST((min(rn) - 1) * {EPOCHS} // (SELECT count(*) FROM tr{mark}) AS INT) AS t FROM tr{mark} WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
log{mark} AS (SELECT src, dst, t, 1 AS w FROM ins{mark} UNION ALL SELECT src, dst, t + 2, -1 FROM ins{mark} WHERE (src * 31 + dst) % 7 = 0 AND t + 2 <= {EPOCHS - 1}),
ep{mark} AS (SELECT CAST(range AS INT) AS t FROM range(0, {EPOCHS})),
snap{mark} AS (SELECT ep{mark}.t, src, dst FROM ep{mark} JOIN log{mark} ON log{mark}.t <= ep{mark}.t GROUP BY ep{mark}.t, src, dst HAVING sum(w) > 0)"""


_LOG = _log_sql()
_FOLDED = _log_sql(user="user_id % (SELECT CAST(ceil(pow(count(*) / 1.85, 0.625)) AS BIGINT) FROM events WHERE event_type = 'click')")


_MUTUAL = f"""{_FOLDED},
net AS (SELECT src, dst, t, sum(w) AS w FROM (SELECT * FROM log UNION ALL SELECT dst, src, t, w FROM log WHERE (src + dst) % 3 = 0) GROUP BY 1, 2, 3 HAVING sum(w) <> 0),
twoway AS (SELECT ep.t, src, dst FROM ep JOIN net ON net.t <= ep.t GROUP BY ep.t, src, dst HAVING arg_max(w, net.t) > 0)"""

_REPEATED = f"""tr AS (
  SELECT event_type, ts, user_id % 60 AS src, lead(user_id) OVER (ORDER BY ts, event_id) % 60 AS dst FROM events),
net AS (
  SELECT src, dst, CAST(dayofmonth(ts) % {REPEATED_EPOCHS} AS INT) AS t, sum(CASE WHEN event_type = 'click' THEN -1 ELSE 1 END) AS w
  FROM tr WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2, 3 HAVING w <> 0),
ep AS (SELECT CAST(range AS INT) AS t FROM range(0, {REPEATED_EPOCHS})),
snap AS (SELECT ep.t, src, dst FROM ep JOIN net ON net.t <= ep.t GROUP BY ep.t, src, dst HAVING arg_max(w, net.t) > 0)"""


def _with(body: str, ctes: str = _G) -> str:
    return f"WITH {ctes}\n{body}"


def _matches(motif: Motif, edges: str, cond: str = "") -> str:
    """All matches by plain joins, one alias for each edge of the motif; `edges` is the table of all, or has a place for the relation's name."""
    seen: dict[int, str] = {}
    on: list[str] = []
    for i, pair in enumerate(motif.edges):
        for a, col in zip(pair, ("src", "dst"), strict=True):
            if a in seen:
                on.append(f"{seen[a]} = e{i}.{col}")
            else:
                seen[a] = f"e{i}.{col}"
    tables = ", ".join(f"{edges.format(name='' if name == EDGES else name)} e{i}" for i, name in enumerate(motif.names))
    where = " AND ".join([*on, *([cond] if cond else [])])
    return f"SELECT DISTINCT {', '.join(f'{seen[a]} AS x{a}' for a in sorted(seen))} FROM {tables}" + (f" WHERE {where}" if where else "")


def _delta(motif: Motif, since: int = FIRST_EPOCH, snapshots: str = "snap", epochs: int = EPOCHS) -> str:
    """Differences of the matches in consecutive snapshots."""
    same = " AND ".join(f"e0.t = e{i}.t" for i in range(1, len(motif.edges))) or "TRUE"
    every = _matches(motif, snapshots, same).replace("SELECT DISTINCT", "SELECT DISTINCT e0.t AS t,", 1)
    return f"m AS ({every}),\n{_changes(motif, since, epochs)}"


def _changes(motif: Motif, since: int, epochs: int) -> str:
    """What each epoch adds to the matches of the one before, and removes, from a table m of the matches of all."""
    cols = ", ".join(motif.columns)
    return f"""dm AS (
  SELECT {cols}, t, CAST(1 AS BIGINT) AS w FROM (SELECT t, {cols} FROM m WHERE t >= {since} EXCEPT SELECT t + 1, {cols} FROM m)
  UNION ALL SELECT {cols}, t, CAST(-1 AS BIGINT) AS w FROM (SELECT t + 1 AS t, {cols} FROM m WHERE t + 1 >= {since} AND t + 1 < {epochs} EXCEPT SELECT t, {cols} FROM m))"""


def _clique_steps(k: int) -> str:
    """The k-cliques of all snapshots as m, one node after another: as one join of all edges they take minutes."""
    steps = ["c2 AS (SELECT t, src AS x0, dst AS x1 FROM snap)"]
    for n in range(2, k):
        closed = "".join(f" SEMI JOIN snap e{i} ON e{i}.t = c{n}.t AND e{i}.src = x{i} AND e{i}.dst = e.dst" for i in range(1, n))
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.*, e.dst AS x{n} FROM c{n} JOIN snap e ON e.t = c{n}.t AND e.src = x0{closed})")
    return ",\n".join([*steps, f"m AS (SELECT * FROM c{k})"])


def oracle_sql() -> dict[str, str]:
    hats = "SELECT CAST(coalesce(sum(k.n - 2), 0) AS BIGINT) AS n FROM sup p JOIN sup q ON p.s = q.s AND p.d = q.d AND p.v < q.v JOIN f ON f.s = p.v AND f.d = q.v JOIN k ON k.s = p.s AND k.d = p.d"
    fans = """, w AS (SELECT x.a AS h, x.b AS p, y.b AS q FROM u x JOIN u y ON x.a = y.a JOIN u z ON z.a = x.b AND z.b = y.b)
SELECT count(*) AS n FROM w e1 JOIN w e2 ON e2.h = e1.h AND e2.p = e1.q JOIN w e3 ON e3.h = e1.h AND e3.p = e2.q JOIN w e4 ON e4.h = e1.h AND e4.p = e3.q
WHERE e1.q < e3.q AND e1.p NOT IN (e2.q, e3.q, e4.q) AND e1.q <> e4.q AND e2.q <> e4.q"""
    four = "SELECT a AS v1, b AS v2, c AS v3, d AS v4 FROM k4"
    five = "SELECT p.a AS v1, p.b AS v2, p.c AS v3, p.d AS v4, f.d AS v5 FROM k4 p JOIN f ON f.s = p.d WHERE (p.a, f.d) IN (SELECT (s, d) FROM f) AND (p.b, f.d) IN (SELECT (s, d) FROM f) AND (p.c, f.d) IN (SELECT (s, d) FROM f)"
    deg = "td AS (SELECT x AS node, count(*) AS degree FROM (SELECT src AS x FROM g UNION ALL SELECT dst FROM g) GROUP BY x), rk AS (SELECT node, row_number() OVER (ORDER BY degree, node) - 1 AS rank FROM td)"
    out = {
        "edge_text_scan": "SELECT src, dst FROM g",
        "edge_text_batches": "SELECT CAST(CASE WHEN rn <= 100 THEN 0 ELSE 1 + (rn - 101) // 500 END AS INT) AS t, count(*) AS n FROM (SELECT row_number() OVER () AS rn FROM g) GROUP BY 1",
        "q0_triangle": "SELECT a, b, c FROM tri",
        "q1_four_cycle": "SELECT count(*) AS n FROM f a JOIN f b ON a.s = b.s AND a.d < b.d JOIN u x ON x.a = a.d AND x.b > a.s JOIN u y ON y.a = b.d AND y.b = x.b",
        "q2_strut": "SELECT p.s AS v1, p.d AS v3, p.v AS v2, q.v AS v4 FROM sup p JOIN sup q ON p.s = q.s AND p.d = q.d AND p.v < q.v",
        "q2_star": "SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS n FROM k",
        "q3_four_clique": four,
        "q3_count": "SELECT count(*) AS n FROM k4",
        "q3_seeded": "SELECT x.a AS v1, x.b AS v2, x.c AS v3, y.c AS v4 FROM tri x JOIN tri y ON x.a = y.a AND x.b = y.b JOIN tri z ON z.a = x.a AND z.b = x.c AND z.c = y.c",
        "q5_fan": fans,
        "q6_hat": "SELECT p.s AS v2, p.d AS v5, p.v AS v3, q.v AS v4, o.v AS v1 FROM sup p JOIN sup q ON p.s = q.s AND p.d = q.d AND p.v < q.v JOIN f ON f.s = p.v AND f.d = q.v JOIN sup o ON o.s = p.s AND o.d = p.d AND o.v NOT IN (p.v, q.v)",
        **dict.fromkeys(("q6_star", "q6_alt", "q6_seeded", "q6_seeded_alt"), hats),
        **dict.fromkeys(("q7_five_clique", "q7_seeded"), five),
        "diamonds": "SELECT count(*) AS n FROM g a JOIN g b ON b.src = a.src AND a.dst < b.dst JOIN g c ON c.src = a.dst JOIN g d ON d.src = b.dst AND d.dst = c.dst",
        "triangles_lean": "SELECT p.src AS x, e.src AS y, e.dst AS z FROM g e JOIN g p ON p.dst = e.src JOIN g q ON q.src = p.src AND q.dst = e.dst",
        "triangles_per_edge": "SELECT e.src, e.dst, count(*) AS n FROM g e JOIN g p ON p.src = e.src JOIN g q ON q.src = e.dst AND q.dst = p.dst GROUP BY e.src, e.dst",
        "triangles_by_vertex": "SELECT e.src AS node, count(*) AS n FROM g e JOIN g p ON p.src = e.src JOIN g q ON q.src = e.dst AND q.dst = p.dst GROUP BY e.src",
        **dict.fromkeys(("motif_triangle", "motif_triangle_array", "motif_triangle_native", "motif_separate_load", "motif_static_build"), _matches(TRIANGLE, "g")),
        "motif_cycle3": _matches(CYCLE3, "g"),
        "motif_k4": _matches(K4, "g"),
        "motif_path3": f"SELECT count(*) AS n FROM ({_matches(PATH3, 'g')})",
        "motif_symmetric": _matches(SYMMETRIC, "g"),
        "count_motif_path4": f"SELECT count(*) AS n FROM ({_matches(PATH4, 'g')})",
        "count_motif_lollipop": f"SELECT count(*) AS n FROM ({_matches(LOLLIPOP, 'g')})",
        "shares_triangle": _matches(TRIANGLE, "g"),
        "routed_triangle": _matches(TRIANGLE, "g"),
        "shares_k4": _matches(K4, "g"),
        "k5_motif": _matches(K5, "g"),
        "k6_motif": _matches(K6, "g"),
        **dict.fromkeys(("edge_parts", "csr_round_trip"), "SELECT src, dst FROM g"),
        **dict.fromkeys(("update_file", "percent_of_edges"), f"SELECT count(*) AS n FROM ({_matches(TRIANGLE, 'g')})"),
        "motif_splits": f"SELECT count(*) AS n FROM ({_matches(TRIANGLE, 'g', '0 IN ((e0.src + e0.dst) % 5, (e1.src + e1.dst) % 5, (e2.src + e2.dst) % 5)')})",
        "shuffled_k4": f"SELECT count(*) AS n FROM ({_matches(K4, 'g')})",
        "shuffled_k5": f"SELECT count(*) AS n FROM ({_matches(K5, 'g')})",
        "index_update": "SELECT src, dst FROM g WHERE src >= 5",
        "single_extender_propose": "SELECT count(*) AS n FROM g a JOIN g b ON b.src = a.dst",
        "nominate_min_count": "SELECT g.src, g.dst, least(p.n, q.n) AS cnt, CASE WHEN p.n <= q.n THEN 0 ELSE 1 END AS who FROM g JOIN (SELECT src, count(*) AS n FROM g GROUP BY src) p ON p.src = g.src JOIN (SELECT src, count(*) AS n FROM g GROUP BY src) q ON q.src = g.dst",
        "intersect_semijoin": "SELECT a.src, a.dst FROM g a WHERE EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src)",
        "degrees": "SELECT src AS node, count(*) AS degree FROM g GROUP BY src",
        "non_isolated_sources": "SELECT count(DISTINCT src) AS n FROM g",
        "total_degree": "SELECT x AS node, count(*) AS degree FROM (SELECT src AS x FROM g UNION ALL SELECT dst FROM g) GROUP BY x",
        "smaller_neighbours": "SELECT a AS node, count(*) FILTER (WHERE b < a) AS n FROM u GROUP BY a",
        "fragment": "SELECT src, dst FROM g WHERE src % 4 = 1",
    }
    out = {name: (f"WITH {_G}{sql}" if sql.startswith(", w") else _with(sql)) for name, sql in out.items()}
    out["layout_relabel"] = _with("SELECT node, rank FROM rk", f"{_G}, {deg}")
    out["layout_edges"] = _with("SELECT DISTINCT least(p.rank, q.rank) AS src, greatest(p.rank, q.rank) AS dst FROM g JOIN rk p ON p.node = g.src JOIN rk q ON q.node = g.dst", f"{_G}, {deg}")
    preload = f"""{_G}, lim AS (SELECT (greatest(max(src), max(dst)) + 1) * 95 / 100.0 AS cut FROM g),
e AS (SELECT src, dst, CASE WHEN src < cut THEN 0 ELSE 1 + src // 10 END AS t FROM g, lim)
SELECT CAST(greatest(a.t, b.t, c.t) AS INT) AS t, count(*) AS n_changes, count(*) AS net FROM e a JOIN e b ON b.src = a.src JOIN e c ON c.src = a.dst AND c.dst = b.dst
WHERE greatest(a.t, b.t, c.t) >= 1 GROUP BY 1"""
    out["triangles_preload_stream"] = f"WITH {preload}"
    for name, m in (("delta_triangle", TRIANGLE), ("delta_cycle3", CYCLE3), ("delta_k4", K4), ("delta_k5", K5)):
        out[name] = _with("SELECT * FROM dm", f"{_LOG}, {_delta(m)}")
    out["streaming_triangle"] = out["streaming_epochs"] = out["delta_triangle"]
    out["delta_k6"] = _with("SELECT * FROM dm", f"{_FOLDED}, {_clique_steps(K6.width)}, {_changes(K6, FIRST_EPOCH, EPOCHS)}")
    out["delta_two_relations"] = _with("SELECT * FROM dm", f"{_LOG}, {_log_sql(ASKED, 'asked')}, {_delta(TWO_RELATIONS, snapshots='snap{name}')}")
    dealt = f"""{_FOLDED}, dealt AS (
  SELECT src, dst, CAST(CASE WHEN s < {HELD_PERCENT} THEN 0 ELSE 1 + s % {QUERY_EPOCHS} END AS INT) AS t FROM (SELECT *, (src * 7919 + dst * 104729) % 100 AS s FROM ins))"""
    latest = f"greatest({', '.join(f'e{i}.t' for i in range(len(K5.edges)))})"
    out["query_stream_k5"] = _with(_matches(K5, "dealt", f"{latest} > 0").replace("SELECT DISTINCT", f"SELECT DISTINCT CAST(1 AS BIGINT) AS w, {latest} AS t,", 1), dealt)
    oriented = _LOG.replace("snap AS (SELECT ep.t, src, dst FROM", "snap AS (SELECT ep.t, least(src, dst) AS src, greatest(src, dst) AS dst FROM").replace("GROUP BY ep.t, src, dst HAVING", "GROUP BY ep.t, least(src, dst), greatest(src, dst) HAVING")
    out["delta_seed_k4"] = _with("SELECT * FROM dm", f"{oriented}, {_delta(K4)}")
    tri = f"{_LOG}, {_delta(TRIANGLE)}"
    out["delta_epoch_counts"] = _with("SELECT t, count(*) AS n_changes, CAST(sum(w) AS BIGINT) AS net FROM dm GROUP BY t", tri)
    every = f"{_LOG}, {_delta(TRIANGLE, 0)}"
    out["delta_running_total"] = _with("SELECT t, CAST(sum(sum(w)) OVER (ORDER BY t) AS BIGINT) AS total FROM dm GROUP BY t", every)
    # by the rule itself: each of the three relations in turn, earlier ones as of t, later ones as of t - 1
    out["delta_raw_counts"] = _with(
        """raw AS (
  SELECT c.t, c.w FROM ch c JOIN snap b ON b.t = c.t - 1 AND b.src = c.src JOIN snap d ON d.t = c.t - 1 AND d.src = c.dst AND d.dst = b.dst
  UNION ALL SELECT c.t, c.w FROM ch c JOIN snap a ON a.t = c.t AND a.src = c.src JOIN snap d ON d.t = c.t - 1 AND d.src = a.dst AND d.dst = c.dst
  UNION ALL SELECT c.t, c.w FROM ch c JOIN snap a ON a.t = c.t AND a.dst = c.src JOIN snap b ON b.t = c.t AND b.src = a.src AND b.dst = c.dst)
SELECT t, count(*) AS n_raw, CAST(sum(w) AS BIGINT) AS net FROM raw GROUP BY t""",
        f"""{_LOG},
ch AS (SELECT src, dst, t, 1 AS w FROM (SELECT t, src, dst FROM snap WHERE t >= {FIRST_EPOCH} EXCEPT SELECT t + 1, src, dst FROM snap)
  UNION ALL SELECT src, dst, t, -1 FROM (SELECT t + 1 AS t, src, dst FROM snap WHERE t + 1 >= {FIRST_EPOCH} AND t + 1 < {EPOCHS} EXCEPT SELECT t, src, dst FROM snap)),""",
    )
    out["asof_repeated"] = _with("SELECT src, dst FROM snap WHERE t = 4", _REPEATED)
    out["merge_repeated"] = _with("SELECT src, dst FROM snap WHERE t = 5", _REPEATED)
    for name, since in (("track_repeated", 0), ("streaming_repeated", 0), ("track_merged", 4)):
        out[name] = _with("SELECT * FROM dm", f"{_REPEATED}, {_delta(TRIANGLE, since, epochs=REPEATED_EPOCHS)}")
    for name, m in (("delta_symmetric_triangle", SYMMETRIC3), ("delta_symmetric_k4", SYMMETRIC4)):
        out[name] = _with("SELECT * FROM dm", f"{_MUTUAL}, {_delta(m, 0, 'twoway')}")
    out["first_change"] = _with("SELECT min(t) AS t FROM log WHERE t > 6", _LOG)
    out["asof_snapshot"] = _with("SELECT src, dst FROM snap WHERE t = 7", _LOG)
    out["asof_pruned"] = out["asof_snapshot"]
    out["layout_csr"] = out["layout_edges"]
    out["asof_before"] = _with("SELECT src, dst FROM snap WHERE t = 6", _LOG)
    out["merge_to"] = _with(f"SELECT src, dst FROM snap WHERE t = {EPOCHS - 1}", _LOG)
    out["effective_changes"] = _with(
        f"""SELECT src, dst, t, 1 AS w FROM (SELECT t, src, dst FROM snap WHERE t >= {FIRST_EPOCH} EXCEPT SELECT t + 1, src, dst FROM snap)
UNION ALL SELECT src, dst, t, -1 FROM (SELECT t + 1 AS t, src, dst FROM snap WHERE t + 1 >= {FIRST_EPOCH} AND t + 1 < {EPOCHS} EXCEPT SELECT t, src, dst FROM snap)""",
        _LOG,
    )
    out["consolidate"] = _with("SELECT src, dst, CAST(sum(w) AS BIGINT) AS w FROM log GROUP BY src, dst HAVING sum(w) > 0", _LOG)
    return out
