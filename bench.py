"""Runs the headline queries and prints one JSON line.

Graphs are written before anything is timed: `all`, consecutive events of any type, and `copurchase`, parts ordered together (some twelve times as many edges at 0.1). Each query runs up to
three times, as long as it has taken less than 5 s, and its median counts.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cliques as C
from graphloom.operators.graph import Graph
from graphloom.operators.match import match, track, track_cliques_by_triangles
from graphloom.plans.pattern import Motif
from graphloom.queries import FIRST_EPOCH, click_graph, edge_log
from graphloom.storage import fresh_path, materialize
from graphloom.streaming.runner import MotifStream

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
RUNS, LONG = 3, 5.0


def copurchase(spark: SparkSession) -> Graph:
    item = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_orderkey", "l_partkey")
    pairs = item.join(item.toDF("l_orderkey", "dst"), "l_orderkey").where("l_partkey < dst")
    return Graph(materialize(Graph.of(pairs, "l_partkey", "dst").edges, "copurchase"))


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    g, parts, log = click_graph(spark, SF_DIR, None), copurchase(spark), materialize(edge_log(spark, SF_DIR), "log")
    triangle, k4 = Motif.clique(3), Motif.clique(4)

    def small_batch(graph: Graph, name: str):
        """A hundred new edges and as many old ones gone, onto a base that is there already."""
        stream = MotifStream(spark, triangle, fresh_path(spark, f"bench-{name}"), graph.edges)
        old = graph.edges.orderBy(F.xxhash64("src", "dst")).limit(100)
        new = old.select(F.col("src"), (F.col("dst") + 1).alias("dst")).where("src <> dst")
        changes = materialize(old.withColumn("w", F.lit(-1)).unionByName(new.withColumn("w", F.lit(1))), "changes")
        runs = iter(range(10_000))
        return lambda: stream.process(changes, next(runs))

    queries = {
        "q0_triangle": lambda: C.triangles(g),
        "q1_four_cycle": lambda: C.four_cycles(g),
        "q2_star": lambda: C.count_struts(C.triangles(g)),
        "q3_four_clique": lambda: C.cliques(g, 4),
        "q3_count": lambda: C.count_cliques(g, 4),
        "q5_fan": lambda: C.count_fans(C.triangles(g), C.cliques(g, 4)),
        "q6_star": lambda: C.count_hats(g),
        "q7_five_clique": lambda: C.cliques(g, 5),
        "diamonds": lambda: C.diamonds(g),
        "triangles_per_edge": lambda: C.common_targets(g.edges),
        "motif_triangle": lambda: match(triangle, g.edges),
        "motif_cycle3": lambda: match(Motif.cycle(3), g.edges),
        "motif_k4": lambda: match(k4, g.edges),
        "delta_triangle": lambda: track(triangle, log, FIRST_EPOCH),
        "delta_cycle3": lambda: track(Motif.cycle(3), log, FIRST_EPOCH),
        "delta_k4": lambda: track(k4, log, FIRST_EPOCH),
        "delta_seed_k4": lambda: track_cliques_by_triangles(log, FIRST_EPOCH),
        "copurchase_triangles": lambda: C.count_cliques(parts, 3),
        "copurchase_four_cliques": lambda: C.count_cliques(parts, 4),
        "stream_batch": small_batch(g, "all"),
        "stream_batch_copurchase": small_batch(parts, "copurchase"),
    }
    took = {}
    for name, run in queries.items():
        times: list[float] = []
        while len(times) < RUNS and sum(times) < LONG:
            began = time.time()
            out = run()
            if out is not None:
                out.write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times), 3)
    edges = {"all": g.edges.count(), "copurchase": parts.edges.count()}
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "edges": edges}))


if __name__ == "__main__":
    main()
