"""python -m graphloom.cli motif k s1 d1 ... sk dk FILE PRELOAD BATCH [inspect] [--parts N] [--updates FILE] [--strategy S]

Loads the first PRELOAD raw lines of an edge list (with --parts, of FILE00000, FILE00001, ... one after the other) and tracks the motif over the rest, or over the lines of --updates,
in epochs of BATCH lines. With "inspect" it prints each epoch's number of changes; it ends with the total.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import part_name
from graphloom.operators.graph import normalise
from graphloom.operators.match import epoch_counts, track
from graphloom.plans.pattern import Motif
from graphloom.sources.edges import preload_and_batches, update_batches


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["motif"])
    parser.add_argument("words", nargs="+")
    parser.add_argument("--parts", type=int)
    parser.add_argument("--updates")
    parser.add_argument("--strategy", default="generic")
    args = parser.parse_args(argv)
    try:
        n = 1 + 2 * int(args.words[0])
        args.motif = Motif.parse(args.words[:n])
        args.file, preload, batch, *rest = args.words[n:]
        args.preload, args.batch = int(preload), int(batch)
    except ValueError as e:
        parser.error(str(e))
    args.inspect = rest == ["inspect"]
    return args


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    files = [part_name(args.file, i) for i in range(args.parts)] if args.parts else args.file
    held, rest = preload_and_batches(spark, files, args.preload, args.batch)
    changes = update_batches(spark, args.updates, args.batch) if args.updates else rest
    log = normalise(held).select("src", "dst", F.lit(0).alias("t"), F.lit(1).alias("w")).unionByName(changes.where("src <> dst"))
    counts = epoch_counts(track(args.motif, log, 1, args.strategy)).cache()
    if args.inspect:
        for r in counts.orderBy("t").toLocalIterator():
            print(f"epoch {r['t']}: {r['n_changes']} changes, net {r['net']}")
    total = counts.agg(F.coalesce(F.sum("n_changes"), F.lit(0)).alias("n")).first()["n"]
    print(f"{time.time() - began:.3f} s: {total} changes in all")
    return total


if __name__ == "__main__":
    main()
