"""Clusters a matrix file or a Parquet table from the command line: python -m meanfield DATA -c 8 -a yinyang -t oror -s out."""

from __future__ import annotations

import argparse
import os

import numpy as np
from pyspark.sql import SparkSession

from meanfield.operators import assign, kmeans, report
from meanfield.sources import matrix


def options(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="meanfield", description=__doc__)
    p.add_argument("data", help="a matrix file, or a Parquet table with --id and --features")
    p.add_argument("--id", default="pos", help="the table's id column")
    p.add_argument("--features", default="v", help="an array column or numeric columns, between commas")
    p.add_argument("-c", "--clusters", type=int, required=True)
    p.add_argument("-a", "--algorithm", default="naive", choices=["naive", "elkan", "hamerly", "annulus", "drake", "yinyang"])
    p.add_argument("-t", "--init", default="forgy", help=f"one of {', '.join(kmeans.INITS)}, or a centroid file")
    p.add_argument("--init-param", type=float, help="trials of mindist, factor of oror")
    p.add_argument("-I", "--max-iter", type=int, default=0)
    p.add_argument("-i", "--min-iter", type=int, default=0)
    p.add_argument("-R", "--min-rel", type=float)
    p.add_argument("-n", "--repetitions", type=int, default=1)
    p.add_argument("-T", "--seconds", type=float, help="restarts until so much time is over")
    p.add_argument("-r", "--seed", type=int, default=0)
    p.add_argument("-l", "--balance", type=float, default=0.0, help="weight of the penalty for large clusters")
    p.add_argument("-N", "--sample-rate", type=float, default=1.0)
    p.add_argument("-m", "--no-mse", action="store_true", help="stop when no assignment changes, without the error")
    p.add_argument("-d", "--bounds", type=int, default=2, help="Drake's bounds")
    p.add_argument("-D", "--adaptive", action="store_true", help="adapt Drake's bounds")
    p.add_argument("-G", "--groups", type=int, help="Yinyang's groups")
    p.add_argument("-C", "--same-size-groups", action="store_true", help="group Yinyang's centroids in equal sizes")
    p.add_argument("--no-local-filter", action="store_true")
    p.add_argument("--repair", default="cyclic", choices=["cyclic", "random"])
    p.add_argument("-p", "--permutation", help="a permutation file to apply to the centroids at the end")
    p.add_argument("-s", "--save", help="folder for centroids.fbin and classes")
    p.add_argument("-o", "--stem", help="write <stem>_<i>.cls and <stem>_<i>.cnt at each iteration that lowers the fit")
    p.add_argument("-b", "--reducer-bench", type=int, default=0, help="time so many reductions first")
    p.add_argument("-v", "--verbosity", type=int, default=1)
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: report.Output | None = None) -> kmeans.Model:
    """Runs with the options of ``argv``; returns the best model."""
    o, out = options(argv), out or report.Output()
    spark = spark or SparkSession.builder.appName("meanfield").getOrCreate()
    plain = os.path.isfile(o.data) and not o.data.endswith(".parquet")
    df = matrix.read_dataset(spark, o.data) if plain else spark.read.parquet(o.data)
    features = tuple(o.features.split(","))
    rows, n, dim = kmeans.prepared(df, o.id, *features)
    if o.verbosity > 0:
        out(f"{n} rows, {dim} columns, {o.clusters} clusters")
    if o.reducer_bench:
        took = report.reducer_seconds(spark, o.clusters, dim, int(spark.conf.get("spark.sql.shuffle.partitions")), o.reducer_bench)
        out(f"reductions: {min(took):.4f} to {max(took):.4f} s, mean {sum(took) / len(took):.4f} s")
    accelerated = {}
    if o.algorithm == "drake":
        accelerated = {"n_bounds": o.bounds, "adaptive": o.adaptive}
    elif o.algorithm == "yinyang":
        accelerated = {"groups": o.groups, "group_by": "samesize" if o.same_size_groups else "kmeans", "local_filter": not o.no_local_filter}
    model = kmeans.fit(
        df, o.clusters, id_col=o.id, features=features, algorithm=o.algorithm, init=o.init, init_param=o.init_param, seed=o.seed, max_iter=o.max_iter, min_iter=o.min_iter, min_rel=o.min_rel,
        balance_lambda=o.balance, sample_rate=o.sample_rate, track_mse=not o.no_mse, repetitions=o.repetitions, time_budget=o.seconds, repair=o.repair,
        report=report.iteration_files(rows, o.stem) if o.stem else None, each=report.repetition_files(o.save) if o.save else None, **accelerated,
    )
    if o.permutation:
        model = model.permuted(np.fromfile(o.permutation, "<i4").tolist())
    if o.verbosity > 3:
        for line in report.history_lines(model.history, n, o.clusters):
            out(line)
    if o.verbosity > 0:
        out(f"fit {model.fit:.8g} after {len(model.history)} iterations")
    if o.verbosity > 4:
        for line in report.centroid_lines(model.centroids):
            out(line)
    if o.save:
        matrix.save_centroids(model.centroids, os.path.join(o.save, "centroids.fbin"), double=True)
        classes = assign.classify(rows.drop("id").withColumnRenamed("pos", "id"), model.centroids)
        matrix.save_classes(classes.withColumnRenamed("id", "pos"), os.path.join(o.save, "classes.cls"))
    rows.unpersist()
    return model


if __name__ == "__main__":
    main()
