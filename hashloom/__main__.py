"""Command line: python -m hashloom COMMAND, under spark-submit or alone."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="hashloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("inspect", help="layout of a vector file")
    c.add_argument("path")
    c.add_argument("--fmt", default="auto")
    c = sub.add_parser("convert", help="vector file to Parquet")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--fmt", default="auto")
    c.add_argument("--scale", type=float, default=1.0)
    c = sub.add_parser("sample", help="a fixed sample of n rows")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--n", type=int, default=2_000_000)
    c = sub.add_parser("truth", help="ground truth JSON to Parquet")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--metric")
    c.add_argument("--n-vectors", type=int)
    c = sub.add_parser("query", help="run a named query and show rows")
    c.add_argument("name")
    c.add_argument("tables")
    c.add_argument("--rows", type=int, default=20)
    c = sub.add_parser("build", help="build an index from a Parquet table of vec_id, embedding")
    c.add_argument("vectors")
    c.add_argument("index")
    c.add_argument("--bits", type=int, default=16)
    c.add_argument("--sample", type=int, default=4096, help="vectors that the encoder is trained on")
    c.add_argument("--epochs", type=int, default=30)
    c.add_argument("--partitions", type=int, default=200)
    c = sub.add_parser("search", help="search a built index for the rows of a Parquet table of qid, embedding")
    c.add_argument("index")
    c.add_argument("queries")
    c.add_argument("out")
    c.add_argument("--config", help="JSON file with settings")
    c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting; the last one wins")
    a = p.parse_args(argv)
    from .operators import calibrate
    from .sources import tables, vector_files

    if a.command == "inspect":
        print(vector_files.layout(a.path, a.fmt))
        return
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        df = vector_files.read_vectors(spark, a.path, a.fmt)
        df.withColumn("embedding", F.transform("embedding", lambda x: (x / a.scale).cast("float"))).write.mode("overwrite").parquet(a.out)
    elif a.command == "sample":
        calibrate.sample(spark.read.parquet(a.path), a.n).write.mode("overwrite").parquet(a.out)
    elif a.command == "truth":
        tables.read_truth_json(spark, a.path, a.metric, a.n_vectors).write.mode("overwrite").parquet(a.out)
    elif a.command == "build":
        from .operators.cluster import Policy
        from .plans import search, storage

        vectors = spark.read.parquet(a.vectors)
        layers = search.trained_layers(vectors, a.bits, a.sample, epochs=a.epochs)
        print(search.build(vectors, layers, Policy(), cut=storage.reliable).write(a.index, a.partitions))
    elif a.command == "search":
        from .plans import search

        ix = search.Index.load(spark, a.index)
        bits = len(ix.thr.first()["thr"])
        settings = [f"bits={bits}", *a.set]
        cfg = tables.config_file(spark, a.config, search.SearchConfig, settings) if a.config else tables.config_text("{}", search.SearchConfig, settings)
        find = search.search if ix.members is None else search.search_clustered
        find(ix, spark.read.parquet(a.queries), cfg).write.mode("overwrite").parquet(a.out)
    else:
        from .queries import REGISTRY

        REGISTRY[a.name](spark, a.tables).show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
