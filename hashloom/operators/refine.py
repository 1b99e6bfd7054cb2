"""Exact distances and the nearest k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.vectors import METRICS, doubles

#: A query set up to this many rows is broadcast; a larger one is cut into blocks of it, each scanned in its own pass.
QUERY_BLOCK = 4096


def top_k(scored: DataFrame, k: int, by: str = "dist", id_col: str = "vec_id", rank: str = "rank") -> DataFrame:
    """The k smallest of each query, ties by id; ranked from 1. Spark limits the groups before the exchange."""
    w = W.partitionBy("qid").orderBy(by, id_col)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def merged(*tops: DataFrame, k: int) -> DataFrame:
    """The nearest k among several top lists."""
    out = tops[0].drop("rank")
    for t in tops[1:]:
        out = out.unionByName(t.drop("rank"))
    return top_k(out, k)


def brute_force(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """qid, rank, vec_id, dist by scanning all of `base` for each query of a bounded query set (QUERY_BLOCK rows at a time)."""
    n = queries.count()
    if n > QUERY_BLOCK:
        blocks = -(-n // QUERY_BLOCK)
        dealt = queries.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        out = None
        for b in range(blocks):
            part = brute_force(dealt.where(F.col("_b") == b).drop("_b"), base, k, metric)
            out = part if out is None else out.unionByName(part)
        return out
    pairs = base.select("vec_id", doubles(F.col("embedding")).alias("b")).crossJoin(F.broadcast(queries.select("qid", doubles(F.col("embedding")).alias("q"))))
    return top_k(pairs.select("qid", "vec_id", METRICS[metric](F.col("q"), F.col("b")).alias("dist")), k).select("qid", "rank", "vec_id", "dist")


def refined(probed: DataFrame, payload: DataFrame, queries: DataFrame, on: list[str], k: int, metric: str = "l2sq", exclude_self: bool = False) -> DataFrame:
    """qid, rank, vec_id, dist: exact distances of the rows that lie where a query probes.

    payload has the vectors at their places (columns `on`, vec_id, embedding), probed the places of each query. Distances are computed where the two meet, so what goes
    through the exchange after that is (qid, vec_id, dist), cut to the nearest k of each query in each task; no candidate's vector moves."""
    asked = probed.select("qid", *on).join(queries.select("qid", doubles(F.col("embedding")).alias("q")), "qid")
    met = asked.join(payload.select(*on, "vec_id", "embedding"), on)
    met = met.where("qid <> vec_id") if exclude_self else met
    return top_k(met.select("qid", "vec_id", METRICS[metric](F.col("q"), doubles(F.col("embedding"))).alias("dist")), k).select("qid", "rank", "vec_id", "dist")
