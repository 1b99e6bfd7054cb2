"""Thresholds, bucket addresses, and what is known of the buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.quantiles import q_half_up, q_linear_int
from ..functions.vectors import packed_bits
from . import quantile


def exploded(encoded: DataFrame, *keys: str, logits: str = "logits") -> DataFrame:
    return encoded.select(*keys, F.posexplode(logits).alias("k", "x"))


def thresholds(encoded: DataFrame) -> DataFrame:
    """One row: thr, the exact median of each logit. A table of up to quantile.SMALL rows is ranked whole in one step (a look at so many rows
    tells); a larger one in the two passes of quantile.exact, with the same result."""
    x = exploded(encoded)
    small = encoded.select(F.lit(1)).limit(quantile.SMALL + 1).count() <= quantile.SMALL
    each = x.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("t")) if small else quantile.exact(x, ["k"], F.col("x"), {"t": 0.5})
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda s: s["t"]).alias("thr"))


def windowed_thresholds(encoded: DataFrame, window_rows: int, groups: int) -> DataFrame:
    """grp, k, thr: the medians within each of the first windows of ids. Raises if a window has no rows."""
    first = encoded.where(F.col("vec_id") < window_rows * groups).withColumn("grp", F.floor(F.col("vec_id") / window_rows))
    out = quantile.exact(exploded(first, "grp"), ["grp", "k"], F.col("x"), {"thr": 0.5})
    seen = first.agg(F.count_distinct("grp").alias("n")).first()["n"]
    if seen < groups:
        raise ValueError(f"{groups - seen} of {groups} windows are empty")
    return out


def bucket_codes(encoded: DataFrame, thr: DataFrame, strict: bool = False) -> DataFrame:
    """The encoded rows with code; thr is one row and broadcast."""
    return encoded.crossJoin(F.broadcast(thr)).withColumn("code", packed_bits(F.col("logits"), F.col("thr"), strict)).drop("thr")


def histogram(coded: DataFrame) -> DataFrame:
    """code, n of the buckets that have rows."""
    return coded.groupBy("code").agg(F.count("*").alias("n"))


def balance(hist: DataFrame, bits: int, *group: str) -> DataFrame:
    """Balance of the buckets: how many, how many empty, largest, and percentiles over non-empty ones with fractions dropped."""
    q = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}
    nlist = F.lit(1 << bits).cast("bigint")
    return hist.groupBy(*group).agg(
        nlist.alias("nlist"),
        F.count("*").alias("nonempty"),
        (nlist - F.count("*")).alias("empty"),
        F.round((nlist - F.count("*")) / nlist, 9).alias("empty_ratio"),
        F.max("n").alias("max_n"),
        *(q_linear_int(F.col("n"), v).alias(k) for k, v in q.items()),
    )


def dense_p50(hist: DataFrame, bits: int) -> DataFrame:
    """p50: the middle of all buckets' sizes, empty ones included (element round(0.5 (n - 1)), halves to even).

    Empty buckets are counted, not made: the element is found by rank among the non-empty ones."""
    nlist = 1 << bits
    rank = round(0.5 * (nlist - 1))
    sizes = hist.groupBy("n").agg(F.count("*").alias("c"))  # few distinct sizes
    at = sizes.select("n", F.sum("c").over(W.orderBy("n")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("all"))
    return at.agg(F.coalesce(F.min(F.when(F.col("upto") + F.lit(nlist) - F.col("all") > rank, F.col("n"))), F.lit(0)).alias("m"), F.max("all").alias("all")).select(
        F.when(F.lit(nlist) - F.coalesce("all", F.lit(0)) > rank, F.lit(0).cast("bigint")).otherwise(F.col("m")).alias("p50")
    )


def top_buckets(hist: DataFrame, k: int = 20) -> DataFrame:
    return hist.orderBy(F.desc("n"), "code").limit(k)


def best_group(stats: DataFrame) -> DataFrame:
    """The most balanced threshold group: smallest largest bucket, then tails, then empties; the first wins."""
    return stats.orderBy("max_n", "p999", "p99", "empty_ratio", F.desc("nonempty"), "grp").limit(1)


def posting_lists(coded: DataFrame) -> DataFrame:
    """code, pos, vec_id: rows of each bucket in id order."""
    return coded.select("code", (F.row_number().over(W.partitionBy("code").orderBy("vec_id")) - 1).cast("bigint").alias("pos"), "vec_id")


def offsets(hist: DataFrame) -> DataFrame:
    """code, n, offset: where each bucket's rows begin in bucket order. Works on one row a bucket, at most 2**bits."""
    before = W.orderBy("code").rowsBetween(W.unboundedPreceding, -1)
    return hist.select("code", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("offset"))


def size_stats(hist: DataFrame) -> DataFrame:
    """min, mean, max and percentiles of the non-empty buckets (element floor(q (m - 1) + 0.5))."""
    q = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9995": 0.9995}
    return hist.agg(F.min("n").alias("min_n"), F.round(F.avg("n"), 9).alias("mean_n"), F.max("n").alias("max_n"), *(q_half_up(F.col("n"), v).alias(k) for k, v in q.items()))


def size_percentiles_dense(hist: DataFrame, bits: int) -> DataFrame:
    """p50, p90, p99 of all buckets' sizes, empty ones as 0 (element floor(q (n - 1))), by rank among the sizes that occur."""
    nlist = 1 << bits
    sizes = hist.groupBy("n").agg(F.count("*").alias("c"))
    at = sizes.select("n", F.sum("c").over(W.orderBy("n")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("all"))
    each = {f"p{round(q * 100)}": int(q * (nlist - 1)) for q in (0.5, 0.9, 0.99)}
    return at.agg(*(F.coalesce(F.min(F.when(F.col("upto") + F.lit(nlist) - F.col("all") > r, F.when(F.lit(nlist) - F.col("all") > r, F.lit(0).cast("bigint")).otherwise(F.col("n")))), F.lit(0)).alias(k) for k, r in each.items()))


def tiers(hist: DataFrame, least_tiny: int = 10) -> DataFrame:
    """tier, buckets, vectors: TINY up to the median (least_tiny at least), BIG from the 99.95th percentile (above tiny + 1), NORMAL between."""
    cut = hist.agg(F.greatest(q_half_up(F.col("n"), 0.5), F.lit(least_tiny)).alias("tiny"), q_half_up(F.col("n"), 0.9995).alias("p9995"))
    cut = cut.select("tiny", F.greatest("p9995", F.col("tiny") + 2).alias("big"))
    tier = F.when(F.col("n") >= F.col("big"), "BIG").when(F.col("n") <= F.col("tiny"), "TINY").otherwise("NORMAL")
    return hist.crossJoin(F.broadcast(cut)).groupBy(tier.alias("tier")).agg(F.count("*").alias("buckets"), F.sum("n").alias("vectors"))


def auto_tiny(hist: DataFrame, fallback: int = 128) -> DataFrame:
    """tiny: the smallest power of two that holds 70 % of the buckets and at most 15 % of the vectors, else the fallback."""
    total = hist.agg(F.count("*").alias("b"), F.sum("n").alias("v"))
    cuts = hist.sparkSession.range(0, 21).select(F.expr("shiftleft(1L, cast(id as int))").alias("cut"))
    each = hist.crossJoin(F.broadcast(cuts)).groupBy("cut").agg(F.sum(F.expr("if(n <= cut, 1, 0)")).alias("b0"), F.sum(F.expr("if(n <= cut, n, 0)")).alias("v0"))
    fits = each.crossJoin(F.broadcast(total)).where("b0 >= 0.7 * b and v0 <= 0.15 * v")
    return fits.agg(F.coalesce(F.min("cut"), F.lit(fallback).cast("bigint")).alias("tiny"))


def big_buckets(hist: DataFrame, least: int = 100_000) -> DataFrame:
    return hist.where(F.col("n") >= least).select("code", "n")


def model_stats(coded: DataFrame, bits: int, *group: str) -> DataFrame:
    """max_n, p99, p999, nonempty, empty_ratio of each candidate model's buckets."""
    return balance(coded.groupBy(*group, "code").agg(F.count("*").alias("n")), bits, *group).select(*group, "max_n", "p99", "p999", "nonempty", "empty_ratio")


def best_model(stats: DataFrame, name: str = "model") -> DataFrame:
    """The model whose largest bucket is smallest; the first wins."""
    return stats.orderBy("max_n", name).limit(1)
