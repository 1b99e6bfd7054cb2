"""From a query's logits to the buckets worth probing: costs of bits, subsets of them, scores, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.vectors import margins, packed_bits, score_bin
from . import quantile


def prepared(queries: DataFrame, thr: DataFrame, lsel: int | None = None) -> DataFrame:
    """qid, base, ranked: the query's own bucket, and its cheapest bits as array of (cost, bit), ties by the lower bit."""
    q = queries.crossJoin(F.broadcast(thr))
    ranked = F.array_sort(F.transform(margins(F.col("logits"), F.col("thr")), lambda c, k: F.struct(c.alias("cost"), k.alias("bit"))))
    ranked = ranked if lsel is None else F.slice(ranked, 1, lsel)
    return q.select("qid", packed_bits(F.col("logits"), F.col("thr")).alias("base"), ranked.alias("ranked"))


def bit_costs(queries: DataFrame, thr: DataFrame) -> DataFrame:
    return queries.crossJoin(F.broadcast(thr)).select("qid", F.posexplode(margins(F.col("logits"), F.col("thr"))).alias("bit", "cost"))


def bit_ranks(prep: DataFrame) -> DataFrame:
    """qid, bit, rnk."""
    return prep.select("qid", F.posexplode("ranked").alias("rnk", "r")).select("qid", F.col("r.bit").alias("bit"), "rnk")


def mask_plan(spark: SparkSession, lsel: int, rmax: int) -> DataFrame:
    """plan_idx, mask, ranks: all subsets of up to rmax of lsel ranks; small ones first, then by rank positions.

    Its size is fixed by the two numbers, never by data, so it is broadcast."""
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(lsel - 1)), lambda r: F.call_function("shiftright", F.col("mask"), r).bitwiseAND(F.lit(1)) == 1), lambda r: r)
    plan = spark.range(1 << lsel).select(F.col("id").alias("mask")).where(F.bit_count("mask") <= rmax).withColumn("ranks", bits)
    order = W.orderBy(F.size("ranks"), "ranks")
    return plan.select((F.row_number().over(order) - 1).cast("int").alias("plan_idx"), "mask", "ranks")


def probes(prep: DataFrame, plan: DataFrame, max_score: float = float("inf"), keep_base: bool = True) -> DataFrame:
    """qid, plan_idx, code, score of each bucket whose score is max_score or less. The limit applies right after scoring."""
    p = prep.crossJoin(F.broadcast(plan if keep_base else plan.where("mask <> 0")))
    score = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + F.get(F.col("ranked"), r)["cost"])
    flips = F.aggregate("ranks", F.lit(0).cast("bigint"), lambda a, r: a + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get(F.col("ranked"), r)["bit"]))
    # plans are made for lsel ranks; a query with fewer bits has no cost at the others
    p = p.withColumn("score", score).where(F.col("score").isNotNull())
    p = p if max_score == float("inf") else p.where(F.col("score") <= F.lit(max_score))
    return p.select("qid", "plan_idx", F.col("base").bitwiseXOR(flips).alias("code"), "score")


def probes_pruned(prep: DataFrame, rmax: int, max_score: float) -> DataFrame:
    """qid, code, score: the same buckets level by level, one more flipped bit each, where a branch ends once its cost passes the limit. For
    plans too large to be joined with every query. Costs ascend, so nothing beyond the limit is ever extended."""
    flip = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get("ranked", k)["bit"])
    here = prep.select("qid", "ranked", F.col("base").alias("code"), F.lit(0.0).alias("score"), F.lit(-1).alias("last"))
    out = here.select("qid", "code", "score")
    for _ in range(rmax):
        nexts = F.filter(F.sequence(F.col("last") + 1, F.size("ranked") - 1, F.lit(1)), lambda k: F.col("score") + F.get("ranked", k)["cost"] <= F.lit(max_score))
        more = here.where(F.col("last") + 1 < F.size("ranked")).select("*", F.explode(nexts).alias("k"))
        here = more.select("qid", "ranked", F.col("code").bitwiseXOR(flip(F.col("k"))).alias("code"), (F.col("score") + F.get("ranked", F.col("k"))["cost"]).alias("score"), F.col("k").alias("last"))
        out = out.unionByName(here.select("qid", "code", "score"))
    return out


def binned(probed: DataFrame, max_score: float, bins: int, alpha: float, to_bin=score_bin) -> DataFrame:
    """The probes with bin; `to_bin` may be any function of (score, max_score, bins, alpha) to a column."""
    return probed.withColumn("bin", to_bin(F.col("score"), max_score, bins, alpha))


def capped(probed: DataFrame, cap: int) -> DataFrame:
    """The first `cap` probes of each bin in plan order; 0 or less: all."""
    if cap <= 0:
        return probed
    w = W.partitionBy("qid", "bin").orderBy("plan_idx")
    return probed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def bin_sizes(probed: DataFrame, hist: DataFrame) -> DataFrame:
    """qid, bin, n_buckets, n_vectors."""
    return probed.join(hist, "code", "left").groupBy("qid", "bin").agg(F.count("*").alias("n_buckets"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_vectors"))


def classified(probed: DataFrame, hist: DataFrame, big: int, skip: int | None = None, classify=None) -> DataFrame:
    """The probes with n and tag NORMAL, BIG (n >= big) or SKIP (empty, or n >= skip); `classify` may be any function of n to a column."""

    def usual(n: Column) -> Column:
        tag = F.when(n == 0, "SKIP")
        tag = tag if skip is None else tag.when(n >= skip, "SKIP")
        return tag.when(n >= big, "BIG").otherwise("NORMAL")

    return probed.join(hist, "code", "left").fillna(0, ["n"]).withColumn("tag", (classify or usual)(F.col("n")))


def sorted_margin_stats(queries: DataFrame, thr: DataFrame) -> DataFrame:
    """pos, mean, p10, p50, p90 of the margins at each place of their order."""
    each = queries.crossJoin(F.broadcast(thr)).select(F.posexplode(F.array_sort(margins(F.col("logits"), F.col("thr")))).alias("pos", "m"))
    return each.groupBy("pos").agg(F.avg("m").alias("mean")).join(quantile.exact(each, ["pos"], F.col("m"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "pos")
