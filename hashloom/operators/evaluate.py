"""Results against the truth: recall, flipped bits, margins, distances to ground-truth clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import hamming, l2sq, masked_l1
from . import quantile


def valid_truth(truth: DataFrame, vectors: DataFrame) -> DataFrame:
    """Truth rows whose id exists."""
    return truth.join(vectors.select("vec_id"), "vec_id", "left_semi")


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall: the mean share of each query's true nearest k that were found (queries without results count 0)."""
    hits = truth.where(F.col("rank") <= k).select("qid", "vec_id").join(results.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    each = hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("r"))
    return each.agg(F.round(F.avg("r"), 9).alias("recall"))


def pairs(truth: DataFrame, coded_queries: DataFrame, coded: DataFrame) -> DataFrame:
    """qid, vec_id, dist, x_q, x_b, code_q, code_b of each true pair."""
    q = coded_queries.select("qid", F.col("logits").alias("x_q"), F.col("code").alias("code_q"))
    b = coded.select("vec_id", F.col("logits").alias("x_b"), F.col("code").alias("code_b"))
    return truth.select("qid", "vec_id", "dist").join(b, "vec_id").join(q, "qid")


def hamming_histogram(paired: DataFrame, bits: int) -> DataFrame:
    """h, n for every h from 0 to bits."""
    n = paired.groupBy(hamming(F.col("code_q"), F.col("code_b")).cast("bigint").alias("h")).agg(F.count("*").alias("n"))
    return paired.sparkSession.range(bits + 1).withColumnRenamed("id", "h").join(F.broadcast(n), "h", "left").fillna(0, ["n"])


def flip_ranks(paired: DataFrame, ranks: DataFrame) -> DataFrame:
    """rnk, n, share: at which rank of the query's cheapest bits the flipped bits lie."""
    bits = paired.select("qid", F.explode(F.sequence(F.lit(0), F.size("x_q") - 1)).alias("bit"), F.col("code_q").bitwiseXOR(F.col("code_b")).alias("x"))
    flipped = bits.where(F.call_function("shiftright", F.col("x"), F.col("bit")).bitwiseAND(F.lit(1)) == 1)
    n = flipped.join(ranks, ["qid", "bit"]).groupBy("rnk").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("rnk", "n", (F.col("n") / F.col("t")).alias("share"))


def flip_rank_summary(ranks: DataFrame) -> DataFrame:
    """avg_rank, top4, top8 (shares); null if nothing flipped."""
    n = F.sum("n")
    return ranks.agg((F.sum(F.col("n") * F.col("rnk")) / n).alias("avg_rank"), (F.sum(F.expr("if(rnk < 4, n, 0)")) / n).alias("top4"), (F.sum(F.expr("if(rnk < 8, n, 0)")) / n).alias("top8"))


def masked_margins(paired: DataFrame, thr: DataFrame) -> DataFrame:
    """qid, vec_id, dist, x_query, x_both: margins over the differing bits, of the query and of both sides."""
    differ = F.col("code_q").bitwiseXOR(F.col("code_b"))
    j = paired.crossJoin(F.broadcast(thr)).withColumn("x_query", masked_l1(F.col("x_q"), F.col("thr"), differ))
    return j.select("qid", "vec_id", "dist", "x_query", (F.col("x_query") + masked_l1(F.col("x_b"), F.col("thr"), differ)).alias("x_both"))


def truth_to_centroid(truth: DataFrame, members: DataFrame, clusters: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, vec_id, d_gt (query to true neighbour) and d_cent (query to its cluster's centroid), both squared, in logit space."""
    j = truth.select("qid", "vec_id").join(members.select("vec_id", "code", "cid", "logits"), "vec_id").join(clusters, ["code", "cid"]).join(queries.select("qid", F.col("logits").alias("q")), "qid")
    return j.select("qid", "vec_id", l2sq(F.col("q"), F.col("logits")).alias("d_gt"), l2sq(F.col("q"), F.col("centroid")).alias("d_cent"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, corr, rmse, n; zeros where a fit is degenerate (under two rows, or a constant x; corr also for a constant y)."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.agg(F.count("*").alias("n"), F.var_pop(xs).alias("vx"), F.var_pop(ys).alias("vy"), F.covar_pop(xs, ys).alias("c"), F.avg(xs).alias("mx"), F.avg(ys).alias("my"))
    ok = (F.col("n") >= 2) & (F.col("vx") > 0)
    zero = F.lit(0.0)
    slope = F.when(ok, F.col("c") / F.col("vx")).otherwise(zero)
    return s.select(
        slope.alias("slope"),
        F.when(ok, F.col("my") - slope * F.col("mx")).otherwise(zero).alias("intercept"),
        F.when(ok & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(zero).alias("corr"),
        F.when(ok, F.sqrt(F.greatest(F.col("vy") - slope * F.col("c"), zero))).otherwise(zero).alias("rmse"),
        "n",
    )


def distance_summary(d: DataFrame) -> DataFrame:
    """measure, p50, p90, p99 of d_gt, d_cent, their difference and ratio, plain and squared."""
    root = lambda c: F.sqrt(F.col(c))
    m = {
        "d_gt": root("d_gt"), "d_cent": root("d_cent"), "diff": root("d_cent") - root("d_gt"), "ratio": root("d_cent") / (root("d_gt") + F.lit(1e-12)),
        "d_gt_sq": F.col("d_gt"), "d_cent_sq": F.col("d_cent"), "diff_sq": F.col("d_cent") - F.col("d_gt"), "ratio_sq": F.col("d_cent") / (F.col("d_gt") + F.lit(1e-20)),
    }
    each = d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in m.items()))).alias("s")).select("s.*")
    return quantile.exact(each, ["measure"], F.col("v"), {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def distance_transform(truth: DataFrame, how: str = "auto") -> DataFrame:
    """Truth distances in another space: none, one_minus, auto (one_minus if all lie in [-1, 1]), two_minus_two_cos, twice_cosdist."""
    d = F.col("dist")
    if how == "auto":
        span = truth.agg(F.min("dist").alias("_lo"), F.max("dist").alias("_hi"))
        cos = (F.col("_lo") >= F.lit(-1.0001)) & (F.col("_hi") <= F.lit(1.0001))
        return truth.crossJoin(F.broadcast(span)).withColumn("dist", F.when(cos, F.lit(1.0) - d).otherwise(d)).drop("_lo", "_hi")
    one = F.lit(1.0)
    made = {"none": d, "one_minus": one - d, "two_minus_two_cos": 2 * one - 2 * F.least(F.greatest(d, -one), one), "twice_cosdist": F.greatest(2 * d, F.lit(0.0))}
    return truth.withColumn("dist", made[how])
