"""Exact quantiles of columns of any size, and exact ranks, without one task that sees a whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Groups of up to SMALL rows are ranked whole; of larger ones the rows near a quantile, found by a summary of relative error 1 / ACCURACY and
#: taken from MARGIN below to MARGIN above it (as shares of the rows), so that the wanted ranks lie within for certain.
SMALL, ACCURACY, MARGIN = 20_000, 20_000, 2e-4


def exact(df: DataFrame, keys: Sequence[str], value: Column, wanted: dict[str, float], few_keys: bool = True) -> DataFrame:
    """keys and one column for each wanted quantile, interpolated between neighbours as usual; nulls are left out, groups without values too.

    Two passes: a mergeable summary of each group brackets the quantiles; the second pass counts what lies below a bracket (one row a group and
    task) and the values within it (equal ones as one row). Only these few are ranked. `few_keys`: the groups' summaries are broadcast, for
    groups whose number a parameter bounds; else they are joined."""
    keys, names = list(keys), list(wanted)
    v = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    share = [min(1.0, max(0.0, q + side * MARGIN)) for q in wanted.values() for side in (-1, 1)]
    cuts = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", share, ACCURACY).alias("_c"))
    low = lambda i: F.when(F.col("_n") <= SMALL, F.lit(float("-inf"))).otherwise(F.get("_c", F.lit(2 * i)))
    high = lambda i: F.when(F.col("_n") <= SMALL, F.lit(float("inf"))).otherwise(F.get("_c", F.lit(2 * i + 1)))
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    spans = F.array(*(F.struct(F.lit(i).alias("i"), low(i).alias("lo"), high(i).alias("hi"), at(q).alias("r")) for i, q in enumerate(wanted.values())))
    cuts = cuts.select(*keys, spans.alias("_s"))
    cuts = F.broadcast(cuts) if few_keys else cuts
    joined = v.join(cuts, keys) if keys else v.crossJoin(cuts)
    near = joined.select(*keys, "_v", F.explode(F.filter("_s", lambda s: F.col("_v") <= s["hi"])).alias("_q"))
    # what is below a bracket is one group of its own, counted before the exchange
    counted = near.groupBy(*keys, "_q.i", "_q.r", F.when(F.col("_v") >= F.col("_q.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counted.withColumn("_to", upto)
    first = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_v")))
    floor = F.floor("r")
    each = ranked.groupBy(*keys, "i", "r").agg(first(floor).alias("a"), first(floor + 1).alias("b"))
    got = each.withColumn("x", F.when(F.col("r") == floor, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - floor)))
    return got.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("x"))).alias(n) for i, n in enumerate(names)))


def one_row(df: DataFrame, value: Column, wanted: dict[str, float]) -> DataFrame:
    """`exact` over the whole frame: always one row, of nulls where there are no values."""
    return exact(df, [], value, wanted)


def numbered(df: DataFrame, by: str, tie: str, name: str, pieces: int = 256) -> DataFrame:
    """The frame with each row's place (from 0) in the order of `by`, then of `tie`: the frame is cut into pieces by quantiles of `by` (and
    where rows share a cut's value, by quantiles of `tie`), pieces are counted, and places are numbered within a piece."""
    share = [k / pieces for k in range(1, pieces)]
    cuts = df.agg(F.array_distinct(F.percentile_approx(F.col(by).cast("double"), share, 10_000)).alias("_by"), F.array_distinct(F.percentile_approx(F.col(tie).cast("double"), share, 10_000)).alias("_tie"))
    below = lambda cut, x: F.size(F.filter(cut, lambda c: c < x))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_p", below(F.col("_by"), F.col(by).cast("double")) * 2)
    on_cut = F.exists("_by", lambda c: c == F.col(by).cast("double"))
    # rows equal to a cut come after those below it within the same piece of `below`, and are cut again by `tie`
    dealt = dealt.withColumn("_piece", F.when(on_cut, F.struct((F.col("_p") + 1).alias("p"), below(F.col("_tie"), F.col(tie).cast("double")).alias("t"))).otherwise(F.struct(F.col("_p").alias("p"), F.lit(0).alias("t"))))
    dealt = dealt.drop("_by", "_tie", "_p")
    # at most 2 * pieces ** 2 rows, whatever the input: a proven bound for the broadcast
    count = dealt.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = count.select("_piece", (F.sum("_n").over(W.orderBy("_piece")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_piece").orderBy(by, tie)) - 1
    return dealt.withColumn("_w", within).join(F.broadcast(before), "_piece").withColumn(name, F.col("_before") + F.col("_w")).drop("_piece", "_w", "_before")
