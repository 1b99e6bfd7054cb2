"""Pairs for calibration, bounds on margins, the gate's margin curve, coverage of scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vectors import METRICS, doubles, interpolated
from . import quantile

#: Named transforms of y; any function of a column to a column will do in their place.
Y_SPACES = {"identity": lambda y: y, "square": lambda y: y * y, "sqrt": lambda y: F.sqrt(F.greatest(y, F.lit(0.0))), "log1p": lambda y: F.log1p(F.greatest(y, F.lit(0.0)))}


def in_space(y: Column, space="auto", metric: str = "l2") -> Column:
    """y in the named space (auto: square for l2, else as it is), or by a function of the caller's."""
    if callable(space):
        return space(y)
    return Y_SPACES[("square" if metric == "l2" else "identity") if space == "auto" else space](y)


def batches(vectors: DataFrame, size: int, count: int, multiplier: int = 7919) -> DataFrame:
    """The vectors that fall in the first batches, with batch: a deterministic shuffle of dense ids, since an exact sample is wanted."""
    n = vectors.agg((F.max("vec_id") + 1).alias("n"))
    at = ((F.col("vec_id") * multiplier) % F.col("n")) / size
    return vectors.crossJoin(F.broadcast(n)).withColumn("batch", F.floor(at)).where(F.col("batch") < count).drop("n")


def similar_pairs(vectors: DataFrame, size: int, count: int, keep: float, y_max: float = float("inf"), cap: int = 0, metric: str = "l2sq") -> DataFrame:
    """batch, i, j, y: pairs i < j within a batch (at most `size` rows each), the nearest share `keep` of each batch, below y_max, `cap` at most."""
    b = batches(vectors, size, count).select("batch", "vec_id", doubles(F.col("embedding")).alias("v"))
    o = b.select("batch", F.col("vec_id").alias("j"), F.col("v").alias("w"))
    p = b.withColumnRenamed("vec_id", "i").join(o, "batch").where("i < j").select("batch", "i", "j", METRICS[metric](F.col("v"), F.col("w")).alias("y"))
    cut = p.groupBy("batch").agg(F.percentile("y", F.lit(keep)).alias("cut"))
    kept = p.join(F.broadcast(cut), "batch").where((F.col("y") <= F.col("cut")) & (F.col("y") < F.lit(y_max))).drop("cut")
    if cap > 0:
        w = W.partitionBy("batch").orderBy((F.col("i") * 31 + F.col("j") * 17) % 1009, "i", "j")
        kept = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return kept


def quantile_report(df: DataFrame, col: str) -> DataFrame:
    """One row: p0, p1, p5, p10, p25, p50, p75, p90, p95, p99, p100."""
    return quantile.one_row(df, F.col(col), {f"p{q}": q / 100 for q in (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)})


def sample(df: DataFrame, n: int, key: str = "vec_id", multiplier: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """Exactly n rows (all, if fewer), the same ones every time: those of the smallest scrambled ids."""
    return df.orderBy((F.col(key) * multiplier) % modulus, key).limit(n)


def sample_share(df: DataFrame, share: float, key: str = "vec_id") -> DataFrame:
    """The share of the rows that `sample` would pick, one at least."""
    return sample(df, max(1, int(df.count() * share)), key)


def train_val(df: DataFrame, ratio: float, key: str = "vec_id") -> DataFrame:
    """The rows with part: train for the first share of dense ids, else val."""
    n = df.agg((F.max(key) + 1).alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col(key) < F.floor(F.col("_n") * F.lit(ratio)), "train").otherwise("val")).drop("_n")


def slope(p: DataFrame, q: float = 0.995) -> DataFrame:
    """a0: a high quantile of x / y over pairs with y > 1e-12; 0 if there are none."""
    return quantile.one_row(p.where("y > 1e-12"), F.col("x") / F.col("y"), {"a0": q}).select(F.coalesce("a0", F.lit(0.0)).alias("a0"))


def shifts(p: DataFrame, a0: DataFrame, targets: Sequence[float] = (0.02, 0.01, 0.005, 0.0025, 0.001), clip: bool = True) -> DataFrame:
    """target, b: the shift at which a share of about `target` exceeds a0 y + b."""
    j = p.crossJoin(F.broadcast(a0))
    each = quantile.one_row(j, F.col("x") - F.col("a0") * F.col("y"), {f"t{i}": 1 - t for i, t in enumerate(targets)})
    floor = (lambda b: F.greatest(b, F.lit(0.0))) if clip else (lambda b: b)
    return each.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("target"), floor(F.col(f"t{i}")).alias("b")) for i, t in enumerate(targets)))).alias("s")).select("s.*")


def picked_shift(sweep: DataFrame, target: float) -> DataFrame:
    """The sweep's row of the target, else its first (largest target)."""
    return sweep.orderBy(F.desc((F.col("target") == target).cast("int")), F.desc("target")).limit(1)


def bound(y: Column, a0: Column, b: Column) -> Column:
    """Shifted upper bound a0 y + b, 0 at least."""
    return F.greatest(a0 * y + b, F.lit(0.0))


def patched(y: Column, a0: Column, y_min: Column) -> Column:
    """Patched upper bound: a0 y, flat at a0 y_min below y_min, 0 at least. It has no shift and doesn't jump."""
    return F.greatest(a0 * F.greatest(y, y_min), F.lit(0.0))


def violations(p: DataFrame, params: DataFrame) -> DataFrame:
    """band (all, low, mid, high by y), n, rate: how often x exceeds its bound; params has a0, b."""
    cuts = quantile.one_row(p, F.col("y"), {"lo": 0.1, "hi": 0.9})
    j = p.crossJoin(F.broadcast(params)).crossJoin(F.broadcast(cuts))
    bad = (F.col("x") > bound(F.col("y"), F.col("a0"), F.col("b")) + F.lit(1e-8)).cast("int")
    band = F.when(F.col("y") <= F.col("lo"), "low").when(F.col("y") > F.col("hi"), "high").otherwise("mid")
    return j.select(F.explode(F.array(F.lit("all"), band)).alias("band"), bad.alias("bad")).groupBy("band").agg(F.count("*").alias("n"), F.avg("bad").alias("rate"))


def margin_curve(needed: DataFrame, bins: int, x: str = "x", y: str = "y", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """knot, n, q95_raw, q99_raw, q95_use, q99_use: bins of equal frequency by x (ties by qid; the first bins have the rows that are left over),
    high quantiles of the margin needed there, made monotone. Ranks are found piece by piece; the curve has one row a bin. `cut` ends the lineage of the ranked rows, which are read
    three times (see storage.reliable)."""
    total = needed.agg(F.count("*").alias("_n"))
    t = cut(quantile.numbered(needed, x, "qid", "_r").crossJoin(F.broadcast(total)))
    size, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    t = t.withColumn("_t", F.when(F.col("_r") < more * (size + 1), F.floor(F.col("_r") / (size + 1))).otherwise(more + F.floor((F.col("_r") - more * (size + 1)) / F.greatest(size, F.lit(1)))))
    each = t.groupBy("_t").agg(F.count("*").alias("n")).join(quantile.exact(t, ["_t"], F.col(x), {"knot": 0.5}), "_t").join(quantile.exact(t, ["_t"], F.col(y), {"q95_raw": 0.95, "q99_raw": 0.99}), "_t")
    up = W.orderBy("knot").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select("knot", "n", "q95_raw", "q99_raw", F.max("q95_raw").over(up).alias("q95_use"), F.max("q99_raw").over(up).alias("q99_use"))


def margin_lookup(df: DataFrame, curve: DataFrame, x: str, y: str = "q95_use", out: str = "margin") -> DataFrame:
    """The frame with the curve's value at x. The curve is one array and broadcast; its knots are a parameter, not data."""
    pts = curve.agg(F.array_sort(F.collect_list(F.struct(F.col("knot"), F.col(y).alias("y")))).alias("_c"))
    return df.crossJoin(F.broadcast(pts)).withColumn(out, interpolated(F.col("_c"), F.col(x))).drop("_c")


def coverage(scores: DataFrame, limits: Sequence[float]) -> DataFrame:
    """s_max, pair_cover, query_cover: shares of true pairs, and of whole queries, whose scores are within each limit."""
    worst = scores.withColumn("worst", F.max("score").over(W.partitionBy("qid")))
    cut = F.explode(F.array(*(F.lit(float(t)) for t in limits)))
    e = worst.withColumn("s_max", cut)
    q = e.groupBy("s_max", "qid").agg(F.avg((F.col("score") <= F.col("s_max")).cast("int")).alias("c"), F.count("*").alias("n"), F.min((F.col("worst") <= F.col("s_max")).cast("int")).alias("w"))
    return q.groupBy("s_max").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("pair_cover"), F.avg("w").alias("query_cover"))
