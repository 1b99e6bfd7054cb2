"""Vector arithmetic on array columns. Everything is a left fold over doubles, so results don't depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0; zero vectors are at distance 1."""
    return F.greatest(F.lit(1.0) - dot(a, b) / ((norm(a) + F.lit(1e-12)) * (norm(b) + F.lit(1e-12))), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x / F.lit(float(by)))


def clipped_u8(v: Column) -> Column:
    """Values as unsigned bytes would hold them: cut to 0..255, fractions dropped."""
    return F.transform(v, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)).cast("smallint"))


def l2sq_of_norms(aa: Column, bb: Column, ab: Column) -> Column:
    """Squared distance from squared norms and the inner product, at least 0: norms are computed once a row, not once a pair."""
    return F.greatest(aa + bb - F.lit(2.0) * ab, F.lit(0.0))


#: Metric name -> distance of two columns; smaller is nearer (inner products are negated).
METRICS = {"l2sq": l2sq, "l2": lambda a, b: F.sqrt(l2sq(a, b)), "cosine": cosine_distance, "ip": lambda a, b: -dot(a, b)}


def packed_bits(x: Column, thr: Column, strict: bool = False) -> Column:
    """Bucket address: bit k is set where x[k] reaches (strict: exceeds) thr[k]."""
    reached = (lambda v, t: v > t) if strict else (lambda v, t: v >= t)
    return F.aggregate(
        F.sequence(F.lit(0), F.size(x) - 1),
        F.lit(0).cast("bigint"),
        lambda a, k: a + F.when(reached(F.get(x, k), F.get(thr, k)), F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")),
    )


def margins(x: Column, thr: Column) -> Column:
    return F.zip_with(x, thr, lambda v, t: F.abs(v - t))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masked_l1(x: Column, thr: Column, differ: Column) -> Column:
    """Sum of margins over the bits set in `differ`."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(x) - 1),
        F.lit(0.0),
        lambda a, k: a + F.when(F.call_function("shiftright", differ, k).bitwiseAND(F.lit(1)) == 1, F.abs(F.get(x, k) - F.get(thr, k))).otherwise(F.lit(0.0)),
    )


def score_bin(score: Column, max_score: float, bins: int, alpha: float = 1.0) -> Column:
    """Bin of a score: its share of max_score to the power alpha, cut into `bins`; all in bin 0 without a finite positive maximum."""
    if bins <= 1 or not 0 < max_score < float("inf"):
        return F.lit(0)
    share = F.least(F.greatest(score / F.lit(float(max_score)), F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(F.pow(share, F.lit(float(alpha))) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")


def interpolated(curve: Column, x: Column) -> Column:
    """Value at x of a curve, array of struct(knot, y) sorted by knot: linear between knots, flat outside, 0 for an empty curve;
    x that is null, NaN or infinite counts as the first knot, and a result that is negative or not finite as 0."""
    inf = F.lit(float("inf"))
    at = F.when(x.isNull() | F.isnan(x) | (x == inf) | (x == -inf), F.lit(float("-inf"))).otherwise(x)
    below = F.filter(curve, lambda c: c["knot"] <= at)
    above = F.filter(curve, lambda c: c["knot"] > at)
    lo, hi = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    y = (
        F.when(F.size(curve) == 0, F.lit(0.0))
        .when(F.size(below) == 0, hi["y"])
        .when(F.size(above) == 0, lo["y"])
        .otherwise(lo["y"] + (hi["y"] - lo["y"]) * (at - lo["knot"]) / (hi["knot"] - lo["knot"]))
    )
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == inf) | (y < 0), F.lit(0.0)).otherwise(y)
