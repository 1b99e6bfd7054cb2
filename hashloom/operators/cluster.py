"""Sub-clustering of buckets in logit space."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vectors import l2sq
from . import quantile


@dataclass(frozen=True)
class Policy:
    """Clusters of a bucket of n rows: none if empty, one under min_small, else n over a target size that grows from min_large on."""

    min_small: int = 32
    min_large: int = 129
    target_small: int = 32
    target_large: int = 64
    most: int = 2048

    def k(self, n: Column) -> Column:
        many = F.when(n >= self.min_large, F.ceil(n / self.target_large)).otherwise(F.ceil(n / self.target_small))
        return F.when(n == 0, F.lit(0)).when(n < self.min_small, F.lit(1)).otherwise(F.least(many, F.lit(self.most))).cast("int")


def with_k(hist: DataFrame, policy: Policy) -> DataFrame:
    return hist.withColumn("k", policy.k(F.col("n")))


def _centroids(members: DataFrame, digits: int) -> DataFrame:
    each = members.select("code", "cid", F.posexplode("logits").alias("d", "x")).groupBy("code", "cid", "d").agg(F.round(F.avg("x"), digits).alias("x"))
    return each.groupBy("code", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


#: Rows of a bucket that one task compares with its centroids, about.
SALT_ROWS = 100_000


def _nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, code, logits, cid, d2. A bucket's centroids (2,048 at most, by the policy) come as one array to the bucket's rows, so the nearest is found within
    the row and nothing is exchanged after the join. points has `parts`: rows of a large bucket are dealt over so many keys, each with its
    own copy of the centroids, so no bucket is one task's."""
    whole = centroids.groupBy("code").agg(F.collect_list(F.struct("cid", "centroid")).alias("all"))
    parts = points.select("code", "parts").distinct()
    whole = whole.join(parts, "code").select("code", "all", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = points.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    best = F.array_min(F.transform("all", lambda c: F.struct(l2sq(F.col("logits"), c["centroid"]).alias("d2"), c["cid"].alias("cid"))))
    return dealt.join(whole, ["code", "part"]).select("vec_id", "code", "logits", "parts", best.alias("best")).select("vec_id", "code", "logits", "parts", F.col("best.cid").alias("cid"), F.col("best.d2").alias("d2"))


def nearest(coded: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, code, logits, cid, d2: rows that came later, at the nearest cluster of their bucket."""
    sized = coded.select("vec_id", "code", "logits").join(coded.groupBy("code").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts")), "code")
    return _nearest(sized, centroids).drop("parts")


def _ranked(coded: DataFrame, stretch: int) -> DataFrame:
    """coded with pos (place in the bucket by id) and n (rows of the bucket). Ids are cut into stretches, counted per bucket, so a task orders
    `stretch` rows of a bucket at most (ids are distinct)."""
    cut = coded.withColumn("_s", F.floor(F.col("vec_id") / stretch))
    count = cut.groupBy("code", "_s").agg(F.count("*").alias("_c"))
    before = count.select("code", "_s", (F.sum("_c").over(W.partitionBy("code").orderBy("_s")) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy("code")).alias("n"))
    within = F.row_number().over(W.partitionBy("code", "_s").orderBy("vec_id")) - 1
    return cut.withColumn("_w", within).join(before, ["code", "_s"]).withColumn("pos", F.col("_before") + F.col("_w")).drop("_s", "_w", "_before")


def lloyd(coded: DataFrame, policy: Policy, rounds: int = 2, digits: int = 9, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Deterministic k-means of every bucket at once: (members: vec_id, code, logits, cid, d2; clusters: code, cid, centroid).

    Centroids start at rows evenly spaced in id order and are rounded each pass, so no order of summation shows; an empty cluster keeps
    its centroid. Labels are those of the last centroids. A pass is an equi-join on the bucket and one aggregation; `cut` ends the
    lineage of the ranked rows, of a pass's centroids and of the members (see storage.reliable)."""
    ranked = _ranked(coded.select("vec_id", "code", "logits"), 10 * SALT_ROWS)
    ranked = cut(ranked.withColumn("k", policy.k(F.col("n"))).withColumn("parts", F.ceil(F.col("n") / SALT_ROWS).cast("int")))
    points = ranked.select("vec_id", "code", "logits", "parts")
    # row p starts cluster c if p = floor(c n / k)
    starts = ranked.withColumn("cid", F.expr("cast((pos * k + n - 1) div n as int)")).where("cid < k and (cid * n) div k = pos")
    centroids = starts.select("code", "cid", F.transform("logits", lambda x: F.round(x, digits)).alias("centroid"))
    for _ in range(rounds):
        moved = _centroids(_nearest(points, centroids), digits).withColumnRenamed("centroid", "moved")
        centroids = cut(centroids.join(moved, ["code", "cid"], "left").select("code", "cid", F.coalesce("moved", "centroid").alias("centroid")))
    return cut(_nearest(points, centroids).drop("parts")), centroids


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(x)))]
    d2 = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = d2.sum()
        nxt = int(rng.choice(len(x), p=d2 / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(nxt)
        d2 = np.minimum(d2, ((x - x[nxt]) ** 2).sum(axis=1))
    return x[chosen].copy()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def kmeans(x: np.ndarray, k: int, seed: int, sample: int = 20_000, rounds: int = 20, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centroids: seeding by distance, rounds on a sample, passes over all rows; empty clusters restart at random rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    fit = x[rng.choice(len(x), sample, replace=False)] if len(x) > sample else x
    c = _plus_plus(fit, k, rng)
    for data, times in ((fit, rounds), (x, passes)):
        for _ in range(times):
            label = _distances(data, c).argmin(axis=1)
            count = np.bincount(label, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, label, data)
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], data[rng.integers(len(data), size=k)])
            if np.allclose(new, c):
                break
            c = new
    return _distances(x, c).argmin(axis=1), c


def quality(x: np.ndarray, label: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Least distance between centroids, and overlap: twice the 99th percentile of distances over it (0 for one cluster)."""
    if len(c) < 2:
        return float("inf"), 0.0
    between = _distances(c, c) + np.diag(np.full(len(c), np.inf))
    sep = float(np.sqrt(between.min()))
    p99 = float(np.quantile(np.sqrt(((x - c[label]) ** 2).sum(axis=1)), 0.99))
    return sep, (2 * p99 / sep if sep > 0 else float("inf"))


def kmeans_retry(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """k-means, and once more with half the clusters where the first came out degenerate; the better pair of labels and centroids stays together."""
    label, c = kmeans(x, k, seed)
    sep, overlap = quality(x, label, c)
    if len(c) > 1 and (sep < 1e-3 or overlap > 50 or not np.isfinite(overlap)):
        again, c2 = kmeans(x, max(1, len(c) // 2), seed + 1)
        if quality(x, again, c2)[1] < overlap:
            return again, c2, True
    return label, c, False


def kmeans_buckets(coded: DataFrame, policy: Policy, split: int = 200_000, seed: int = 42) -> DataFrame:
    """vec_id, code, cid, d2, centroid, retried: k-means++ of each bucket in its own task. A bucket over `split` rows is cut into parts by
    a hash of the id, each clustered alone with its own cluster numbers, so no task gathers more than about `split` rows."""
    hist = coded.groupBy("code").agg(F.count("*").alias("n"))
    sized = coded.select("vec_id", "code", "logits").join(with_k(hist, policy).withColumn("parts", F.ceil(F.col("n") / split).cast("int")), "code")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    most = policy.most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["logits"].to_numpy()).astype(np.float64)
        part, parts, k = int(pdf["part"].iloc[0]), int(pdf["parts"].iloc[0]), int(pdf["k"].iloc[0])
        label, c, retried = kmeans_retry(x, -(-k // parts), seed + int(pdf["code"].iloc[0]) * 31 + part)
        d2 = ((x - c[label]) ** 2).sum(axis=1)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "code": pdf["code"], "cid": label + part * most, "d2": d2, "centroid": [c[i] for i in label], "retried": retried})

    return sized.groupBy("code", "part").applyInPandas(run, "vec_id bigint, code bigint, cid int, d2 double, centroid array<double>, retried boolean")


def cluster_quality(members: DataFrame, clusters: DataFrame, eps: float = 0.05) -> DataFrame:
    """Per bucket: k, mean, max and percentiles of distances, least separation, overlap, median margin to the second centroid, share of ambiguous rows.
    The two nearest centroids are found within the row, from the bucket's array of centroids."""
    whole = clusters.groupBy("code").agg(F.count("*").alias("k"), F.collect_list("centroid").alias("all"))
    two = members.select("code", "logits").join(whole.select("code", "all"), "code").select("code", F.slice(F.array_sort(F.transform("all", lambda c: F.sqrt(l2sq(F.col("logits"), c)))), 1, 2).alias("ds"))
    two = two.select("code", F.get("ds", F.lit(0)).alias("d"), (F.get("ds", F.lit(1)) - F.get("ds", F.lit(0))).alias("margin"))
    a = two.groupBy("code").agg(F.avg("d").alias("mean_l2"), F.max("d").alias("max_l2"), F.avg(F.when(F.col("margin") < eps, 1.0).otherwise(0.0)).alias("ambiguous"))
    q = quantile.exact(two, ["code"], F.col("d"), {"p50_l2": 0.5, "p90_l2": 0.9, "p99_l2": 0.99}, few_keys=False)
    m = quantile.exact(two, ["code"], F.col("margin"), {"margin_p50": 0.5}, few_keys=False)
    # pairs of a bucket's centroids, whose number the policy bounds, within its row
    place = F.transform("all", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    between = F.flatten(F.transform(place, lambda a: F.transform(F.filter(place, lambda b: b["i"] > a["i"]), lambda b: F.sqrt(l2sq(a["c"], b["c"])))))
    j = whole.select("code", "k", F.array_min(between).alias("separation")).join(a, "code").join(q, "code").join(m, "code", "left")
    overlap = F.when(F.col("k") < 2, F.lit(0.0)).when(F.col("separation") == 0, F.lit(float("inf"))).otherwise(2 * F.col("p99_l2") / F.col("separation"))
    return j.select("code", "k", "mean_l2", "max_l2", "p50_l2", "p90_l2", "p99_l2", "margin_p50", "ambiguous", "separation", overlap.alias("overlap"))


def cluster_classes(hist_k: DataFrame) -> DataFrame:
    """class, buckets, vectors, clusters by how many clusters a bucket has."""
    c = F.when(F.col("k") == 0, "TINY").when(F.col("k") <= 1, "SMALL").when(F.col("k") < 1000, "NORMAL").otherwise("BIG")
    return hist_k.groupBy(c.alias("class")).agg(F.count("*").alias("buckets"), F.sum("n").alias("vectors"), F.sum("k").alias("clusters"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    """code, cid, n, offset: rows of each cluster, and where they begin in (code, cid) order."""
    n = members.groupBy("code", "cid").agg(F.count("*").alias("n"))
    # one row a cluster; buckets are summed first so that the running sum needs one row a bucket in order
    of_bucket = n.groupBy("code").agg(F.sum("n").alias("_all"))
    before = of_bucket.select("code", (F.sum("_all").over(W.orderBy("code")) - F.col("_all")).alias("_before"))
    within = F.sum("n").over(W.partitionBy("code").orderBy("cid")) - F.col("n")
    return n.join(before, "code").select("code", "cid", "n", (F.col("_before") + within).alias("offset"))


def sub_posting_lists(members: DataFrame) -> DataFrame:
    """code, cid, pos, vec_id: rows of each cluster in id order."""
    return members.select("code", "cid", (F.row_number().over(W.partitionBy("code", "cid").orderBy("vec_id")) - 1).cast("bigint").alias("pos"), "vec_id")
