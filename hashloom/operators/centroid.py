"""Choosing clusters among the probed buckets: top K_c by centroid distance, gated by a calibrated margin, with early stop."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vectors import interpolated, l2sq


def probed_clusters(probes: DataFrame, clusters: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, bin, code, cid, k, d2: centroid distances of every cluster in a probed bucket; k: clusters of the bucket."""
    k = clusters.groupBy("code").agg(F.count("*").alias("k"))
    j = probes.select("qid", "bin", "code").join(clusters.join(k, "code"), "code").join(queries.select("qid", "logits"), "qid")
    return j.select("qid", "bin", "code", "cid", "k", l2sq(F.col("logits"), F.col("centroid")).alias("d2"))


def singletons(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct, multi): buckets of a single cluster skip the centroid stage."""
    return found.where("k = 1"), found.where("k > 1")


def batched(multi: DataFrame, cap: int = 4096) -> DataFrame:
    """With batch: clusters of a bin in (code, cid) order, cap to a batch; batches don't span bins."""
    w = W.partitionBy("qid", "bin").orderBy("code", "cid")
    return multi.withColumn("batch", F.floor((F.row_number().over(w) - 1) / cap).cast("int"))


def spans(probes: DataFrame, clusters: DataFrame) -> DataFrame:
    """qid, bin, start, stop: the ranges of global cluster numbers (by code, cid) that the probed buckets cover.

    Numbers come from a running sum over one row a bucket."""
    k = clusters.groupBy("code").agg(F.count("*").alias("k"))
    at = k.select("code", (F.sum("k").over(W.orderBy("code")) - F.col("k")).alias("start"), F.sum("k").over(W.orderBy("code")).alias("stop"))
    return probes.select("qid", "bin", "code").join(at, "code").select("qid", "bin", "start", "stop")


def merged_spans(ranges: DataFrame, cap: int = 0) -> DataFrame:
    """The ranges with adjacent and overlapping ones of a query's bin joined; with a cap, cut into pieces of so many numbers at most."""
    w = W.partitionBy("qid", "bin").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(w)
    out = ranges.withColumn("before", before).withColumn("island", island).groupBy("qid", "bin", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
    if cap <= 0:
        return out
    cut = out.where("start < stop").withColumn("_at", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(cap).cast("bigint"))))
    return cut.select("qid", "bin", F.col("_at").alias("start"), F.least(F.col("_at") + cap, "stop").alias("stop"))


def span_batches(lengths: list[int], cap: int) -> list[int]:
    """Sizes of the batches of a bin, from the lengths of its spans in order: a span that doesn't fit the room left starts a batch, one
    over the cap is cut."""
    out: list[int] = []
    room = 0
    for n in lengths:
        if n <= room:
            out[-1] += n
            room -= n
            continue
        while n > 0:
            out.append(min(n, cap))
            n -= out[-1]
        room = cap - out[-1] if out else 0
    return out


def gated(multi: DataFrame, curve: DataFrame | None, cap: int = 4096) -> DataFrame:
    """Clusters whose distance is at most the best so far (their own batch included) plus the curve's margin there; without a curve all."""
    if curve is None:
        return multi
    b = batched(multi, cap).withColumn("_o", F.struct("bin", "batch"))
    best = F.min("d2").over(W.partitionBy("qid").orderBy("_o").rangeBetween(W.unboundedPreceding, W.currentRow))
    pts = curve.agg(F.array_sort(F.collect_list(F.struct(F.col("knot"), F.col("y")))).alias("curve"))
    j = b.withColumn("best", best).crossJoin(F.broadcast(pts))
    return j.where(F.col("d2") <= F.col("best") + interpolated(F.col("curve"), F.col("best"))).drop("_o", "best", "batch", "curve")


def top_clusters(found: DataFrame, k_c: int) -> DataFrame:
    """The k_c nearest clusters of each query, ranked; ties by (code, cid)."""
    w = W.partitionBy("qid").orderBy("d2", "code", "cid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_c)


def candidates(direct: DataFrame, chosen: DataFrame) -> DataFrame:
    """qid, code, cid, src: direct clusters and chosen ones; no cluster is in both."""
    return direct.select("qid", "code", "cid", F.lit("direct").alias("src")).unionByName(chosen.select("qid", "code", "cid", F.lit("centroid").alias("src")))


def select_band(found: DataFrame, top_m: int = -1, threshold: float = -1, delta: float = -1, y_max: float = float("inf"), cap: int = 0) -> DataFrame:
    """The nearest top_m under a threshold, and all within delta of the best (y_max at most), up to cap; negative: off. Nothing on: the best alone."""
    w = W.partitionBy("qid")
    f = found.withColumn("_r", F.row_number().over(w.orderBy("d2", "code", "cid"))).withColumn("_b", F.min("d2").over(w))
    none: Column = F.lit(False)
    top = none if top_m < 0 else (F.col("_r") <= top_m) & (none | (F.col("d2") <= threshold) if threshold >= 0 else F.lit(True))
    band = none if delta < 0 else F.col("d2") <= F.least(F.col("_b") + delta, F.lit(y_max))
    f = f.where(F.col("_r") == 1) if top_m < 0 and delta < 0 else f.withColumn("_t", top).where(F.col("_t") | band)
    if cap > 0 and "_t" in f.columns:
        f = f.withColumn("_c", F.row_number().over(w.orderBy(F.desc("_t"), "code", "cid"))).where(F.col("_c") <= cap).drop("_c")
    return f.drop("_r", "_b", "_t")


@dataclass(frozen=True)
class EarlyStop:
    """Stop once the heap is full, min_bins bins were seen and `patience` batches in a row were poor.

    A batch is poor if it updates nothing; with eps_updates > 0 if at most that share of it updates; with front_ratio or front_updates > 0 if
    few of its distances lie at the front, within front_alpha of the worst kept. under_ratio > 0 (the other mode): if at most that share
    lies under the curve."""

    enabled: bool = True
    min_bins: int = 4
    patience: int = 3
    eps_updates: float = 0.0
    front_alpha: float = 0.7
    front_ratio: float = 0.0
    front_updates: int = 0
    under_ratio: float = 0.0


def fold(rows: pd.DataFrame, k_c: int, cap: int, stop: EarlyStop, curve: list[tuple[float, float]] | None) -> tuple[list[tuple[float, int, int]], dict]:
    """One query's clusters, sorted by (bin, code, cid), pushed batch by batch into the nearest k_c; what is kept, and counts of the run."""
    heap: list[tuple[float, int, int]] = []
    kept = lambda: sorted((-d, -c, -i) for d, c, i in heap)
    stats = {"batches": 0, "bins": 0, "seen": 0, "updates": 0, "rejects": 0, "gated": 0, "stopped": False}
    best, poor = float("inf"), 0
    knots = np.array([c[0] for c in curve]) if curve else None
    ys = np.array([c[1] for c in curve]) if curve else None
    for _, of_bin in rows.groupby("bin", sort=True):
        stats["bins"] += 1
        d, code, cid = of_bin["d2"].to_numpy(), of_bin["code"].to_numpy(), of_bin["cid"].to_numpy()
        sizes = span_batches(of_bin.groupby("code", sort=True).size().tolist(), cap)
        for at, size in zip(np.cumsum(sizes) - sizes, sizes):
            part = d[at : at + size]
            best = min(best, float(part.min()))
            limit = float("inf") if curve is None else best + max(0.0, float(np.interp(best, knots, ys)))
            updates = front = 0
            for j in range(len(part)):
                if part[j] > limit:
                    stats["gated"] += 1
                    continue
                item = (-float(part[j]), -int(code[at + j]), -int(cid[at + j]))  # the heap's first is the worst kept
                if len(heap) < k_c:
                    heapq.heappush(heap, item)
                else:
                    front += -item[0] <= stop.front_alpha * -heap[0][0]
                    if item <= heap[0]:
                        stats["rejects"] += 1
                        continue
                    heapq.heapreplace(heap, item)
                updates += 1
            stats["batches"] += 1
            stats["seen"] += len(part)
            stats["updates"] += updates
            share = updates / len(part)
            if stop.under_ratio > 0 and curve is not None:
                low = float((part <= limit).mean()) <= stop.under_ratio
            else:
                low = updates == 0 or (stop.eps_updates > 0 and share <= stop.eps_updates)
                low = low or (stop.front_ratio > 0 and front / len(part) <= stop.front_ratio) or (stop.front_updates > 0 and front <= stop.front_updates)
            poor = poor + 1 if low else 0
            if stop.enabled and len(heap) >= k_c and stats["bins"] >= stop.min_bins and poor >= stop.patience:
                stats["stopped"] = True
                return kept(), stats
    return kept(), stats


def early_stop(multi: DataFrame, k_c: int, cap: int = 4096, stop: EarlyStop = EarlyStop(), curve: list[tuple[float, float]] | None = None) -> DataFrame:
    """qid, code, cid, d2, rank, and the run's counts on every row: the exact order-dependent fold, one query to a task's group.

    A group is one query's probed clusters, whose number the mask plan and the cluster policy bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "code", "cid"])
        kept, s = fold(pdf, k_c, cap, stop, curve)
        out = pd.DataFrame(kept, columns=["d2", "code", "cid"])
        return out.assign(qid=pdf["qid"].iloc[0], rank=range(1, len(out) + 1), **s)

    schema = "qid bigint, code bigint, cid int, d2 double, rank int, batches int, bins int, seen int, updates int, rejects int, gated int, stopped boolean"
    return multi.groupBy("qid").applyInPandas(lambda pdf: run(pdf)[[c.strip().split(" ")[0] for c in schema.split(",")]], schema)


def early_stop_stats(result: DataFrame) -> DataFrame:
    """One row over all queries: clusters seen, updates, rejects, and the share that stopped early."""
    each = result.groupBy("qid").agg(*(F.first(c).alias(c) for c in ("batches", "bins", "seen", "updates", "rejects", "gated", "stopped")))
    return each.agg(F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in ("batches", "bins", "seen", "updates", "rejects", "gated")), F.avg(F.col("stopped").cast("int")).alias("stop_rate"))
