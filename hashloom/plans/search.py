"""Whole plans: building the index, searching it, measuring it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import literal
from ..operators import buckets, calibrate, centroid, cluster, encode, evaluate, quantile, refine, route
from ..operators.cluster import Policy
from . import storage


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of a search; only what is honoured. lsel is cut to the number of bits once, here."""

    bits: int
    lsel: int = 16
    rmax: int = 7
    max_score: float = float("inf")
    bins: int = 64
    alpha: float = 0.7
    cap_per_bin: int = 0
    k_c: int = 1024
    batch: int = 4096
    k: int = 10
    metric: str = "l2sq"
    stop: centroid.EarlyStop = field(default_factory=lambda: centroid.EarlyStop(enabled=False))

    def __post_init__(self) -> None:
        object.__setattr__(self, "lsel", min(self.lsel, self.bits))
        object.__setattr__(self, "rmax", min(self.rmax, self.lsel))


@dataclass
class Index:
    """What a search reads: vectors, thresholds, coded rows with their vectors, members and clusters (the last two if clustered)."""

    vectors: DataFrame
    layers: list | encode.Encoder
    thr: DataFrame
    coded: DataFrame
    members: DataFrame | None = None
    clusters: DataFrame | None = None

    @property
    def hist(self) -> DataFrame:
        return buckets.histogram(self.coded)

    @property
    def payload(self) -> DataFrame:
        """code, cid, vec_id, embedding: each vector at its place. A written index has it laid out; else vectors are joined to their places."""
        if "embedding" in self.members.columns:
            return self.members
        return self.members.join(self.vectors.select("vec_id", "embedding"), "vec_id")

    def encoded_queries(self, queries: DataFrame) -> DataFrame:
        return encoded(queries, self.layers)

    def write(self, path: str, partitions: int = 200) -> str:
        """The index as tables laid out by bucket, vectors next to their places: a probe prunes files by statistics of `code`. Tables go to a
        folder of their own, and the file CURRENT is switched to it at once when all are there, so readers see the old index or the new one.
        Returns the folder."""
        spark = self.vectors.sparkSession
        folder = f"{path}/index-{uuid.uuid4().hex}"
        self.vectors.write.parquet(f"{folder}/vectors")
        self.thr.write.parquet(f"{folder}/thresholds")
        if isinstance(self.layers, list):
            layers = json.dumps([asdict(x) for x in self.layers])
            spark.sql("select :layers as layers", args={"layers": layers}).write.parquet(f"{folder}/encoder")
        for name, df in (("coded", self.coded), ("members", None if self.members is None else self.payload), ("clusters", self.clusters)):
            if df is not None:
                keys = ["code"] + (["cid"] if "cid" in df.columns else [])
                df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.parquet(f"{folder}/{name}")
        storage.switch(spark, f"{path}/CURRENT", folder)
        return folder

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: encode.Encoder | None = None) -> Index:
        """The index that was last written to `path`, with the rows that came by stream since (see streaming.assign). `encoder`: the caller's
        own, where the index wasn't built from layers."""
        folder = storage.current(spark, f"{path}/CURRENT")
        read = lambda name: spark.read.parquet(f"{folder}/{name}")
        there = lambda name: storage.exists(spark, f"{folder}/{name}")
        layers = encoder
        if layers is None:
            layers = [encode.Layer(tuple(map(tuple, x["weights"])), None if x["bias"] is None else tuple(x["bias"]), x["relu"]) for x in json.loads(read("encoder").first()["layers"])]
        vectors, thr, coded = read("vectors"), settled(read("thresholds")), read("coded")
        members, clusters = (read("members"), read("clusters")) if there("members") else (None, None)
        if there("coded_increment"):
            more = read("coded_increment").drop("batch")
            vectors = vectors.unionByName(more.select(*vectors.columns))
            if members is not None:
                of_bucket = clusters.groupBy("code").agg(F.count("*").alias("_k"))
                known = more.join(of_bucket, "code", "left_semi")
                placed = cluster.nearest(known, clusters).join(more.select("vec_id", "embedding"), "vec_id")
                members = members.unionByName(placed.select(*members.columns))
            coded = coded.unionByName(more.select(*coded.columns))
        return cls(vectors, layers, thr, coded, members, clusters)


def settled(thr: DataFrame) -> DataFrame:
    """The one row of thresholds as literals, so that no plan computes them again. Its size is the number of bits."""
    values = thr.first()["thr"]
    return thr.sparkSession.range(1).select(literal(values).alias("thr"))


def encoded(df: DataFrame, layers: list | encode.Encoder) -> DataFrame:
    """The frame with logits, by layers or by an encoder of the caller's own."""
    return layers(df) if callable(layers) else encode.encode(df, layers)


def build(vectors: DataFrame, layers: list | encode.Encoder, policy: Policy | None = None, rounds: int = 2, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Index:
    """The index; thresholds are computed at once. On large tables pass `storage.reliable` as `cut`: coded rows and each pass of centroids are then computed
    once and kept, where they would be computed again for every use."""
    rows = encoded(vectors, layers)
    thr = settled(buckets.thresholds(rows))
    coded = cut(buckets.bucket_codes(rows, thr))
    members, clusters = (None, None) if policy is None else cluster.lloyd(coded, policy, rounds, cut=cut)
    return Index(vectors, layers, thr, coded, members, clusters)


def probed(index: Index, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """qid, plan_idx, code, score, bin of the buckets to read."""
    prep = route.prepared(index.encoded_queries(queries), index.thr, cfg.lsel)
    p = route.probes(prep, route.mask_plan(queries.sparkSession, cfg.lsel, cfg.rmax), cfg.max_score)
    return route.capped(route.binned(p, cfg.max_score, cfg.bins, cfg.alpha), cfg.cap_per_bin)


def bucket_candidates(index: Index, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    return probed(index, queries, cfg).select("qid", "code").join(index.coded.select("code", "vec_id"), "code").select("qid", "vec_id")


def search(index: Index, queries: DataFrame, cfg: SearchConfig, exclude_self: bool = False) -> DataFrame:
    """qid, rank, vec_id, dist: probe, read the buckets, rank by exact distance."""
    return refine.refined(probed(index, queries, cfg), index.coded, queries, ["code"], cfg.k, cfg.metric, exclude_self)


def chosen_clusters(index: Index, queries: DataFrame, cfg: SearchConfig, curve: DataFrame | None = None) -> DataFrame:
    """qid, code, cid, src. With early stop on, the order-dependent fold runs; else the choice is one relational plan."""
    found = centroid.probed_clusters(probed(index, queries, cfg), index.clusters, index.encoded_queries(queries))
    direct, multi = centroid.singletons(found)
    if cfg.stop.enabled:
        knots = None if curve is None else [(r["knot"], r["y"]) for r in curve.orderBy("knot").collect()]  # a curve has few knots
        picked = centroid.early_stop(multi, cfg.k_c, cfg.batch, cfg.stop, knots)
    else:
        picked = centroid.top_clusters(centroid.gated(multi, curve, cfg.batch), cfg.k_c)
    return centroid.candidates(direct, picked)


def search_clustered(index: Index, queries: DataFrame, cfg: SearchConfig, curve: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    chosen = chosen_clusters(index, queries, cfg, curve)
    return refine.refined(chosen, index.payload, queries, ["code", "cid"], cfg.k, cfg.metric, exclude_self)


def truth(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact nearest k; with exclude_self a query drawn from the table isn't its own neighbour."""
    got = refine.brute_force(queries, vectors, k + int(exclude_self))
    return refine.top_k(got.where("qid <> vec_id").drop("rank"), k) if exclude_self else got


def recall(index: Index, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    return evaluate.recall(search(index, queries, cfg, exclude_self=True), truth(queries, index.vectors, cfg.k), cfg.k)


def trained_layers(vectors: DataFrame, bits: int, rows: int = 4096, **more) -> list[encode.Layer]:
    """The best encoder fitted on a fixed sample of at most `rows` vectors (all that reaches the driver)."""
    got = calibrate.sample(vectors.select("vec_id", "embedding"), rows).collect()
    return encode.train(np.array([r["embedding"] for r in sorted(got, key=lambda r: r["vec_id"])], np.float64), bits, **more)[0][1]


def reach(index: Index, queries: DataFrame, k: int, cover: float) -> float:
    """The score limit under which the share `cover` of the queries' true pairs lies: for choosing max_score on calibration queries."""
    coded = buckets.bucket_codes(index.encoded_queries(queries), index.thr)
    pairs = evaluate.pairs(truth(queries, index.vectors, k), coded, index.coded)
    got = quantile.one_row(evaluate.masked_margins(pairs, index.thr), F.col("x_query"), {"x": cover}).first()
    return float(got["x"]) if got and got["x"] is not None else float("inf")
