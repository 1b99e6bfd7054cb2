"""Named queries over the test tables, one or more for each operator, on a small fixed encoder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import vectors as V
from .operators import buckets, calibrate, centroid, cluster, encode, evaluate, quantile, refine, report, route
from .operators.cluster import Policy
from .operators.encode import Layer
from .plans import search, storage
from .plans.search import SearchConfig

BITS, DIM, MAX_SCORE, BINS, ALPHA = 6, 64, 1.0, 8, 0.7
#: Queries are all rows whose id is divisible by EVERY; those halfway between calibrate.
EVERY = 100
POLICY = Policy(min_small=4, min_large=17, target_small=4, target_large=8)
CURVE = ((0.0, 0.05), (0.5, 0.2), (2.0, 0.4))


def linear_weights(model: int = 0) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(((k * 31 + j * (17 + model) + k * j * 7) % 19 - 9) / 9.0 for j in range(DIM)) for k in range(BITS))


LINEAR = [Layer(linear_weights())]
HIDDEN = 12
MLP = [
    encode.fold_batch_norm(
        Layer(tuple(tuple(((k * 13 + j * 29 + k * j * 5) % 23 - 11) / 11.0 for j in range(DIM)) for k in range(HIDDEN)), tuple(((k * 7) % 5 - 2) / 10 for k in range(HIDDEN)), True),
        [1 + (k % 3) / 10 for k in range(HIDDEN)], [(k % 4) / 20 for k in range(HIDDEN)], [(k % 5) / 25 for k in range(HIDDEN)], [1 + (k % 2) / 2 for k in range(HIDDEN)],
    ),
    Layer(tuple(tuple(((k * 11 + j * 5 + k * j) % 13 - 6) / 6.0 for j in range(HIDDEN)) for k in range(BITS)), tuple((k - 2) / 8 for k in range(BITS))),
]
CONFIG = SearchConfig(bits=BITS, lsel=6, rmax=2, max_score=MAX_SCORE, bins=BINS, alpha=ALPHA, k_c=10, k=10)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Ctx:
    """The tables and index that a query works on; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        self.queries = self.base.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")

    def index(self, policy: Policy | None = None) -> search.Index:
        return search.build(self.base, LINEAR, policy, cut=storage.reliable if policy else lambda df: df)

    def coded_queries(self, ix: search.Index) -> DataFrame:
        return buckets.bucket_codes(ix.encoded_queries(self.queries), ix.thr)

    def prep(self, ix: search.Index) -> DataFrame:
        return route.prepared(ix.encoded_queries(self.queries), ix.thr)

    def probes(self, ix: search.Index) -> DataFrame:
        return search.probed(ix, self.queries, CONFIG)

    def truth(self) -> DataFrame:
        return search.truth(self.queries, self.base, 10)

    def pairs(self, ix: search.Index) -> DataFrame:
        return evaluate.pairs(self.truth(), self.coded_queries(ix), ix.coded)

    def margin_pairs(self, ix: search.Index) -> DataFrame:
        return evaluate.masked_margins(self.pairs(ix), ix.thr).select("qid", "vec_id", F.col("x_query").alias("x"), F.col("dist").alias("y"))

    def curve(self) -> DataFrame:
        return self.spark.sql("select * from values " + ", ".join(f"({k!r}D, {y!r}D)" for k, y in CURVE) + " as t(knot, y)")

    def found(self, ix: search.Index) -> DataFrame:
        return centroid.probed_clusters(self.probes(ix), ix.clusters, ix.encoded_queries(self.queries))

    def needed(self, ix: search.Index) -> DataFrame:
        """One row a query: its best centroid distance x, and the margin y that reaches the clusters of all its true neighbours."""
        best = centroid.singletons(self.found(ix))[1].groupBy("qid").agg(F.min("d2").alias("x"))
        far = evaluate.truth_to_centroid(self.truth(), ix.members, ix.clusters, ix.encoded_queries(self.queries)).groupBy("qid").agg(F.max("d_cent").alias("m"))
        return best.join(far, "qid").select("qid", "x", F.greatest(F.col("m") - F.col("x"), F.lit(0.0)).alias("y"))


def query(f: Callable[[Ctx], DataFrame]) -> Callable[[Ctx], DataFrame]:
    REGISTRY[f.__name__] = lambda spark, sf_dir: f(Ctx(spark, sf_dir))
    return f


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits as SQL engines round doubles: the product with 10**6, to the nearest integer. Spark's own `round` goes by the decimal
    digits that a double is printed with, which differs where these end in an exact half, as those of centroids (nine digits) do."""
    scale = F.lit(1e6)
    return (F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale).alias(name or c)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(r6(c) if c in cols else F.col(c) for c in df.columns))


def _neighbours(c: Ctx, vector: Column) -> DataFrame:
    """vec_id, q, b: each vector and the one of the next id, by an equi-join."""
    v = c.base.select("vec_id", vector.alias("q"))
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("b")), "vec_id")


def _next(c: Ctx, metric: Callable, name: str) -> DataFrame:
    return _neighbours(c, V.doubles(F.col("embedding"))).select("vec_id", r6(metric(F.col("q"), F.col("b")), name))


@query
def l2sq_pairs(c: Ctx) -> DataFrame:
    return _next(c, V.l2sq, "d2")


@query
def dot_pairs(c: Ctx) -> DataFrame:
    return _next(c, V.dot, "ip")


@query
def cosine_distance_pairs(c: Ctx) -> DataFrame:
    return _next(c, V.cosine_distance, "dist")


@query
def l2_normalize(c: Ctx) -> DataFrame:
    u = V.l2_normalize(V.scaled(V.doubles(F.col("embedding")), 3.0))
    return c.base.select("vec_id", F.posexplode(u).alias("k", "u")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("u"))


@query
def scale_unit(c: Ctx) -> DataFrame:
    return c.base.select("vec_id", F.round(V.total(V.scaled(V.doubles(F.col("embedding")), 255.0)), 9).alias("s"))


@query
def u8_l2sq_pairs(c: Ctx) -> DataFrame:
    as_u8 = V.clipped_u8(F.transform(V.doubles(F.col("embedding")), lambda x: (x + F.lit(1.0)) * F.lit(127.5)))
    return _neighbours(c, V.doubles(as_u8)).select("vec_id", V.l2sq(F.col("q"), F.col("b")).cast("bigint").alias("d2"))


@query
def brute_force_top10(c: Ctx) -> DataFrame:
    return rounded(refine.brute_force(c.queries, c.base, 10), "dist")


@query
def brute_force_ip_top10(c: Ctx) -> DataFrame:
    return rounded(refine.brute_force(c.queries, c.base, 10, "ip"), "dist")


@query
def topk_merge(c: Ctx) -> DataFrame:
    halves = [refine.brute_force(c.queries, c.base.where(F.col("vec_id") % 2 == k), 10) for k in (0, 1)]
    return rounded(refine.merged(*halves, k=10).select("qid", "rank", "vec_id", "dist"), "dist")


@query
def knn_same_label_rate(c: Ctx) -> DataFrame:
    t = c.truth().join(c.base.select("vec_id", "label"), "vec_id").join(c.base.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    return t.agg(r6(F.avg((F.col("label") == F.col("own")).cast("int")), "rate"))


@query
def encode_linear(c: Ctx) -> DataFrame:
    e = buckets.exploded(encode.encode(c.base, LINEAR), "vec_id")
    return rounded(e.withColumn("k", F.col("k").cast("bigint")), "x")


@query
def encode_mlp(c: Ctx) -> DataFrame:
    e = buckets.exploded(encode.encode(c.base, MLP), "vec_id")
    return rounded(e.withColumn("k", F.col("k").cast("bigint")), "x")


@query
def encode_mlp_arrow(c: Ctx) -> DataFrame:
    e = buckets.exploded(encode.encode_arrow(c.base, MLP), "vec_id")
    return rounded(e.withColumn("k", F.col("k").cast("bigint")), "x")


@query
def first_rows(c: Ctx) -> DataFrame:
    return encode.first_rows(c.base, 0.1).select("vec_id", "label")


@query
def median_thresholds(c: Ctx) -> DataFrame:
    return c.index().thr.select(F.posexplode("thr").alias("k", "thr")).select(F.col("k").cast("bigint").alias("k"), r6("thr"))


@query
def windowed_thresholds(c: Ctx) -> DataFrame:
    return rounded(buckets.windowed_thresholds(encode.encode(c.base, LINEAR), 100, 4).withColumn("k", F.col("k").cast("bigint")), "thr")


@query
def bucket_codes(c: Ctx) -> DataFrame:
    return c.index().coded.select("vec_id", "code")


@query
def bucket_histogram(c: Ctx) -> DataFrame:
    return c.index().hist


@query
def bucket_balance(c: Ctx) -> DataFrame:
    return buckets.balance(c.index().hist, BITS)


@query
def bucket_balance_dense_p50(c: Ctx) -> DataFrame:
    return buckets.dense_p50(buckets.histogram(c.index().coded), BITS)


@query
def top_buckets(c: Ctx) -> DataFrame:
    return buckets.top_buckets(c.index().hist, 20)


@query
def best_threshold_group(c: Ctx) -> DataFrame:
    e = encode.encode(c.base, LINEAR)
    thr = buckets.windowed_thresholds(e, 100, 4).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "thr"))), lambda s: s["thr"]).alias("thr"))
    coded = e.crossJoin(F.broadcast(thr)).withColumn("code", V.packed_bits(F.col("logits"), F.col("thr")))
    return buckets.best_group(buckets.balance(coded.groupBy("grp", "code").agg(F.count("*").alias("n")), BITS, "grp"))


@query
def posting_lists(c: Ctx) -> DataFrame:
    return buckets.posting_lists(c.index().coded)


@query
def bucket_offsets(c: Ctx) -> DataFrame:
    return buckets.offsets(c.index().hist)


@query
def bucket_stats(c: Ctx) -> DataFrame:
    return buckets.size_stats(c.index().hist)


@query
def bucket_tiers(c: Ctx) -> DataFrame:
    return buckets.tiers(c.index().hist, 3)


@query
def bucket_auto_tiny(c: Ctx) -> DataFrame:
    return buckets.auto_tiny(c.index().hist)


@query
def big_buckets(c: Ctx) -> DataFrame:
    return buckets.big_buckets(c.index().hist, 12)


@query
def query_bit_costs(c: Ctx) -> DataFrame:
    ix = c.index()
    return rounded(route.bit_costs(ix.encoded_queries(c.queries), ix.thr).withColumn("bit", F.col("bit").cast("bigint")), "cost")


@query
def bit_ranks(c: Ctx) -> DataFrame:
    return route.bit_ranks(c.prep(c.index())).select("qid", F.col("bit").cast("bigint").alias("bit"), F.col("rnk").cast("bigint").alias("rnk"))


@query
def mask_plan(c: Ctx) -> DataFrame:
    return route.mask_plan(c.spark, 8, 3).select(F.col("plan_idx").cast("bigint").alias("plan_idx"), "mask")


def _probes_out(p: DataFrame) -> DataFrame:
    return rounded(p.withColumns({k: F.col(k).cast("bigint") for k in ("plan_idx", "bin") if k in p.columns}), "score")


@query
def probe_buckets(c: Ctx) -> DataFrame:
    return _probes_out(c.probes(c.index()).drop("bin"))


@query
def probe_buckets_pruned(c: Ctx) -> DataFrame:
    return rounded(route.probes_pruned(c.prep(c.index()), 2, MAX_SCORE), "score")


@query
def probe_bins(c: Ctx) -> DataFrame:
    return _probes_out(c.probes(c.index()))


@query
def probe_bins_capped(c: Ctx) -> DataFrame:
    return _probes_out(route.capped(c.probes(c.index()), 2))


@query
def probe_bin_sizes(c: Ctx) -> DataFrame:
    ix = c.index()
    return route.bin_sizes(c.probes(ix), ix.hist).withColumn("bin", F.col("bin").cast("bigint"))


@query
def probe_first_bins(c: Ctx) -> DataFrame:
    ix = c.index()
    s = route.bin_sizes(c.probes(ix), ix.hist)
    return s.groupBy("qid").agg(*(F.sum(F.when(F.col("bin") <= k, F.col("n_buckets")).otherwise(0)).alias(f"upto{k}") for k in range(3)))


@query
def probe_big_split(c: Ctx) -> DataFrame:
    ix = c.index()
    return route.classified(c.probes(ix), ix.hist, 12).groupBy("qid", "tag").agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_vectors"))


@query
def sorted_margin_stats(c: Ctx) -> DataFrame:
    ix = c.index()
    s = route.sorted_margin_stats(ix.encoded_queries(c.queries), ix.thr)
    return rounded(s.withColumn("pos", F.col("pos").cast("bigint")), "mean", "p10", "p50", "p90")


@query
def ann_search_top10(c: Ctx) -> DataFrame:
    return rounded(search.search(c.index(), c.queries, CONFIG), "dist")


@query
def ann_candidates_per_query(c: Ctx) -> DataFrame:
    return search.bucket_candidates(c.index(), c.queries, CONFIG).groupBy("qid").agg(F.count("*").alias("n"))


@query
def recall_at_10(c: Ctx) -> DataFrame:
    return search.recall(c.index(), c.queries, CONFIG)


@query
def recall_by_radius(c: Ctx) -> DataFrame:
    ix = c.index()
    each = [search.recall(ix, c.queries, SearchConfig(bits=BITS, lsel=BITS, rmax=r)).select(F.lit(r).cast("bigint").alias("radius"), "recall") for r in (0, 1, 2, 3, 6)]
    return reduce(DataFrame.unionByName, each)


@query
def cluster_k_policy(c: Ctx) -> DataFrame:
    return cluster.with_k(c.index().hist, POLICY).withColumn("k", F.col("k").cast("bigint"))


@query
def kmeans_assign(c: Ctx) -> DataFrame:
    return rounded(c.index(POLICY).members.select("vec_id", "code", F.col("cid").cast("bigint").alias("cid"), "d2"), "d2")


@query
def cluster_centroids(c: Ctx) -> DataFrame:
    return rounded(c.index(POLICY).clusters.select("code", F.col("cid").cast("bigint").alias("cid"), F.posexplode("centroid").alias("d", "x")).withColumn("d", F.col("d").cast("bigint")), "x")


@query
def cluster_quality(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    q = cluster.cluster_quality(ix.members, ix.clusters)
    return rounded(q, *(x for x in q.columns if x not in ("code", "k")))


@query
def cluster_classes(c: Ctx) -> DataFrame:
    return cluster.cluster_classes(cluster.with_k(c.index().hist, POLICY))


@query
def sub_posting_lists(c: Ctx) -> DataFrame:
    return cluster.sub_posting_lists(c.index(POLICY).members).withColumn("cid", F.col("cid").cast("bigint"))


@query
def kmeanspp_clusters(c: Ctx) -> DataFrame:
    return cluster.kmeans_buckets(c.index().coded, POLICY).select("vec_id", "code", "cid", r6("d2"), "retried")


@query
def singleton_split(c: Ctx) -> DataFrame:
    direct, multi = centroid.singletons(c.found(c.index(POLICY)))
    both = direct.select("qid", F.lit("direct").alias("src")).unionByName(multi.select("qid", F.lit("multi").alias("src")))
    return both.groupBy("qid", "src").agg(F.count("*").alias("n"))


def _clusters_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("qid", "code", F.col("cid").cast("bigint").alias("cid"), "d2", *(["rank"] if "rank" in df.columns else [])), "d2")


@query
def centroid_topk(c: Ctx) -> DataFrame:
    return _clusters_out(centroid.top_clusters(centroid.singletons(c.found(c.index(POLICY)))[1], 10))


@query
def centroid_topk_gated(c: Ctx) -> DataFrame:
    return _clusters_out(centroid.top_clusters(centroid.gated(centroid.singletons(c.found(c.index(POLICY)))[1], c.curve()), 10))


@query
def candidate_clusters(c: Ctx) -> DataFrame:
    return search.chosen_clusters(c.index(POLICY), c.queries, CONFIG).withColumn("cid", F.col("cid").cast("bigint"))


@query
def cluster_select_band(c: Ctx) -> DataFrame:
    return _clusters_out(centroid.select_band(c.found(c.index(POLICY)), top_m=3, delta=0.2, cap=5))


@query
def centroid_early_stop(c: Ctx) -> DataFrame:
    return _clusters_out(centroid.early_stop(centroid.singletons(c.found(c.index(POLICY)))[1], 10, 4, centroid.EarlyStop(min_bins=2, patience=2)))


@query
def centroid_early_stop_off(c: Ctx) -> DataFrame:
    return _clusters_out(centroid.early_stop(centroid.singletons(c.found(c.index(POLICY)))[1], 10, 4096, centroid.EarlyStop(enabled=False)))


@query
def early_stop_stats(c: Ctx) -> DataFrame:
    return centroid.early_stop_stats(centroid.early_stop(centroid.singletons(c.found(c.index(POLICY)))[1], 10, 4, centroid.EarlyStop(min_bins=2, patience=2)))


@query
def ann_search_clustered_top10(c: Ctx) -> DataFrame:
    return rounded(search.search_clustered(c.index(POLICY), c.queries, CONFIG), "dist")


@query
def recall_clustered(c: Ctx) -> DataFrame:
    return evaluate.recall(search.search_clustered(c.index(POLICY), c.queries, CONFIG, exclude_self=True), c.truth(), 10)


@query
def gt_hamming_hist(c: Ctx) -> DataFrame:
    return evaluate.hamming_histogram(c.pairs(c.index()), BITS)


def _flips(c: Ctx) -> DataFrame:
    ix = c.index()
    return evaluate.flip_ranks(c.pairs(ix), route.bit_ranks(c.prep(ix)))


@query
def gt_flip_rank(c: Ctx) -> DataFrame:
    return rounded(_flips(c).withColumn("rnk", F.col("rnk").cast("bigint")), "share")


@query
def gt_flip_rank_summary(c: Ctx) -> DataFrame:
    return rounded(evaluate.flip_rank_summary(_flips(c)), "avg_rank", "top4", "top8")


@query
def masked_margin_pairs(c: Ctx) -> DataFrame:
    ix = c.index()
    return rounded(evaluate.masked_margins(c.pairs(ix), ix.thr), "dist", "x_query", "x_both")


@query
def similar_pairs(c: Ctx) -> DataFrame:
    return rounded(calibrate.similar_pairs(c.base, 50, 4, 0.2, 1.9), "y")


@query
def similar_pairs_capped(c: Ctx) -> DataFrame:
    return rounded(calibrate.similar_pairs(c.base, 50, 4, 0.2, 1.9, 40), "y")


@query
def pair_distance_quantiles(c: Ctx) -> DataFrame:
    q = calibrate.quantile_report(calibrate.similar_pairs(c.base, 50, 4, 1.0), "y")
    return rounded(q, *q.columns)


@query
def deterministic_sample(c: Ctx) -> DataFrame:
    return calibrate.sample(c.base, 50).select("vec_id", "label")


@query
def train_val_split(c: Ctx) -> DataFrame:
    return calibrate.train_val(c.base, 0.9).select("vec_id", "part")


@query
def earlystop_slope(c: Ctx) -> DataFrame:
    return rounded(calibrate.slope(c.margin_pairs(c.index())), "a0")


@query
def earlystop_shift_sweep(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    return rounded(calibrate.shifts(p, p.agg(F.lit(0.5).alias("a0"))), "b")


@query
def earlystop_violation(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    return rounded(calibrate.violations(p, p.agg(F.lit(0.3).alias("a0"), F.lit(0.2).alias("b"))), "rate")


@query
def earlystop_patch(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    return p.select("qid", "vec_id", r6(calibrate.patched(calibrate.in_space(F.col("y")), F.lit(0.4), F.lit(1.5)), "ub"))


@query
def earlystop_shift(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    return p.select("qid", "vec_id", r6(calibrate.bound(calibrate.in_space(F.col("y")), F.lit(0.4), F.lit(0.1)), "ub"))


@query
def earlystop_pick(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    return rounded(calibrate.picked_shift(calibrate.shifts(p, p.agg(F.lit(0.5).alias("a0"))), 0.005), "b")


@query
def margin_curve(c: Ctx) -> DataFrame:
    m = calibrate.margin_curve(c.needed(c.index(POLICY)), 4, cut=storage.reliable)
    return rounded(m, *(x for x in m.columns if x != "n"))


@query
def smax_coverage(c: Ctx) -> DataFrame:
    s = c.margin_pairs(c.index()).select("qid", F.col("x").alias("score"))
    return rounded(calibrate.coverage(s, (0.25, 0.5, 1.0, 2.0)), "pair_cover", "query_cover")


@query
def margin_lookup(c: Ctx) -> DataFrame:
    xs = c.base.select("vec_id", ((F.col("vec_id") - 5) / F.lit(20.0)).alias("x"))
    return rounded(calibrate.margin_lookup(xs, c.curve(), "x", "y"), "margin")


@query
def gt_cluster_distance(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    return rounded(evaluate.truth_to_centroid(c.truth(), ix.members, ix.clusters, ix.encoded_queries(c.queries)), "d_gt", "d_cent")


@query
def gt_linear_fit(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    f = evaluate.linear_fit(evaluate.truth_to_centroid(c.truth(), ix.members, ix.clusters, ix.encoded_queries(c.queries)), "d_gt", "d_cent")
    return rounded(f, "slope", "intercept", "corr", "rmse")


@query
def gt_distance_summary(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    d = evaluate.truth_to_centroid(c.truth(), ix.members, ix.clusters, ix.encoded_queries(c.queries)).where("d_gt > 0")
    return rounded(evaluate.distance_summary(d), "p50", "p90", "p99")


@query
def gt_distance_transform(c: Ctx) -> DataFrame:
    t = c.truth().select("qid", "vec_id", (F.lit(1.0) - F.col("dist") / 2).alias("dist"))
    each = [evaluate.distance_transform(t, how).select("qid", "vec_id", F.lit(how).alias("how"), r6("dist")) for how in ("none", "one_minus", "auto", "two_minus_two_cos", "twice_cosdist")]
    return reduce(DataFrame.unionByName, each)


@query
def model_selection(c: Ctx) -> DataFrame:
    coded = []
    for m in range(3):
        e = encode.encode(c.base, [Layer(linear_weights(m))])
        coded.append(buckets.bucket_codes(e, buckets.thresholds(e), strict=True).select(F.lit(m).cast("bigint").alias("model"), "code"))
    return buckets.best_model(buckets.model_stats(reduce(DataFrame.unionByName, coded), BITS, "model"))


@query
def config_sweep(c: Ctx) -> DataFrame:
    ix, out, asked = c.index(), [], c.queries.count()
    for lsel, rmax in ((4, 1), (6, 1), (6, 2)):
        cfg = SearchConfig(bits=BITS, lsel=lsel, rmax=rmax)
        n = search.bucket_candidates(ix, c.queries, cfg).agg(F.round(F.count("*") / asked, 6).alias("candidates"))
        out.append(search.recall(ix, c.queries, cfg).crossJoin(n).select(F.lit(lsel).cast("bigint").alias("lsel"), F.lit(rmax).cast("bigint").alias("rmax"), "recall", "candidates"))
    return reduce(DataFrame.unionByName, out)


def _batch_pairs(c: Ctx) -> DataFrame:
    """Pairs of different rows within batches of 50, over the whole table: v, w and logits, m."""
    e = calibrate.batches(encode.encode(c.base, LINEAR), 50, 1 << 40).select("batch", "vec_id", V.doubles(F.col("embedding")).alias("v"), "logits")
    return e.join(e.select("batch", F.col("vec_id").alias("j"), F.col("v").alias("w"), F.col("logits").alias("m")), "batch").where("vec_id <> j")


@query
def selective_similarity_loss(c: Ctx) -> DataFrame:
    p = _batch_pairs(c).select(F.sqrt(V.l2sq(F.col("v"), F.col("w"))).alias("s_in"), F.sqrt(V.l2sq(F.col("logits"), F.col("m"))).alias("s_emb"))
    return rounded(encode.selective_similarity_loss(p, 1.3, 0.6, BITS, DIM), "loss")


@query
def selective_similarity_loss_cosine(c: Ctx) -> DataFrame:
    u = lambda x: V.l2_normalize(F.col(x))
    p = _batch_pairs(c).select(V.dot(u("v"), u("w")).alias("s_in"), V.dot(u("logits"), u("m")).alias("s_emb"))
    return rounded(encode.selective_similarity_loss_cosine(p, 0.1, 0.7, 0.9), "loss")


@query
def pairwise_l2_matrix(c: Ctx) -> DataFrame:
    e = calibrate.batches(c.base, 50, 1 << 40).select("batch", "vec_id", V.doubles(F.col("embedding")).alias("v")).withColumn("s", V.dot(F.col("v"), F.col("v")))
    p = e.join(e.select("batch", F.col("vec_id").alias("j"), F.col("v").alias("w"), F.col("s").alias("t")), "batch").where("vec_id < j")
    return p.select("vec_id", "j", r6(V.l2sq_of_norms(F.col("s"), F.col("t"), V.dot(F.col("v"), F.col("w"))), "d2"))


@query
def sample_share(c: Ctx) -> DataFrame:
    return calibrate.sample_share(c.base, 0.05).select("vec_id", "label")


@query
def cluster_sizes(c: Ctx) -> DataFrame:
    s = cluster.cluster_sizes(c.index(POLICY).members)
    return s.select("code", F.col("cid").cast("bigint").alias("cid"), "n", F.col("offset").cast("bigint").alias("offset"))


@query
def bucket_percentiles_dense(c: Ctx) -> DataFrame:
    return buckets.size_percentiles_dense(buckets.histogram(c.index().coded), BITS)


@query
def y_spaces(c: Ctx) -> DataFrame:
    t = c.truth()
    return reduce(DataFrame.unionByName, (t.select("qid", "vec_id", F.lit(s).alias("space"), r6(calibrate.in_space(F.col("dist"), s), "y")) for s in calibrate.Y_SPACES))


@query
def probed_spans(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    m = centroid.merged_spans(centroid.spans(c.probes(ix), ix.clusters))
    return m.select("qid", *(F.col(k).cast("bigint").alias(k) for k in ("bin", "start", "stop")))


@query
def margin_scatter(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index()).withColumn("key", F.col("qid") * 100_000 + F.col("vec_id"))
    return rounded(report.scatter(p, "x", "y", "key", 60), "x", "y")


@query
def margin_summary(c: Ctx) -> DataFrame:
    s = report.summary(c.margin_pairs(c.index()), "x", "y")
    return rounded(s, *s.columns)


@query
def margin_histogram(c: Ctx) -> DataFrame:
    return report.histogram(c.margin_pairs(c.index()), "x", 0.0, 2.0, 16)


@query
def margin_heat_map(c: Ctx) -> DataFrame:
    return report.heat_map(c.margin_pairs(c.index()), "x", "y", (0.0, 2.0, 0.5, 2.0), 8)


@query
def margin_bands(c: Ctx) -> DataFrame:
    p = c.margin_pairs(c.index())
    p = p.withColumn("band", F.floor(F.col("y") * 10))
    return rounded(p.groupBy("band").agg(F.count("*").alias("n")).join(quantile.exact(p, ["band"], F.col("x"), {"p50": 0.5, "p95": 0.95}), "band"), "p50", "p95")


@query
def probed_spans_capped(c: Ctx) -> DataFrame:
    ix = c.index(POLICY)
    m = centroid.merged_spans(centroid.spans(c.probes(ix), ix.clusters), 3)
    return m.select("qid", *(F.col(k).cast("bigint").alias(k) for k in ("bin", "start", "stop")))


_trained: dict[tuple[str, str], tuple[encode.Encoder, float]] = {}
TRAINED_BITS, COVER = 8, 0.95


def trained(c: Ctx, sf_dir: str) -> tuple[search.Index, SearchConfig]:
    """An index of an encoder trained on a bounded sample, and a search whose score limit holds COVER of the calibration queries' true pairs."""
    key = c.spark.sparkContext.applicationId, sf_dir
    if key not in _trained:
        layers = encode.arrow_encoder(search.trained_layers(c.base, TRAINED_BITS, 2048, epochs=15))
        asked = c.base.where(F.col("vec_id") % EVERY == EVERY // 2).select(F.col("vec_id").alias("qid"), "embedding")
        _trained[key] = layers, search.reach(search.build(c.base, layers), asked, 10, COVER)
    layers, limit = _trained[key]
    return search.build(c.base, layers, cut=storage.reliable), SearchConfig(bits=TRAINED_BITS, lsel=TRAINED_BITS, rmax=TRAINED_BITS, max_score=limit, k=10)


def trained_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Ctx(spark, sf_dir)
    return rounded(search.search(*(lambda ix, cfg: (ix, c.queries, cfg))(*trained(c, sf_dir))), "dist")


def trained_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall of the trained search, and the share of all distances that it computes."""
    c = Ctx(spark, sf_dir)
    ix, cfg = trained(c, sf_dir)
    probes, whole = search.probed(ix, c.queries, cfg), c.base.count() * c.queries.count()
    read = probes.join(ix.hist, "code").agg((F.coalesce(F.sum("n"), F.lit(0)) / whole).alias("share"))
    return search.recall(ix, c.queries, cfg).crossJoin(read.select(F.round("share", 6).alias("share")))


REGISTRY["trained_search_top10"] = trained_search_top10
REGISTRY["trained_recall"] = trained_recall
