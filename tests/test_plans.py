"""Shapes of plans that matter at scale."""

import re

from hashloom.operators import refine, route
from hashloom.plans import search
from hashloom.queries import CONFIG, POLICY, Ctx

from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_exchange(spark):
    c = Ctx(spark, SMALL)
    p = plan(refine.brute_force(c.queries, c.base, 10))
    assert p.index("WindowGroupLimit") >= 0 and p.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" in p


def test_scans_read_only_the_columns_in_use(spark):
    c = Ctx(spark, SMALL)
    p = plan(search.bucket_candidates(c.index(), c.queries, CONFIG))
    assert "label" not in "".join(re.findall(r"ReadSchema: \S+", p))
    assert "embedding" in p and "PushedFilters: [IsNotNull(vec_id)]" in p


def test_probing_is_an_equi_join(spark):
    c = Ctx(spark, SMALL)
    p = plan(search.bucket_candidates(c.index(), c.queries, CONFIG))
    assert re.search(r"(SortMergeJoin|HashJoin) \[code", p)


def test_scores_are_limited_before_the_buckets_are_read(spark):
    c = Ctx(spark, SMALL)
    ix = c.index()
    p = plan(route.probes(c.prep(ix), route.mask_plan(spark, 6, 2), 1.0))
    assert "Filter" in p and "<= 1.0" in p


def test_written_index_prunes_by_bucket(spark, tmp_path):
    ix = Ctx(spark, SMALL).index(POLICY)
    p = plan(spark.read.parquet(ix.write(str(tmp_path / "ix"), 8) + "/members").where("code = 5").select("vec_id"))
    assert "EqualTo(code,5)" in p and "ReadSchema: struct<vec_id:bigint,code:bigint>" in p


def test_no_vector_moves_after_the_distances(spark):
    c = Ctx(spark, SMALL)
    for found in (search.search(c.index(), c.queries, CONFIG), search.search_clustered(c.index(POLICY), c.queries, CONFIG)):
        p = plan(found)
        top = p[: p.index("Join")]  # above the join with the payload
        assert "hashpartitioning(qid" in top and "WindowGroupLimit" in top and "embedding" not in top.split("hashpartitioning(qid")[1].split("Project")[0]


def test_the_nearest_centroid_is_found_within_the_row(spark):
    from hashloom.operators import cluster

    ix = Ctx(spark, SMALL).index(POLICY)
    sized = ix.coded.select("vec_id", "code", "logits").selectExpr("*", "1 as parts")
    p = plan(cluster._nearest(sized, ix.clusters))
    top = p[: p.index("Join")]
    assert "Exchange" not in top and "Aggregate" not in top and "SortAggregate" not in p


def test_thresholds_need_no_exact_percentile(spark, monkeypatch):
    from hashloom.operators import buckets, calibrate, encode, quantile
    from hashloom.queries import LINEAR

    c = Ctx(spark, SMALL)
    small = buckets.thresholds(encode.encode(c.base, LINEAR)).first()
    monkeypatch.setattr(quantile, "SMALL", 400)  # the table has 500 rows
    assert buckets.thresholds(encode.encode(c.base, LINEAR)).first() == small
    p = plan(buckets.thresholds(encode.encode(c.base, LINEAR)))
    assert "percentile(" not in p and "percentile_approx(" in p
    needed = spark.range(100).selectExpr("id as qid", "cast(id as double) as x", "cast(id as double) as y")
    p = plan(calibrate.margin_curve(needed, 4))
    assert not re.search(r"\bntile\(", p) and "percentile(" not in p
