"""Hierarchy, budgets, reads by key, metrics of an index, and the tools around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import catalog
from skerry.functions import vectors as V
from skerry.operators import analysis as A
from skerry.operators import search as S
from skerry.plans import index as I
from skerry.plans import tools as T
from skerry.plans.inspect import pushed_filters
from skerry.sources import vectors as R


@pytest.fixture(scope="module")
def base(spark, sf):
    return catalog._base(spark, sf)


@pytest.fixture(scope="module")
def queries(spark, sf):
    return catalog._queries(spark, sf)


def test_hierarchy_and_exact_fallback(base, queries):
    centroids, own = S.coarse_builder(base.drop("cluster_id"), 12, 300)
    assert own.count() == base.count() and own.select("cluster_id").distinct().count() == 12
    with_super, supers = S.super_centroids(centroids, 3)
    assert with_super.count() == 12 and supers.count() == 3 and with_super.filter("super_id is null").isEmpty()
    exact = S.route(queries, centroids, 5, "ip").select("qid", "cluster_id")
    for metric, threshold in (("ip", 100), ("l2", 1)):
        assert S.route_adaptive(queries, centroids, 5, metric, threshold).count() == exact.count()
    two = S.route_adaptive(queries, centroids, 5, "ip", 4, n_super=1).select("qid", "cluster_id")
    assert two.groupBy("qid").count().agg(F.min("count")).first()[0] == 5
    every = S.route_adaptive(queries, centroids, 5, "ip", 4, n_super=3).select("qid", "cluster_id")
    assert every.exceptAll(exact).isEmpty()
    with pytest.raises(ValueError):
        S.train_centroids(base, 10_000)


def test_frontier_thresholds(spark):
    rows = [(1, c, 10 * c + i, float(c * 10 + i), 0.5, 12.0) for c in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "qid long, cluster_rank int, row_id long, est double, margin double, safein_d_k double")
    static = {r["row_id"]: r for r in S.frontier_search(df, 3).collect()}
    assert static[10]["cls"] == "SafeIn" and static[20]["cls"] == "SafeOut" and static[20]["frontier"] == 12.5 and static[20]["safein_frontier"] == 11.5 and static[10]["frontier"] == np.inf
    moving = {r["row_id"]: r["cls"] for r in S.frontier_search(df, 3, "frontier").collect()}
    assert moving[10] == "Uncertain" and moving[20] == "SafeOut"
    with pytest.raises(ValueError):
        S.frontier_search(df, 3, "none")
    counts = S.search_statistics(S.frontier_search(df, 3)).first()
    assert counts["probed"] == 3 and counts["candidates"] == 12 and counts["safeout"] == 8


def test_early_budget_is_a_superset(spark, sf):
    c = catalog._probed(spark, sf).select("qid", "cluster_rank", "row_id", "est")
    early, last = S.early_budget(c, 20, 1).select("qid", "row_id"), S.budget(c, 20).select("qid", "row_id")
    assert last.exceptAll(early).isEmpty() and early.count() > last.count()


def test_reads_by_key_and_ids(spark, base):
    found = S.read_rows(base, spark.createDataFrame([(3,), (8,), (3,)], "row_id long"))
    assert sorted(r["row_id"] for r in found.collect()) == [3, 8] and any("row_id" in f or "vec_id" in f for f in pushed_filters(found))
    with pytest.raises(KeyError):
        S.read_rows(base, spark.createDataFrame([(-5,)], "row_id long"))
    ids = spark.createDataFrame([(100, 0), (200, 1)], "external_id long, row_id long")
    codes = spark.createDataFrame([(7, 200), (7, 100)], "cluster_id int, external_id long")
    assert sorted(tuple(r) for r in S.recover_members(codes, ids).collect()) == [(7, 0), (7, 1)]
    with pytest.raises(KeyError):
        S.recover_members(codes.union(spark.createDataFrame([(7, 300)], codes.schema)), ids)
    truth = spark.createDataFrame([(0, 0, 200), (0, 1, 999)], "qid long, rank int, external_id long")
    assert sorted((r["rank"], r["row_id"]) for r in S.truth_of_ids(truth, ids).collect()) == [(0, 1), (1, None)]


@pytest.mark.parametrize("metric", I.METRICS)
def test_index_metrics(spark, base, queries, tmp_path, metric):
    scaled = base.select("row_id", F.transform("embedding", lambda x: (x * (1 + F.col("row_id") % 3)).cast("float")).alias("embedding"))
    told = []
    index = I.build(scaled, catalog._centroids(base), str(tmp_path / "i"), metric=metric, progress=lambda k, n: told.append((k, n))).preload()
    assert told == [(1, 4), (2, 4), (3, 4), (4, 4)] and I.open_index(spark, str(tmp_path / "i")).metric == metric
    got = index.search(queries, 5, 99, 1.0).select("qid", "rank", "row_id")
    want = S.exact_search(queries, scaled, 5).select("qid", "rank", "row_id")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    first = {r["qid"]: r["cluster_id"] for r in index.route(queries, 1).collect()}
    cent = {r["cluster_id"]: np.array(r["centroid"]) for r in index.centroids.collect()}
    for r in queries.limit(5).collect():
        q = np.array(r["qvec"])
        score = {c: ((q - x) ** 2).sum() if metric == "l2" else -(q @ x) for c, x in cent.items()}
        assert first[r["qid"]] == min(score, key=score.get)
    index.unload()
    with pytest.raises(ValueError):
        I.build(scaled, catalog._centroids(base), str(tmp_path / "j"), metric="none")


def test_tools(spark, base, queries, tmp_path):
    a = I.build(base.drop("cluster_id"), catalog._centroids(base), str(tmp_path / "a"))
    b = T.migrate(a, str(tmp_path / "b"))
    assert T.compare_codes(a, b).first().asDict() == {"n": base.count(), "in_one": 0, "different": 0}
    same = T.compare_estimates(a, b, queries, 3).first()
    assert same["candidates"] > 0 and same["in_one"] == same["different_1"] == same["different_2"] == 0
    c = I.build(base.drop("cluster_id"), catalog._centroids(base), str(tmp_path / "c"), ex_bits=2)
    assert T.compare_codes(a, c).first()["different"] > 0 and T.compare_estimates(a, c, queries, 3).first()["different_2"] > 0
    planes = {r["plane"]: r for r in T.plane_report(a).collect()}
    assert len(planes) == 3 and all(0 < r["ones"] < 1 and 0 < r["entropy"] <= 1 for r in planes.values())
    got = T.threshold_samples(a, queries, 5, 0.9, str(tmp_path / "kth"))
    values = sorted(r["embedding"][0] for r in R.read_vectors(spark, f"{tmp_path}/kth/*.npy").collect())
    assert got["samples"] == len(values) == queries.count() and got["d_k"] == pytest.approx(values[A.low_index(0.9, len(values))], rel=1e-5)
    assert set(T.kernel_seconds(64, 32)) == {"fields", "planes", "tiles"}


def test_benchmark_over_files(spark, base, queries, tmp_path):
    x = np.array([r["embedding"] for r in base.orderBy("row_id").collect()], "<f4")
    np.save(tmp_path / "base.npy", x)
    np.save(tmp_path / "q.npy", x[::50])
    true = ((x[::50, None].astype(float) - x[None]) ** 2).sum(2).argsort(1)[:, :10].astype("<i4")
    (tmp_path / "gt.ivecs").write_bytes(R.vecs_bytes(true, "<i4"))
    told = []
    got = T.benchmark(spark, str(tmp_path / "base.npy"), str(tmp_path / "q.npy"), str(tmp_path / "gt.ivecs"), str(tmp_path / "w"), 8, [2, 8], progress=told.append)
    recall = {r["nprobe"]: r["recall"] for r in got.collect()}
    assert recall[8] > 0.99 and recall[2] < recall[8] and told[-1] == "nprobe 8"


def test_class_rules(spark):
    assert V.epsilon(5.75, 1, 64) == pytest.approx(5.75 * 2**-0.5 / 8)
    df = spark.createDataFrame([(0.5,), (1.0,), (3.0,)], "d double")
    got = df.select(V.classify_fixed(F.col("d"), F.lit(1.5), F.lit(0.25)).alias("a"), V.classify_adaptive(F.col("d"), F.lit(2.0), F.lit(1.0), F.lit(0.5)).alias("b"), V.classify_adaptive(F.col("d"), F.lit(2.0), F.lit(1.0), F.lit(0.5), F.lit(0.1)).alias("c")).collect()
    assert [tuple(r) for r in got] == [("SafeIn", "Uncertain", "SafeIn"), ("Uncertain", "Uncertain", "Uncertain"), ("SafeOut", "SafeOut", "SafeOut")]
