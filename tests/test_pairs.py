"""Folds over every query and every row: nothing of the size of the pairs is written, shuffled or kept, and what they give is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import catalog
from skerry.operators import analysis as A
from skerry.operators import pairs as P
from skerry.operators import search as S
from skerry.plans import index as I
from skerry.plans.inspect import plan_nodes

REPORTS = ["calibration", "budget_early", "geometry", "probe_statistics", "stage2_error", "budget_search", "cluster_classes", "diagnostic_summary", "confusion", "frontier", "grid_replay", "margin_quartiles", "margin_replay", "search_statistics", "space_comparison", "stage1_error", "stage1_classes", "stage2_classes", "candidate_table", "stage_recall", "threshold_report"]


@pytest.mark.parametrize("name", REPORTS)
def test_reports_write_no_pairs(spark, sf, monkeypatch, name):
    """At most some rows a query go to the shared folder, and the pairs themselves are no stage's input."""
    sizes = []
    monkeypatch.setattr(catalog, "shared_folder", lambda s, label: sizes.append(label) or f"/tmp/checkpoints/skerry/test-{np.random.default_rng().integers(1 << 60)}")
    catalog.QUERIES[name](spark, sf).count()
    assert not {"candidates", "calibration"} & set(sizes)


def test_a_task_gives_few_rows_of_its_pairs(spark, sf):
    asks, rows, frame = catalog._asks(spark, sf, catalog._frame(spark, sf)), catalog._base(spark, sf).repartition(2), catalog._frame(spark, sf)
    found = P.run(asks, rows, frame, lambda: P.Smallest(3, 1, lambda b: [(b.true, b.slack, b.true_of)]))
    assert found.count() == 2 * 3 * asks.count()
    got = P.smallest(asks, rows, frame, 3, 1, lambda b: [(b.true, b.slack, b.true_of)]).select("qid", "rank", "row_id")
    assert got.exceptAll(S.exact_search(asks, rows, 3).select("qid", "rank", "row_id")).isEmpty()


def test_copies_of_a_row_tie_by_id():
    """A product gives copies other last digits in other places; the nearest are taken by exact distances."""
    rng = np.random.default_rng(0)
    x, q = np.repeat(rng.normal(size=(1, 64)), 1300, 0), rng.normal(size=(40, 64))
    best, row = S.Best(40, 5, 1, np.int64), rng.permutation(1300)
    for part in np.array_split(np.arange(1300), 7):
        S.offer_nearest(best, np.arange(40), q, row[part], x[part])
    lists, value, rows = best.settled()
    assert (rows.reshape(40, 5) == np.arange(5)).all() and (lists == np.repeat(np.arange(40), 5)).all()
    assert np.allclose(value.reshape(40, 5), ((x[0] - q) ** 2).sum(1)[:, None])


def test_order_statistics_are_exact(spark, sf):
    frame = catalog._frame(spark, sf)
    asks, rows = catalog._asks(spark, sf, frame), catalog._base(spark, sf).repartition(3)
    values = np.sort([r["true"] for r in P.emit(asks, rows, frame, {"true": "double"}, lambda b: {"true": b.true}).collect()])
    (got, rounded) = P.ordered(asks, rows, frame, lambda b: [b.true - 1, np.round(b.true, 1)], [lambda n: [0, 7, n // 2, n - 1], lambda n: [n // 3]])
    assert got.n == len(values) and all(abs(got.at[i] - (values[i] - 1)) < 1e-12 for i in (0, 7, len(values) // 2, len(values) - 1))
    assert abs(got.total - (values - 1).sum()) < 1e-6 and rounded.at[len(values) // 3] == np.sort(np.round(values, 1))[len(values) // 3]


def test_a_place_is_taken_without_gathering_the_rows_before(spark):
    df = spark.range(5000).select((F.hash("id") % 1000).cast("double").alias("v")).repartition(8)
    want = sorted(r["v"] for r in df.collect())
    assert A.at_places(df, "v", [lambda n: 0, lambda n: n // 2, lambda n: n - 1]) == [want[0], want[2500], want[-1]]
    assert A.at_index(df.limit(0), "v", lambda n: 0) == 0.0
    assert A.quantiles(df, "v", [0.25, 0.5]) == pytest.approx([np.quantile(want, 0.25), np.quantile(want, 0.5)])


def test_more_queries_than_a_block_give_the_same_counts(spark, sf, monkeypatch):
    frame = catalog._frame(spark, sf)
    asks, rows = catalog._asks(spark, sf, frame, 4), catalog._base(spark, sf)
    count = lambda: sorted(map(tuple, P.counts(asks, rows, frame, "query", ["n"], lambda b: [b.true < 1.5]).collect()))
    give = lambda: sorted((r["qid"], r["row_id"]) for r in P.emit(asks, rows, frame, {}, lambda b: {}).collect())
    want = count(), give()
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "EMIT_QUERIES", 8)
    monkeypatch.setattr(S, "EMIT_ROWS", 200)
    assert (count(), give()) == want


def test_geometry_has_all_metrics_and_whole_places(spark, sf):
    """A percentile is a value itself, at the whole part of p * (n - 1)."""
    long = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 7.0)], "metric string, v double")
    got = {r["metric"]: tuple(r[c] for c in ("mean", "p50", "p95", "p99", "max")) for r in A.distribution(long).collect()}
    assert got == {"a": (4.0, 2.0, 3.0, 3.0, 10.0), "b": (7.0,) * 5}
    assert {r["metric"] for r in catalog.geometry(spark, sf).collect()} == {"cluster_size", "cluster_rmax", "norm_oc_all", "norm_qc_topn", "margin_factor_topn"}


def test_an_index_is_searched_without_a_table_of_candidates(spark, sf, tmp_path, monkeypatch):
    base, queries = catalog._base(spark, sf), catalog._queries(spark, sf)
    index = I.build(base.drop("cluster_id"), catalog._centroids(base), str(tmp_path / "i"))
    every = index.candidates(queries, 3).join(index.records, "row_id").join(queries, "qid")
    error = F.abs(F.col("est2") - catalog.V.l2sq(F.col("qvec"), F.col("embedding"))) / (2 * F.col("norm_oc") * F.col("norm_qc"))
    want = sorted(r["e"] for r in every.select(error.alias("e")).collect())
    monkeypatch.setattr(I.Index, "candidates", None)
    assert index.error_bound(queries, 3) == pytest.approx(want[-1]) and index.error_bound(queries, 3, 0.5) == pytest.approx(want[(len(want) + 1) // 2 - 1])
    found = index.search(queries, 10, 3, want[-1]).select("qid", "rank", "row_id")
    right = S.ivf_search(queries, index.centroids, S.members(base, index.centroids), 10, 3).select("qid", "rank", "row_id")
    assert found.exceptAll(right).isEmpty() and right.exceptAll(found).isEmpty()


CURVES = ["convergence", "frontier_stability", "convergence_series"]


@pytest.mark.parametrize("name", CURVES)
def test_curves_join_no_rows_to_queries(spark, sf, name):
    nodes = plan_nodes(catalog.QUERIES[name](spark, sf))
    assert not any("Join" in n for n in nodes) and nodes["MapInPandas"] == 1


def test_a_curve_keeps_the_nearest_of_each_step(spark, sf):
    base = catalog._base(spark, sf)
    curve = S.search_curve(catalog._queries(spark, sf), catalog._centroids(base), base, 3, (1, 2, 4, 8))
    assert curve.groupBy("qid", "step").count().agg(F.max("count")).first()[0] == 3 and {r["step"] for r in curve.collect()} == {0, 1, 2, 3}


def test_members_come_with_their_vectors_without_a_join(spark, sf):
    base = catalog._base(spark, sf)
    members = catalog._members(base, catalog._centroids(base))
    assert not any("Join" in n for n in plan_nodes(members)) and members.count() == base.count()
