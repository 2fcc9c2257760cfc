"""All queries of the library by name, with the SQL that they are held against.

Searches take every row whose id is divisible by 20 as a query, against all rows. Clusters are the table's labels, centroids their means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skerry.functions import codes as C
from skerry.functions import vectors as V
from skerry.operators import analysis as A
from skerry.operators import pairs as P
from skerry.operators import search as S
from skerry.plans import index as I
from skerry.sources.scratch import shared_folder
from skerry.streaming.ingest import tumbling

#: NPROBE is the least number of the ten clusters that finds nine of ten true neighbours; tests hold index_search and ivf_search to that.
K, NPROBE, EVERY, HEADROOM = 10, 8, 20, 1.25
DIM, EX_BITS = 64, 3
ROTATION = C.Rotation(DIM)
SCALE = C.scale_for(DIM, EX_BITS)
FLAGSHIP = "ivf_search"
PROBES, FRONTIER_PROBES, GRID = (1, 2, 4, 8), 4, ((0.25, 0.5, 0.9), (0.1, 0.5, 0.9))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("cluster_id"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _base(spark, sf).filter(f"row_id % {EVERY} = 0").select(F.col("row_id").alias("qid"), V.as_double(F.col("embedding")).alias("qvec"))


def _centroids(base: DataFrame) -> DataFrame:
    """The mean vector of each label."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(V.as_double(F.col("embedding")))))
    return base.groupBy("cluster_id").agg(mean.alias("centroid"))


def _members(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every row in the cluster of its nearest centroid, with its vector."""
    return S.members(S.spread(base), centroids)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 5) for c in columns})


def exact_search(spark, sf):
    return _rounded(S.exact_search(_queries(spark, sf), _base(spark, sf), K), "dist")


def exact_search_ip(spark, sf):
    return _rounded(S.exact_search(_queries(spark, sf), _base(spark, sf), K, "ip"), "dist")


def _found(spark, sf):
    base = _base(spark, sf)
    cent = _centroids(base)
    return S.ivf_search(_queries(spark, sf), cent, _members(base, cent), K, NPROBE)


def ivf_search(spark, sf):
    """Search with payload: the documents' columns are joined to the final rows alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "lang", "source")
    return _rounded(S.with_payload(_found(spark, sf), docs), "dist").select("qid", "rank", "row_id", "dist", "lang", "source")


def route(spark, sf):
    return _rounded(S.route(_queries(spark, sf), _centroids(_base(spark, sf)), NPROBE), "score").select("qid", "cluster_id", "cluster_rank", "score")


def route_two_level(spark, sf):
    cent = _centroids(_base(spark, sf)).withColumn("super_id", F.col("cluster_id") % 3)
    means = cent.select("super_id", F.posexplode("centroid").alias("i", "x")).groupBy("super_id", "i").agg(F.avg("x").alias("m"))
    supers = means.groupBy("super_id").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("a")).select("super_id", F.col("a.m").alias("super_centroid"))
    return _rounded(S.route_two_level(_queries(spark, sf), cent, supers, NPROBE, 2), "score").select("qid", "cluster_id", "cluster_rank", "score")


def assign(spark, sf):
    base = _base(spark, sf)
    return _rounded(S.assign(base.drop("cluster_id"), _centroids(base)), "norm")


def cluster_report(spark, sf):
    base = _base(spark, sf)
    own = base.join(F.broadcast(_centroids(base)), "cluster_id").withColumn("norm", V.norm(V.residual(F.col("embedding"), F.col("centroid"))))
    out = own.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("norm").alias("r_max"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"))
    return _rounded(out, "r_max", "mean_norm", "std_norm")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Some rows a query, written once and read again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _frame(spark, sf) -> P.Frame:
    return P.Frame(*S.centroid_table(_centroids(_base(spark, sf))), ROTATION, EX_BITS, SCALE)


def _centroid_rows(spark, frame: P.Frame) -> DataFrame:
    return spark.createDataFrame([(int(i), c.tolist()) for i, c in zip(frame.ids, frame.centroids, strict=True)], "cluster_id int, centroid array<double>")


def _calibrated(spark, sf) -> P.Frame:
    """The thresholds and error bounds from rows that are no queries: of all their distances and stage-2 estimates, and of the errors within their own cluster."""
    rows, frame = S.spread(_base(spark, sf)), _frame(spark, sf)
    sampled = _base(spark, sf).filter(f"row_id % {EVERY} = {EVERY // 2}").select(F.col("row_id").alias("qid"), V.as_double(F.col("embedding")).alias("qvec"), F.array("cluster_id").alias("probes"))
    best = P.smallest(sampled.drop("probes"), rows, frame, K + 1, 2, lambda b: [(b.true, b.slack, b.true_of), (b.est2, b.slack2, b.est2_of)])
    kth = _kept(best.filter(F.col("rank") == K + 1).select("kind", F.col("value").alias("kth")), "thresholds")
    d_k, safein_d_k = (A.calibrate_d_k(kth.filter(F.col("kind") == kind), 0.9) for kind in (0, 1))

    def errors(b: P.Block) -> list[np.ndarray]:
        near = (b.true >= 0.1 * d_k) & (b.true <= 10 * d_k) & (b.norms > 0)
        return [(np.abs(e - b.true)[near]) / (2 * b.norms[near]) for e in (b.est, b.est2)]

    at = lambda n: [A.upper_index(0.9, n)] if n else []
    eps, eps2 = (next(iter(e.at.values()), 0.0) for e in P.ordered(sampled, rows, frame, errors, [at, at]))
    return replace(frame, d_k=d_k, safein_d_k=safein_d_k, eps=eps, eps2=eps2)


def _asks(spark, sf, frame: P.Frame, nprobe: int = 0, truth: bool = False) -> DataFrame:
    """The queries with their first ``nprobe`` clusters in probe order (0: none are named, and all are met), and with the ids of their K nearest rows."""
    out = queries = _queries(spark, sf)
    if nprobe:
        ranks = S.route(queries, _centroid_rows(spark, frame), nprobe, nlist=len(frame.ids))
        out = out.join(ranks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("cluster_rank", "cluster_id"))).alias("p")).select("qid", F.col("p.cluster_id").alias("probes")), "qid")
    if truth:
        near = S.exact_search(queries, _base(spark, sf), K).groupBy("qid").agg(F.collect_list("row_id").alias("truth"))
        out = out.join(near, "qid")
    return out


def _report(spark, sf, nprobe: int = 0, truth: bool = True) -> tuple[DataFrame, DataFrame, P.Frame]:
    """What a fold over every query and every row takes, calibrated."""
    frame = _calibrated(spark, sf)
    return _asks(spark, sf, frame, nprobe, truth), S.spread(_base(spark, sf)), frame


def _candidates(spark, sf, nprobe: int = 0) -> DataFrame:
    """Every query against every row, or those of its first clusters, with calibrated thresholds and margins, and whether the row is one of the K nearest."""
    return _emitted(*_report(spark, sf, nprobe), nprobe > 0, False)


def _emitted(asks: DataFrame, rows: DataFrame, frame: P.Frame, ranked: bool, frontier: bool) -> DataFrame:
    kinds = {"cluster_id": "int"} | {c: "double" for c in ("norm_oc", "norm_qc", "est", "est2", "true")} | {"is_true": "boolean"} | ({"cluster_rank": "int"} if ranked else {}) | ({"frontier": "double"} if frontier else {})

    def of(b: P.Block) -> dict[str, np.ndarray]:
        out = {"cluster_id": frame.ids[b.cluster], "norm_oc": b.oc[:, None], "norm_qc": b.size, "est": b.est, "est2": b.est2, "true": b.true, "is_true": b.is_true}
        return out | ({"cluster_rank": b.slot + 1} if ranked else {}) | ({"frontier": P.before(b)} if frontier else {})

    norms = F.col("norm_oc") * F.col("norm_qc")
    return P.emit(asks, rows, frame, kinds, of).withColumns({"margin": norms * frame.eps, "margin2": norms * frame.eps2, "d_k": F.lit(frame.d_k), "safein_d_k": F.lit(frame.safein_d_k)})


COUNTED = ("safein", "safeout", "uncertain", "false_safein", "false_safeout")


def _counted(cls: np.ndarray, b: P.Block) -> list[np.ndarray]:
    """Conditions of COUNTED."""
    return [*(cls == k for k in range(3)), (cls == 0) & ~b.is_true, (cls == 1) & b.is_true]


def _unfolded(counts: DataFrame, key: str, rows: dict, names: tuple[str, ...]) -> DataFrame:
    """One row for each of ``rows``, a value of ``key`` and the prefix of its columns."""
    every = F.array(*(F.struct(v.alias(key), *(F.col(f"{prefix}{n}").alias(n) for n in names)) for prefix, v in rows.items()))
    return counts.select(*(c for c in counts.columns if c == "qid"), F.explode(every).alias("x")).select(*(c for c in counts.columns if c == "qid"), "x.*")


def stage1_classes(spark, sf):
    return P.counts(*_report(spark, sf), "query", COUNTED, lambda b: _counted(b.cls, b))


def _error(spark, sf, estimate: Callable[[P.Block], np.ndarray]) -> DataFrame:
    def errors(b: P.Block) -> list[np.ndarray]:
        e, some = np.abs(estimate(b) - b.true), b.true > 1e-8
        return [e, e[some] / b.true[some]]

    e, rel = P.ordered(*_report(spark, sf, truth=False), errors, [P.quantile_places(0.95, 0.99), None])
    row = (e.total / e.n if e.n else None, rel.total / rel.n if rel.n else None, e.quantile(0.95), e.quantile(0.99))
    return _rounded(spark.createDataFrame([row], "mae double, mean_rel double, p95 double, p99 double"), "mae", "mean_rel", "p95", "p99")


def stage1_error(spark, sf):
    return _error(spark, sf, lambda b: b.est)


def budget_search(spark, sf):
    """The 50 best estimates of the probed clusters, reranked."""
    kept = P.smallest(*_report(spark, sf, FRONTIER_PROBES, False), 50, 1, lambda b: [(b.est, 0.0, None)], columns={"true": lambda b, r, c: b.true_of(r, c)})
    return _rounded(S.top_per(kept.drop("rank"), "qid", K, "true", "row_id").select("qid", "rank", "row_id", F.col("true").alias("dist")), "dist")


def budget_early(spark, sf):
    """What a budget of 50 hands out when its best are emitted after every second cluster. The best of each two clusters hold the best of all up to them."""
    best = P.smallest(*_report(spark, sf, FRONTIER_PROBES, False), 50, 1, lambda b: [(b.est, 0.0, None)], lists=lambda slot: slot // 2, of_lists=-(-FRONTIER_PROBES // 2))
    return S.early_budget(best.select("qid", (F.col("slot") + 1).alias("cluster_rank"), "row_id", F.col("value").alias("est")), 50, 2).select("qid", "row_id", "emitted")


def rows_by_key(spark, sf):
    """A batch read by key: the rows of the keys that are divisible by 7."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return S.read_rows(c, c.filter("c_custkey % 7 = 0").select("c_custkey"), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


def decoded(spark, sf):
    """Each document's source by way of its code in the dictionary; codes past the end decode to an empty string."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    codes = A.dictionary(docs, "source", "doc_id")
    coded = docs.join(codes, "source").select("doc_id", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("code")).alias("code"))
    return A.decode(coded, codes, "source").select("doc_id", "source")


def diagnostic_summary(spark, sf):
    """Shares of final classes among the candidates of the probed clusters, and the percentiles of the rounded stage-1 errors from the 50th to the 99.9th."""
    cuts = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}

    def measures(b: P.Block) -> list[np.ndarray]:
        return [np.floor(np.abs(b.est - b.true) * 1e5 + 0.5) / 1e5, *(b.cls2 == k for k in range(3)), b.cls == 2]

    e, *share = P.ordered(*_report(spark, sf, NPROBE, False), measures, [P.quantile_places(*cuts.values()), None, None, None, None])
    names = ["safein", "safeout", "uncertain", "stage2", *cuts]
    row = (e.n, *(x.total / x.n if x.n else None for x in share), *(e.quantile(p) for p in cuts.values()))
    return _rounded(spark.createDataFrame([row], "n long" + "".join(f", {n} double" for n in names)), *names)


def probe_statistics(spark, sf):
    """Stage-1 and final classes of each query's probed clusters."""
    asks, rows, frame = _report(spark, sf, NPROBE, False)
    names = [f"{n}_{x.lower()}" for n in ("s1", "final") for x in P.CLASSES]
    found = P.counts(asks, rows, frame, "probe", names, lambda b: [x == k for x in (b.cls, b.cls2) for k in range(3)])
    return found.join(asks.select("qid", "probes"), "qid").select("qid", F.element_at("probes", F.col("slot") + 1).alias("cluster_id"), *names)


def kmeans_route(spark, sf):
    """Clusters trained by K-means on the first rows, a hierarchy over them, and two-level routing by inner product."""
    base = _base(spark, sf)
    centroids, _ = S.coarse_builder(base.drop("cluster_id"), 16, 400)
    return S.route_adaptive(_queries(spark, sf), centroids, 4, "ip", 8).select("qid", "cluster_id", "cluster_rank", F.round("score", 5).alias("score"))


def recall(spark, sf):
    truth = S.exact_search(_queries(spark, sf), _base(spark, sf), K)
    ids = lambda df, name: df.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "row_id"))).alias("x")).select("qid", F.col("x.row_id").alias(name))
    both = ids(truth, "gt").join(ids(_found(spark, sf), "found"), "qid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    return _rounded(both.select("qid", *(V.recall_at(F.col("found"), F.col("gt"), k).cast("double").alias(f"recall_{k}") for k in (1, 5, 10))), "recall_1", "recall_5", "recall_10")


def calibration(spark, sf):
    """Thresholds and error bounds from sampled rows: from exact distances, from stage-2 estimates, and the errors of both stages."""
    c = _calibrated(spark, sf)
    return _rounded(spark.createDataFrame([(c.d_k, c.safein_d_k, c.eps, c.eps2)], "d_k double, safein_d_k double, eps double, eps2 double"), "d_k", "safein_d_k", "eps", "eps2")


def margin_replay(spark, sf):
    scales = (0.0, 0.5, 1.0, 2.0)
    names = [f"{k}{n}" for k in range(len(scales)) for n in COUNTED]
    found = P.counts(*_report(spark, sf), "all", names, lambda b: [x for s in scales for x in _counted(P.classes(b.est, b.frame, b.margin, s), b)])
    counted = _unfolded(found, "scale", {k: F.lit(s) for k, s in enumerate(scales)}, COUNTED)
    return _rounded(A.replay_rates(counted.filter(F.col("safein") + F.col("safeout") + F.col("uncertain") > 0)), "safein_rate", "false_safein_rate")


def grid_replay(spark, sf):
    """Percentiles of the sampled thresholds against percentiles of the errors."""
    asks, rows, frame = _report(spark, sf)
    kth = _kept(P.smallest(asks, rows, frame, K, 1, lambda b: [(b.est2, b.slack2, b.est2_of)]).filter(F.col("rank") == K).select(F.col("value").alias("kth")), "thresholds")
    d_ks = A.at_places(kth, "kth", [lambda n, p=p: A.upper_index_double(p, n) for p in GRID[0]])
    at = lambda n: [A.upper_index_double(p, n) for p in GRID[1]] if n else []
    (error,) = P.ordered(asks, rows, frame, lambda b: [np.abs(b.est - b.true)[b.norms > 0] / (2 * b.norms[b.norms > 0])], [at])
    grid = [(d, error.at[i]) for d in d_ks for i in at(error.n)]

    def inside(b: P.Block) -> list[np.ndarray]:
        out = []
        for d, eps in grid:
            safein = b.est < d - 2 * (b.norms * eps)
            out += [safein, safein & ~b.is_true, (b.est < d) & ~safein]
        return out

    names = ("safein", "false_safein", "blocked")
    found = P.counts(asks, rows, frame, "query", [f"{k}{n}" for k in range(len(grid)) for n in names], inside)
    per = _unfolded(found, "g", {k: F.struct(F.lit(float(d)).alias("d_k"), F.lit(float(e)).alias("eps")) for k, (d, e) in enumerate(grid)}, names)
    return _rounded(A.grid_totals(per.groupBy("g", "qid").agg(*(F.sum(n).alias(n) for n in names))), "d_k", "eps")


def confusion(spark, sf):
    asks, rows, frame = _report(spark, sf, truth=False)
    both = [(a, z) for a in range(3) for z in range(3)]

    def met(b: P.Block) -> list[np.ndarray]:
        exact = P.classes(b.true, b.frame, b.margin)
        return [(exact == a) & (b.cls == z) for a, z in both]

    found = P.counts(asks, rows, frame, "all", [f"{k}n" for k in range(9)], met)
    counts = _unfolded(found, "both", {k: F.struct(F.lit(P.CLASSES[a]).alias("exact"), F.lit(P.CLASSES[z]).alias("cls")) for k, (a, z) in enumerate(both)}, ("n",))
    return _rounded(A.shares(counts.filter("n > 0").select("both.*", "n"), "exact"), "pct")


def geometry(spark, sf):
    """Sizes and radii of the clusters, norms of all rows, and norms and margin factors of each query's probed clusters."""
    base, frame = _base(spark, sf), _calibrated(spark, sf)
    centroids = _centroid_rows(spark, frame)
    away = lambda v: V.norm(V.residual(F.col(v), F.col("centroid")))
    rows = base.join(F.broadcast(centroids), "cluster_id").select("cluster_id", away("embedding").alias("v"))  # bounded by MAX_CENTROIDS
    clusters = rows.groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"), F.max("v").alias("r"))
    probed = S.route(_queries(spark, sf), centroids, NPROBE, nlist=len(frame.ids)).select(away("qvec").alias("v"))
    metrics = {"cluster_size": clusters.select(F.col("n").alias("v")), "cluster_rmax": clusters.select(F.col("r").alias("v")), "norm_oc_all": rows.select("v"), "norm_qc_topn": probed, "margin_factor_topn": probed.select((2 * F.col("v") * frame.eps).alias("v"))}
    long = reduce(DataFrame.unionByName, (v.select(F.lit(name).alias("metric"), "v") for name, v in metrics.items()))
    return _rounded(A.distribution(_kept(long, "geometry")), "mean", "p50", "p95", "p99", "max")


def convergence(spark, sf):
    """The k-th best exact distance after each further cluster, where there are k candidates."""
    base = _base(spark, sf)
    curve = S.search_curve(_queries(spark, sf), _centroids(base), S.spread(base), K, (1, 2, 3, 4))
    upto = curve.withColumn("probed", F.explode(F.sequence(F.col("step") + 1, F.lit(4))))
    ranked = upto.withColumn("r", F.row_number().over(W.Window.partitionBy("qid", "probed").orderBy("dist", "row_id"))).filter(F.col("r") == K)
    return _rounded(ranked.select("qid", "probed", F.col("dist").alias("kth")), "kth")


def _probed(spark, sf):
    """The candidates of the first FRONTIER_PROBES clusters of each query, in probe order."""
    return _candidates(spark, sf, FRONTIER_PROBES)


def _moving(spark, sf, nprobe: int, truth: bool) -> tuple[DataFrame, DataFrame, DataFrame, P.Frame]:
    """The frontiers before each probe, and what a fold takes with them."""
    asks, rows, frame = _report(spark, sf, nprobe, truth)
    found = _kept(P.frontiers(asks, rows, frame, K, nprobe), "frontiers")
    return found, P.with_frontiers(asks, found), rows, frame


def _named(column: str):
    return F.element_at(F.array(*map(F.lit, P.CLASSES)), F.col(column) + 1)


def _fast_rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To 5 digits, halves away from zero, without the decimal numbers of :func:`_rounded`: for results of every pair."""
    return df.withColumns({c: F.signum(c) * F.floor(F.abs(c) * 1e5 + 0.5) / 1e5 for c in columns})


def frontier(spark, sf):
    """Classes under the moving SafeOut frontier, and the frontiers of upper and of lower bounds before each cluster."""
    _, asks, rows, frame = _moving(spark, sf, FRONTIER_PROBES, False)
    names = ("est", "margin", "frontier", "safein_frontier")
    of = lambda b: {"cluster_rank": b.slot + 1, "cls": P.moving(b), "est": b.est, "margin": b.margin, "frontier": P.before(b), "safein_frontier": P.before(b, "safein_frontier")}
    found = P.emit(asks, rows, frame, {"cluster_rank": "int", "cls": "int"} | {c: "double" for c in names}, of)
    found = found.withColumns({"cls": _named("cls")} | {c: F.when(F.abs(c) != float("inf"), F.col(c)) for c in ("frontier", "safein_frontier")})
    return _fast_rounded(found, *names).select("qid", "cluster_rank", "row_id", "est", "margin", "cls", "frontier", "safein_frontier")


def search_statistics(spark, sf):
    """What a search counts for each query: probes, candidates, classes, rows to read with and without payload, and the last frontier."""
    found, asks, rows, frame = _moving(spark, sf, FRONTIER_PROBES, False)
    names = ("candidates", "safeout", "payload_reads", "vector_reads")
    said = P.counts(asks, rows, frame, "query", names, lambda b: [np.ones(b.shape, bool), *(P.moving(b) == k for k in (1, 0, 2))])
    last = found.groupBy("qid").agg(F.count("*").alias("probed"), F.max_by("frontier", "cluster_rank").alias("last_frontier"))
    return _rounded(said.join(last, "qid").select("qid", "probed", *names, "last_frontier"), "last_frontier")


def space_comparison(spark, sf):
    """SafeIn under the threshold of exact distances and under that of estimates."""

    def inside(b: P.Block) -> list[np.ndarray]:
        exact, estimate = (b.est2 < d - 2 * b.margin2 for d in (b.frame.d_k, b.frame.safein_d_k))
        return [np.ones(b.shape, bool), exact, estimate, exact & ~b.is_true, estimate & ~b.is_true]

    return P.counts(*_report(spark, sf), "query", ["pairs", "safein_exact", "safein_estimate", "false_exact", "false_estimate"], inside).drop("pairs")


def index_search(spark, sf):
    """Builds an index in the shared folder, opens it and searches it under the largest stage-2 error of other sampled queries, with headroom: the nearest rows of the probed clusters, each row being in the cluster of its nearest centroid."""
    base, queries = _base(spark, sf), _queries(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "lang", "source")
    index = I.build(base.select("row_id", "embedding").join(docs, "row_id", "left"), _centroids(base), shared_folder(spark, "index"), EX_BITS)
    sample = base.filter(f"row_id % {EVERY} = {EVERY // 2}").select(F.col("row_id").alias("qid"), V.as_double(F.col("embedding")).alias("qvec"))
    return _rounded(index.search(queries, K, NPROBE, HEADROOM * index.error_bound(sample, NPROBE)), "dist")


def stage2_classes(spark, sf):
    return P.counts(*_report(spark, sf), "query", COUNTED, lambda b: _counted(b.cls2, b))


def stage2_error(spark, sf):
    return _error(spark, sf, lambda b: b.est2)


def stage_recall(spark, sf):
    """The share of the K nearest among the K best by each estimate."""
    best = P.smallest(*_report(spark, sf, truth=False), K, 3, lambda b: [(b.true, b.slack, b.true_of), (b.est, 0.0, None), (b.est2, b.slack2, b.est2_of)])
    met = best.groupBy("qid", "row_id").agg(*(F.max((F.col("kind") == k).cast("double")).alias(f"k{k}") for k in range(3))).filter("k0 = 1")
    return _rounded(met.agg(*(F.avg(f"k{s}").alias(f"recall_stage{s}") for s in (1, 2))), "recall_stage1", "recall_stage2")


def _diagnosed(spark, sf):
    """Classes of both stages of every candidate of the probed clusters, the final class, and the frontier before its cluster."""
    c = F.col
    _, asks, rows, frame = _moving(spark, sf, NPROBE, True)
    out = _emitted(asks, rows, frame, True, True).withColumn("s1_class", V.classify_margin(c("est"), c("d_k"), c("safein_d_k"), c("margin")))
    out = out.withColumn("s2_class", F.when(c("s1_class") == "Uncertain", V.classify_margin(c("est2"), c("d_k"), c("safein_d_k"), c("margin2"))))
    return out.withColumn("cls", F.coalesce("s2_class", "s1_class"))


def candidate_table(spark, sf):
    """The diagnostic fact table: all 28 columns of every candidate of the probed clusters; stage-2 columns are null where stage 1 decided, the dynamic threshold where the frontier was not ready."""
    c = F.col
    two, out = c("s2_class").isNotNull(), _diagnosed(spark, sf)
    out = out.withColumns({"s1": c("est"), "s2": F.when(two, c("est2")), "m1": c("margin"), "m2": F.when(two, c("margin2")), "norms": 2 * c("norm_oc") * c("norm_qc")})
    columns = {f"abs_err_s{k}": F.abs(c(f"s{k}") - c("true")) for k in (1, 2)}
    columns |= {f"normalized_err_s{k}": F.when(c("norms") > 0, F.abs(c(f"s{k}") - c("true")) / c("norms")) for k in (1, 2)}
    columns |= {f"safein_gap_s{k}": c("safein_d_k") - 2 * c(f"m{k}") - c(f"s{k}") for k in (1, 2)}
    columns |= {f"safeout_gap_s{k}": c(f"s{k}") - c("d_k") - 2 * c(f"m{k}") for k in (1, 2)}
    columns |= {f"safein_ratio_s{k}": F.when(c(f"m{k}") > 0, (c("safein_d_k") - c(f"s{k}")) / (2 * c(f"m{k}"))) for k in (1, 2)}
    columns |= {"exact_dist": c("true"), "est_dist_s1": c("s1"), "est_dist_s2": c("s2"), "margin_s1": c("m1"), "margin_s2_current": c("m2"), "d_k_static": c("d_k"), "dynamic_d_k_before_cluster": F.when(c("frontier") != float("inf"), c("frontier"))}
    out = out.withColumns(columns)
    keys = [c("qid").alias("query_id"), "cluster_rank", "cluster_id", c("row_id").alias("vector_row"), c("row_id").alias("vector_external_id"), c("is_true").alias("is_true_topk")]
    numbers = [*columns, "norm_oc", "norm_qc"]
    return _fast_rounded(out.select(*keys, *numbers, "s1_class", "s2_class", c("cls").alias("final_class")), *numbers)


def cluster_classes(spark, sf):
    return P.counts(*_report(spark, sf), "cluster", COUNTED, lambda b: _counted(b.cls2, b))


def threshold_report(spark, sf):
    """Per query: candidates within d_k by exact distance, by each estimate and by both, SafeIn, and the share of exact distances at most d_k."""

    def below(b: P.Block) -> list[np.ndarray]:
        d_k, true = b.frame.d_k, b.true_near(b.frame.d_k)
        return [np.ones(b.shape, bool), true < d_k, b.est < d_k, b.est2 < d_k, (true < d_k) & (b.est2 < d_k), b.est2 < d_k - 2 * b.margin2, true <= d_k]

    names = ["true_below", "est_below", "est2_below", "both_below", "safein"]
    found = P.counts(*_report(spark, sf, truth=False), "query", ["pairs", *names, "within"], below)
    return _rounded(found.select("qid", *names, (F.col("within") / F.col("pairs")).alias("share")), "share")


def margin_quartiles(spark, sf):
    near = P.emit(*_report(spark, sf), {"margin": "double", "cls": "int"}, lambda b: {"margin": b.margin, "cls": b.cls}, lambda b: b.is_true)
    return _rounded(A.quartile_rates(_kept(near, "nearest"), "margin", F.col("cls") == 1), "rate")


def convergence_series(spark, sf):
    return _rounded(A.series(convergence(spark, sf), "probed", "kth"), "mean", "p25", "p75")


def frontier_stability(spark, sf):
    return _rounded(I.frontier_changes(convergence(spark, sf)), "change")


def overlap_curve(spark, sf):
    """Mean share of the K nearest that lie in the first clusters probed."""
    base, queries = _base(spark, sf), _queries(spark, sf)
    truth = S.exact_search(queries, base, K).join(base.select("row_id", "cluster_id"), "row_id")
    probes = S.route(queries, _centroids(base), 4).select("qid", "cluster_id", "cluster_rank")
    met = truth.join(probes, ["qid", "cluster_id"], "left").withColumn("probed", F.explode(F.sequence(F.lit(1), F.lit(4))))
    hit = F.coalesce(F.col("cluster_rank") <= F.col("probed"), F.lit(False))
    return _rounded(met.groupBy("probed").agg(F.avg(hit.cast("double")).alias("overlap")), "overlap")


def routing_overlap(spark, sf):
    """How many of the nearest clusters the two-level routing finds too."""
    exact = S.route(_queries(spark, sf), _centroids(_base(spark, sf)), NPROBE, "ip").select("qid", "cluster_id")
    return A.overlap(exact, route_two_level(spark, sf), ["qid"], "cluster_id")


def nprobe_sweep(spark, sf):
    """Mean recall of the K nearest by the number of clusters probed."""
    base, queries = _base(spark, sf), _queries(spark, sf)
    truth, cent = S.exact_search(queries, base, K).select("qid", "row_id"), _centroids(base)
    curve = S.search_curve(queries, cent, _members(base, cent), K, PROBES)
    upto = curve.withColumn("nprobe", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(PROBES)]))).filter("step <= nprobe.i").withColumn("nprobe", F.col("nprobe.n"))
    found = upto.withColumn("r", F.row_number().over(W.Window.partitionBy("nprobe", "qid").orderBy("dist", "row_id"))).filter(F.col("r") <= K).select("nprobe", "qid", "row_id")
    every = truth.withColumn("nprobe", F.explode(F.array(*[F.lit(n) for n in PROBES])))
    per = A.overlap(every, found, ["nprobe", "qid"], "row_id")
    rate = F.col("shared") / F.col("n")
    return _rounded(per.groupBy("nprobe").agg(F.avg(rate).alias("mean"), F.min(rate).alias("least"), F.max(rate).alias("most"), F.stddev(rate).alias("std")), "mean", "least", "most", "std")


def truth_ids(spark, sf):
    """Every row that is among the K nearest of some query."""
    return S.exact_search(_queries(spark, sf), _base(spark, sf), K).select("row_id").distinct()


def code_symbols(spark, sf):
    """How often each code level occurs, its share, and what it adds to the entropy of a symbol in bits."""
    base = _base(spark, sf)
    unit = V.l2_normalize(V.residual(F.col("embedding"), F.col("centroid")))
    symbols = base.join(F.broadcast(_centroids(base)), "cluster_id").select(F.explode(V.levels(unit, SCALE, EX_BITS)).alias("level"))
    counts = symbols.groupBy("level").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.Window.partitionBy(F.lit(0)))  # 2^(EX_BITS + 1) rows at most
    return _rounded(counts.select("level", "n", share.alias("share"), (-share * F.log2(share)).alias("bits")), "share", "bits")


def label_entropy(spark, sf):
    return _rounded(A.entropy_bits(_base(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"))), "entropy")


def source_dictionary(spark, sf):
    return A.dictionary(spark.read.parquet(f"{sf}/documents.parquet"), "source", "doc_id")


def validation(spark, sf):
    return A.validate(_base(spark, sf))


def normalised(spark, sf):
    b = _base(spark, sf)
    scaled = b.select("row_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return _rounded(scaled.select("row_id", V.norm(F.col("v")).alias("norm"), V.norm(V.l2_normalize(F.col("v"))).alias("unit"), F.size(V.pad_to(F.slice("v", 1, 48))).alias("padded"), V.popcount_total(V.sign_code(F.col("v"))).alias("positive")), "norm", "unit")


def spearman(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return _rounded(A.spearman(c, "c_acctbal", "c_nationkey", "c_custkey"), "rho")


def payload_projection(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", "c_name", "c_acctbal")


def event_windows(spark, sf):
    return _rounded(tumbling(spark.read.parquet(f"{sf}/events.parquet")), "total")


QUERIES = {f.__name__: f for f in (exact_search, exact_search_ip, ivf_search, route, route_two_level, assign, cluster_report, stage1_classes, stage1_error, budget_search, recall, calibration, margin_replay, grid_replay, confusion, geometry, convergence, frontier, search_statistics, space_comparison, index_search, stage2_classes, stage2_error, stage_recall, candidate_table, cluster_classes, threshold_report, margin_quartiles, convergence_series, frontier_stability, overlap_curve, routing_overlap, nprobe_sweep, truth_ids, code_symbols, label_entropy, budget_early, rows_by_key, decoded, diagnostic_summary, probe_statistics, kmeans_route, source_dictionary, validation, normalised, spearman, payload_projection, event_windows)}

_D = "pow(list_distance(qvec, e), 2)"
_TURN = str(ROTATION.apply(np.eye(DIM)).T.tolist())


def _VALUES(numbers) -> str:  # noqa: N802
    return ", ".join(f"({n})" for n in numbers)


def _unit(v: str) -> str:
    return f"list_transform(range(1, 65), lambda i: CASE WHEN list_distance({v}, cent) > 0 THEN ({v}[i] - cent[i]) / list_distance({v}, cent) ELSE 0 END)"


def _low(n: str, share: float = 0.9) -> str:
    return f"least({n} - 1, CAST(floor(CAST(CAST(1 AS FLOAT) - CAST({share} AS FLOAT) AS FLOAT) * CAST({n} AS FLOAT)) AS BIGINT))"


def _up(n: str, share: float = 0.9) -> str:
    return f"CAST(floor(CAST({share} AS FLOAT) * CAST({n} - 1 AS FLOAT)) AS BIGINT)"


_CTE = f"""WITH b AS MATERIALIZED (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS e, label AS cluster_id FROM embeddings),
q AS MATERIALIZED (SELECT row_id AS qid, e AS qvec FROM b WHERE row_id % {EVERY} = 0),
m AS MATERIALIZED (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM b) GROUP BY ALL),
c AS MATERIALIZED (SELECT cluster_id, list(m ORDER BY i) AS cent FROM m GROUP BY cluster_id),
p AS MATERIALIZED (SELECT qid, qvec, cluster_id, pow(list_distance(qvec, cent), 2) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY list_distance(qvec, cent), cluster_id) AS INTEGER) AS cluster_rank FROM q, c),
x AS MATERIALIZED (SELECT qid, row_id, {_D} AS dist FROM q, b),
gt AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row_id) AS INTEGER) AS rank FROM x) WHERE rank <= {K}),
own AS MATERIALIZED (SELECT row_id, cluster_id, e FROM (SELECT row_id, e, c.cluster_id, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(e, cent), c.cluster_id) AS r FROM b, c) WHERE r = 1),
ivf AS MATERIALIZED (SELECT * FROM (SELECT qid, row_id, {_D} AS dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_D}, row_id) AS INTEGER) AS rank FROM p JOIN own USING (cluster_id) WHERE cluster_rank <= {NPROBE}) WHERE rank <= {K}),
rot AS MATERIALIZED (SELECT CAST({_TURN} AS DOUBLE[][]) AS m),
br AS MATERIALIZED (SELECT row_id, cluster_id, e, d AS norm_oc, list_transform(m, lambda w: list_dot_product(w, u)) AS u FROM (SELECT b.*, list_distance(e, cent) AS d, {_unit('e')} AS u FROM b JOIN c USING (cluster_id)), rot),
l AS MATERIALIZED (SELECT row_id, cluster_id, e, norm_oc, u, list_transform(u, lambda x: (CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END) * (least({2.0**EX_BITS - 1}, floor(abs(x) * CAST({SCALE!r} AS DOUBLE) + 1e-5)) + 0.5)) AS lv FROM br),
lf AS MATERIALIZED (SELECT *, CASE WHEN list_dot_product(lv, u) > 0 THEN 1 / list_dot_product(lv, u) ELSE 0 END AS factor FROM l),
qa AS MATERIALIZED (SELECT qid, qvec, cal, own, cluster_id, d AS norm_qc, list_transform(m, lambda w: list_dot_product(w, u)) AS qunit FROM (
  SELECT b.row_id AS qid, e AS qvec, b.row_id % {EVERY} <> 0 AS cal, b.cluster_id AS own, c.cluster_id, list_distance(e, cent) AS d, {_unit('e')} AS u FROM b, c WHERE b.row_id % {EVERY // 2} = 0), rot),
ka AS MATERIALIZED (SELECT qid, row_id, cluster_id, cal, own, norm_oc, norm_qc, tru, greatest(0, norm_oc * norm_oc + norm_qc * norm_qc - 2 * norm_oc * norm_qc * (1 - 2 * h / 64.0)) AS est,
  greatest(0, norm_oc * norm_oc + norm_qc * norm_qc - 2 * norm_oc * norm_qc * ip) AS est2 FROM (
  SELECT qid, row_id, lf.cluster_id, cal, own, norm_oc, norm_qc, {_D} AS tru, list_dot_product(lv, qunit) * factor AS ip,
    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (u[i] >= 0) <> (qunit[i] >= 0) THEN 1 ELSE 0 END)) AS h FROM lf JOIN qa USING (cluster_id))),
kc AS MATERIALIZED (SELECT qid, tru, est2, row_number() OVER (PARTITION BY qid ORDER BY tru) AS r1, row_number() OVER (PARTITION BY qid ORDER BY est2) AS r2 FROM ka WHERE cal),
dk AS MATERIALIZED (SELECT a[1 + {_low('len(a)')}] AS d_k, z[1 + {_low('len(z)')}] AS safein_d_k FROM (SELECT list(tru ORDER BY tru) FILTER (r1 = {K + 1}) AS a, list(est2 ORDER BY est2) FILTER (r2 = {K + 1}) AS z FROM kc)),
er AS MATERIALIZED (SELECT abs(est - tru) / (2 * norm_oc * norm_qc) AS e1, abs(est2 - tru) / (2 * norm_oc * norm_qc) AS e2 FROM ka, dk WHERE cal AND own = cluster_id AND tru BETWEEN 0.1 * d_k AND 10 * d_k AND norm_oc * norm_qc > 0),
cal AS MATERIALIZED (SELECT d_k, safein_d_k, x[1 + {_up('len(x)')}] AS eps, y[1 + {_up('len(y)')}] AS eps2 FROM dk, (SELECT list(e1 ORDER BY e1) AS x, list(e2 ORDER BY e2) AS y FROM er)),
k AS MATERIALIZED (SELECT qid, row_id, cluster_id, norm_oc, norm_qc, tru, est, est2, d_k, safein_d_k, norm_oc * norm_qc * eps AS margin, norm_oc * norm_qc * eps2 AS margin2, row_number() OVER (PARTITION BY qid ORDER BY tru, row_id) <= {K} AS is_true FROM ka, cal WHERE NOT ka.cal)
"""
#: Every query's frontiers before each probe: the k-th smallest bounds of the candidates of earlier probes. A dropped candidate's upper bound is above the frontier, so all may count for it.
_FRONTIER = f"""fr AS MATERIALIZED (SELECT qid, cluster_rank, upper AS frontier FROM (SELECT qid, CAST(n AS INTEGER) AS cluster_rank, est + margin AS upper, row_number() OVER (PARTITION BY qid, n ORDER BY est + margin) AS r
  FROM k JOIN p USING (qid, cluster_id), range(2, {NPROBE + 1}) AS t(n) WHERE p.cluster_rank < n) WHERE r = {K})"""


def _cls(d: str, scale: float = 1.0, margin: str = "margin") -> str:
    return f"CASE WHEN {d} > d_k + 2 * {margin} THEN 'SafeOut' WHEN {d} < safein_d_k - 2 * {scale} * {margin} THEN 'SafeIn' ELSE 'Uncertain' END"


_COUNTS = "count(*) FILTER (cls = 'SafeIn') AS safein, count(*) FILTER (cls = 'SafeOut') AS safeout, count(*) FILTER (cls = 'Uncertain') AS uncertain, count(*) FILTER (cls = 'SafeIn' AND NOT is_true) AS false_safein, count(*) FILTER (cls = 'SafeOut' AND is_true) AS false_safeout"
_CLS2 = _cls("est2", margin="margin2")
_BOTH = f"(SELECT *, CASE WHEN s1_class = 'Uncertain' THEN s2 END AS s2_class, CASE WHEN s1_class = 'Uncertain' THEN s2 ELSE s1_class END AS cls FROM (SELECT *, {_cls('est')} AS s1_class, {_CLS2} AS s2 FROM k))"
_CURVE = f"SELECT qid, probed, dist AS kth FROM (SELECT qid, probed, dist, row_number() OVER (PARTITION BY qid, probed ORDER BY dist, row_id) AS r FROM (SELECT qid, row_id, {_D} AS dist, CAST(n AS INTEGER) AS probed FROM p JOIN b USING (cluster_id), range(1, 5) AS t(n) WHERE cluster_rank <= n)) WHERE r = {K}"
_RECALL = ", ".join(f"round(count(*) FILTER (g.rank <= {k} AND f.rank <= {k}) / {float(k)}, 5) AS recall_{k}" for k in (1, 5, 10))
_REPLAY = " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS scale, is_true, {_cls('est', s)} AS cls FROM k" for s in (0.0, 0.5, 1.0, 2.0))

ORACLE = {
    "exact_search": _CTE + "SELECT qid, rank, row_id, round(dist, 5) AS dist FROM gt",
    "exact_search_ip": _CTE + f"SELECT qid, rank, row_id, round(dist, 5) AS dist FROM (SELECT qid, row_id, -list_dot_product(qvec, e) AS dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY -list_dot_product(qvec, e), row_id) AS INTEGER) AS rank FROM q, b) WHERE rank <= {K}",
    "ivf_search": _CTE + "SELECT qid, rank, row_id, round(dist, 5) AS dist, lang, source FROM ivf LEFT JOIN documents ON doc_id = row_id",
    "route": _CTE + f"SELECT qid, cluster_id, cluster_rank, round(score, 5) AS score FROM p WHERE cluster_rank <= {NPROBE}",
    "route_two_level": _CTE + f""", sm AS (SELECT cluster_id % 3 AS super_id, i, avg(m) AS m FROM m GROUP BY ALL), sc AS (SELECT super_id, list(m ORDER BY i) AS cent FROM sm GROUP BY super_id),
sp AS (SELECT qid, qvec, super_id, row_number() OVER (PARTITION BY qid ORDER BY -list_dot_product(qvec, cent), super_id) AS r FROM q, sc)
SELECT qid, cluster_id, cluster_rank, round(score, 5) AS score FROM (SELECT qid, cluster_id, -list_dot_product(qvec, cent) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY -list_dot_product(qvec, cent), cluster_id) AS INTEGER) AS cluster_rank FROM sp JOIN c ON c.cluster_id % 3 = super_id WHERE r <= 2) WHERE cluster_rank <= {NPROBE}""",
    "assign": _CTE + "SELECT row_id, cluster_id, round(d, 5) AS norm FROM (SELECT row_id, c.cluster_id, list_distance(e, cent) AS d, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(e, cent), c.cluster_id) AS r FROM b, c) WHERE r = 1",
    "cluster_report": _CTE + "SELECT cluster_id, count(*) AS n, round(max(d), 5) AS r_max, round(avg(d), 5) AS mean_norm, round(stddev_pop(d), 5) AS std_norm FROM (SELECT cluster_id, list_distance(e, cent) AS d FROM b JOIN c USING (cluster_id)) GROUP BY cluster_id",
    "stage1_classes": _CTE + f"SELECT qid, {_COUNTS} FROM (SELECT *, {_cls('est')} AS cls FROM k) GROUP BY qid",
    "stage1_error": _CTE + "SELECT round(avg(a), 5) AS mae, round(avg(CASE WHEN tru > 1e-8 THEN a / tru END), 5) AS mean_rel, round(quantile_cont(a, 0.95), 5) AS p95, round(quantile_cont(a, 0.99), 5) AS p99 FROM (SELECT abs(est - tru) AS a, tru FROM k)",
    "budget_search": _CTE + f"SELECT qid, rank, row_id, round(tru, 5) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY tru, row_id) AS INTEGER) AS rank FROM (SELECT k.*, row_number() OVER (PARTITION BY qid ORDER BY est, cluster_rank, row_id) AS r FROM k JOIN p USING (qid, cluster_id) WHERE cluster_rank <= {FRONTIER_PROBES}) WHERE r <= 50) WHERE rank <= {K}",
    "budget_early": _CTE + f"""SELECT qid, row_id, min(t) AS emitted FROM (SELECT qid, row_id, CAST(n AS INTEGER) AS t, row_number() OVER (PARTITION BY qid, n ORDER BY est, cluster_rank, row_id) AS r
  FROM k JOIN p USING (qid, cluster_id), range(1, {FRONTIER_PROBES // 2 + 1}) AS t(n) WHERE cluster_rank <= 2 * n) WHERE r <= 50 GROUP BY qid, row_id""",
    "rows_by_key": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0",
    "decoded": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS source FROM documents",
    "recall": _CTE + f"SELECT g.qid, {_RECALL} FROM gt g LEFT JOIN ivf f ON f.qid = g.qid AND f.row_id = g.row_id GROUP BY g.qid",
    "calibration": _CTE + "SELECT round(d_k, 5) AS d_k, round(safein_d_k, 5) AS safein_d_k, round(eps, 5) AS eps, round(eps2, 5) AS eps2 FROM cal",
    "margin_replay": _CTE + f"SELECT scale, safein, safeout, uncertain, false_safein, false_safeout, round(CASE WHEN safein + safeout + uncertain = 0 THEN 0 ELSE safein / (safein + safeout + uncertain) END, 5) AS safein_rate, round(CASE WHEN safein = 0 THEN 0 ELSE false_safein / safein END, 5) AS false_safein_rate FROM (SELECT scale, {_COUNTS} FROM ({_REPLAY}) GROUP BY scale)",
    "grid_replay": _CTE + f""", kth AS (SELECT list(est2 ORDER BY est2) AS v FROM (SELECT est2, row_number() OVER (PARTITION BY qid ORDER BY est2) AS r FROM k) WHERE r = {K}),
ne AS (SELECT list(e ORDER BY e) AS v FROM (SELECT abs(est - tru) / (2 * norm_oc * norm_qc) AS e FROM k)),
g AS (SELECT kth.v[1 + CAST(floor(a * (len(kth.v) - 1)) AS BIGINT)] AS d_k, ne.v[1 + CAST(floor(z * (len(ne.v) - 1)) AS BIGINT)] AS eps FROM kth, ne, (VALUES {_VALUES(GRID[0])}) AS s(a), (VALUES {_VALUES(GRID[1])}) AS t(z)),
per AS (SELECT g.d_k, eps, qid, count(*) FILTER (est < g.d_k - 2 * (norm_oc * norm_qc * eps)) AS si, count(*) FILTER (est < g.d_k - 2 * (norm_oc * norm_qc * eps) AND NOT is_true) AS fi, count(*) FILTER (est < g.d_k AND NOT est < g.d_k - 2 * (norm_oc * norm_qc * eps)) AS bl FROM k, g GROUP BY ALL)
SELECT round(d_k, 5) AS d_k, round(eps, 5) AS eps, CAST(sum(si) AS BIGINT) AS safein, CAST(sum(fi) AS BIGINT) AS false_safein, CAST(sum(bl) AS BIGINT) AS blocked, count(*) FILTER (si >= 1) AS queries_1, count(*) FILTER (si >= 2) AS queries_2 FROM per GROUP BY per.d_k, per.eps""",
    "confusion": _CTE + f"SELECT exact, cls, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY exact), 5) AS pct FROM (SELECT {_cls('tru')} AS exact, {_cls('est')} AS cls FROM k) GROUP BY exact, cls",
    "geometry": _CTE + f""", g AS (SELECT cluster_id, count(*) AS n, max(norm_oc) AS r FROM lf GROUP BY cluster_id), n AS (SELECT sqrt(score) AS d FROM p WHERE cluster_rank <= {NPROBE}),
v AS (SELECT 'cluster_size' AS metric, CAST(n AS DOUBLE) AS v FROM g UNION ALL SELECT 'cluster_rmax', r FROM g UNION ALL SELECT 'norm_oc_all', norm_oc FROM lf UNION ALL SELECT 'norm_qc_topn', d FROM n UNION ALL SELECT 'margin_factor_topn', 2 * d * eps FROM n, cal),
o AS (SELECT metric, avg(v) AS mean, list(v ORDER BY v) AS s FROM v GROUP BY metric)
SELECT metric, round(mean, 5) AS mean, {", ".join(f"round(s[1 + CAST(floor({p} * (len(s) - 1)) AS BIGINT)], 5) AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99)))}, round(s[len(s)], 5) AS max FROM o""",
    "convergence": _CTE + f"SELECT qid, probed, round(dist, 5) AS kth FROM (SELECT qid, probed, dist, row_number() OVER (PARTITION BY qid, probed ORDER BY dist, row_id) AS r FROM (SELECT qid, row_id, {_D} AS dist, CAST(n AS INTEGER) AS probed FROM p JOIN b USING (cluster_id), range(1, 5) AS t(n) WHERE cluster_rank <= n)) WHERE r = {K}",
    "index_search": _CTE + f""" SELECT qid, rank, row_id, round(dist, 5) AS dist, lang, source FROM (SELECT qid, row_id, {_D} AS dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_D}, row_id) AS INTEGER) AS rank FROM p JOIN own USING (cluster_id) WHERE cluster_rank <= {NPROBE}) LEFT JOIN documents ON doc_id = row_id WHERE rank <= {K}""",
    "stage2_classes": _CTE + f"SELECT qid, {_COUNTS} FROM {_BOTH} GROUP BY qid",
    "stage2_error": _CTE + "SELECT round(avg(a), 5) AS mae, round(avg(CASE WHEN tru > 1e-8 THEN a / tru END), 5) AS mean_rel, round(quantile_cont(a, 0.95), 5) AS p95, round(quantile_cont(a, 0.99), 5) AS p99 FROM (SELECT abs(est2 - tru) AS a, tru FROM k)",
    "stage_recall": _CTE + f"SELECT round(avg(CASE WHEN is_true THEN CAST(r1 <= {K} AS INTEGER) END), 5) AS recall_stage1, round(avg(CASE WHEN is_true THEN CAST(r2 <= {K} AS INTEGER) END), 5) AS recall_stage2 FROM (SELECT is_true, row_number() OVER (PARTITION BY qid ORDER BY est, row_id) AS r1, row_number() OVER (PARTITION BY qid ORDER BY est2, row_id) AS r2 FROM k)",
    "candidate_table": _CTE + f""", {_FRONTIER},
t AS (SELECT k2.*, p.cluster_rank, CASE WHEN s2_class IS NOT NULL THEN est2 END AS z, CASE WHEN s2_class IS NOT NULL THEN margin2 END AS mz, 2 * norm_oc * norm_qc AS nn FROM {_BOTH} k2 JOIN p ON p.qid = k2.qid AND p.cluster_id = k2.cluster_id WHERE p.cluster_rank <= {NPROBE})
SELECT t.qid AS query_id, t.cluster_rank, cluster_id, row_id AS vector_row, row_id AS vector_external_id, is_true AS is_true_topk, round(tru, 5) AS exact_dist, round(est, 5) AS est_dist_s1, round(z, 5) AS est_dist_s2, round(norm_oc, 5) AS norm_oc, round(norm_qc, 5) AS norm_qc,
round(margin, 5) AS margin_s1, round(mz, 5) AS margin_s2_current, round(d_k, 5) AS d_k_static, round(frontier, 5) AS dynamic_d_k_before_cluster, round(abs(est - tru), 5) AS abs_err_s1, round(abs(z - tru), 5) AS abs_err_s2,
round(CASE WHEN nn > 0 THEN abs(est - tru) / nn END, 5) AS normalized_err_s1, round(CASE WHEN nn > 0 THEN abs(z - tru) / nn END, 5) AS normalized_err_s2, round(safein_d_k - 2 * margin - est, 5) AS safein_gap_s1, round(safein_d_k - 2 * mz - z, 5) AS safein_gap_s2,
round(est - d_k - 2 * margin, 5) AS safeout_gap_s1, round(z - d_k - 2 * mz, 5) AS safeout_gap_s2, round(CASE WHEN margin > 0 THEN (safein_d_k - est) / (2 * margin) END, 5) AS safein_ratio_s1, round(CASE WHEN mz > 0 THEN (safein_d_k - z) / (2 * mz) END, 5) AS safein_ratio_s2,
s1_class, s2_class, cls AS final_class FROM t LEFT JOIN fr ON fr.qid = t.qid AND fr.cluster_rank = t.cluster_rank""",
    "frontier": _CTE + f""", {_FRONTIER}, w AS MATERIALIZED (SELECT k.*, p.cluster_rank, CASE WHEN est > coalesce(frontier, CAST('inf' AS DOUBLE)) + margin THEN 'SafeOut' WHEN est < safein_d_k - margin THEN 'SafeIn' ELSE 'Uncertain' END AS cls, frontier
  FROM k JOIN p USING (qid, cluster_id) LEFT JOIN fr ON fr.qid = k.qid AND fr.cluster_rank = p.cluster_rank WHERE p.cluster_rank <= {FRONTIER_PROBES}),
lo AS (SELECT qid, cluster_rank, lower AS safein_frontier FROM (SELECT qid, CAST(n AS INTEGER) AS cluster_rank, est - margin AS lower, row_number() OVER (PARTITION BY qid, n ORDER BY est - margin) AS r FROM w, range(2, {FRONTIER_PROBES + 1}) AS t(n) WHERE w.cluster_rank < n AND cls <> 'SafeOut') WHERE r = {K})
SELECT w.qid, w.cluster_rank, row_id, round(est, 5) AS est, round(margin, 5) AS margin, cls, round(frontier, 5) AS frontier, round(safein_frontier, 5) AS safein_frontier FROM w LEFT JOIN lo ON lo.qid = w.qid AND lo.cluster_rank = w.cluster_rank""",
    "search_statistics": _CTE + f""", {_FRONTIER}, w AS MATERIALIZED (SELECT k.qid, p.cluster_rank, frontier, CASE WHEN est > coalesce(frontier, CAST('inf' AS DOUBLE)) + margin THEN 'SafeOut' WHEN est < safein_d_k - margin THEN 'SafeIn' ELSE 'Uncertain' END AS cls
  FROM k JOIN p USING (qid, cluster_id) LEFT JOIN fr ON fr.qid = k.qid AND fr.cluster_rank = p.cluster_rank WHERE p.cluster_rank <= {FRONTIER_PROBES})
SELECT qid, count(DISTINCT cluster_rank) AS probed, count(*) AS candidates, count(*) FILTER (cls = 'SafeOut') AS safeout, count(*) FILTER (cls = 'SafeIn') AS payload_reads, count(*) FILTER (cls = 'Uncertain') AS vector_reads, round(max_by(frontier, cluster_rank), 5) AS last_frontier FROM w GROUP BY qid""",
    "space_comparison": _CTE + "SELECT qid, count(*) FILTER (est2 < d_k - 2 * margin2) AS safein_exact, count(*) FILTER (est2 < safein_d_k - 2 * margin2) AS safein_estimate, count(*) FILTER (est2 < d_k - 2 * margin2 AND NOT is_true) AS false_exact, count(*) FILTER (est2 < safein_d_k - 2 * margin2 AND NOT is_true) AS false_estimate FROM k GROUP BY qid",
    "cluster_classes": _CTE + f"SELECT cluster_id, {_COUNTS} FROM {_BOTH} GROUP BY cluster_id",
    "threshold_report": _CTE + f"SELECT qid, count(*) FILTER (tru < d_k) AS true_below, count(*) FILTER (est < d_k) AS est_below, count(*) FILTER (est2 < d_k) AS est2_below, count(*) FILTER (tru < d_k AND est2 < d_k) AS both_below, count(*) FILTER (est2 < d_k - 2 * margin2) AS safein, round(avg(CAST(tru <= d_k AS INTEGER)), 5) AS share FROM k GROUP BY qid",
    "margin_quartiles": _CTE + f", n AS (SELECT *, {_cls('est')} AS cls FROM k WHERE is_true), x3 AS (SELECT quantile_cont(margin, 0.25) AS a, quantile_cont(margin, 0.5) AS b, quantile_cont(margin, 0.75) AS d FROM n) SELECT CAST(1 + CAST(margin > a AS INTEGER) + CAST(margin > b AS INTEGER) + CAST(margin > d AS INTEGER) AS INTEGER) AS quartile, count(*) AS n, round(avg(CAST(cls = 'SafeOut' AS INTEGER)), 5) AS rate FROM n, x3 GROUP BY quartile",
    "convergence_series": _CTE + f"SELECT probed, round(avg(kth), 5) AS mean, round(quantile_cont(kth, 0.25), 5) AS p25, round(quantile_cont(kth, 0.75), 5) AS p75 FROM (SELECT qid, probed, round(kth, 5) AS kth FROM ({_CURVE})) GROUP BY probed",
    "frontier_stability": _CTE + f""", f AS (SELECT qid, probed, kth, CASE WHEN pr = 0 THEN abs(kth) ELSE abs(kth - pr) / abs(pr) END AS change FROM (SELECT *, lag(kth) OVER (PARTITION BY qid ORDER BY probed) AS pr FROM (SELECT qid, probed, round(kth, 5) AS kth FROM ({_CURVE})))),
st AS (SELECT *, coalesce(change <= 0.01 AND probed >= 2, false) AS still FROM f), ru AS (SELECT *, sum(CAST(NOT still AS INTEGER)) OVER (PARTITION BY qid ORDER BY probed) AS run FROM st)
SELECT qid, probed, kth, round(change, 5) AS change, CAST(CASE WHEN still THEN sum(CAST(still AS INTEGER)) OVER (PARTITION BY qid, run ORDER BY probed) ELSE 0 END AS INTEGER) AS stable FROM ru""",
    "overlap_curve": _CTE + "SELECT CAST(n AS INTEGER) AS probed, round(avg(CAST(cluster_rank <= n AS INTEGER)), 5) AS overlap FROM gt JOIN b USING (row_id) JOIN p ON p.qid = gt.qid AND p.cluster_id = b.cluster_id, range(1, 5) AS t(n) GROUP BY n",
    "label_entropy": "SELECT round(-sum(n / t * log2(n / t)), 5) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY label)",
    "source_dictionary": "SELECT source, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)",
    "validation": "SELECT count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.01) AS not_unit FROM embeddings",
    "normalised": "SELECT vec_id AS row_id, round(3 * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, CAST(1 AS DOUBLE) AS unit, 64 AS padded, CAST(len(list_filter(embedding, lambda x: x >= 0)) AS INTEGER) AS positive FROM embeddings",
    "spearman": "SELECT round(coalesce(corr(rx, ry), 0), 5) AS rho FROM (SELECT CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS DOUBLE) AS rx, CAST(row_number() OVER (ORDER BY c_nationkey, c_custkey) AS DOUBLE) AS ry FROM customer)",
    "payload_projection": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events GROUP BY ALL",
}
ORACLE["routing_overlap"] = ORACLE["route_two_level"].replace("\nSELECT qid, cluster_id, cluster_rank", ", two AS (SELECT qid, cluster_id, cluster_rank") + f"""), one AS (SELECT qid, cluster_id FROM (SELECT qid, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY -list_dot_product(qvec, cent), cluster_id) AS r FROM q, c) WHERE r <= {NPROBE})
SELECT one.qid, count(*) AS n, count(two.qid) AS shared FROM one LEFT JOIN two ON two.qid = one.qid AND two.cluster_id = one.cluster_id GROUP BY one.qid"""
ORACLE["nprobe_sweep"] = _CTE + f"""SELECT nprobe, round(avg(r), 5) AS mean, round(min(r), 5) AS least, round(max(r), 5) AS most, round(stddev_samp(r), 5) AS std FROM (
SELECT g.nprobe, g.qid, count(f.row_id) / count(*) AS r FROM (SELECT qid, row_id, nprobe FROM gt, (VALUES {_VALUES(PROBES)}) AS t(nprobe)) g LEFT JOIN (
SELECT nprobe, qid, row_id, row_number() OVER (PARTITION BY nprobe, qid ORDER BY {_D}, row_id) AS r FROM p JOIN own USING (cluster_id), (VALUES {_VALUES(PROBES)}) AS t(nprobe) WHERE cluster_rank <= nprobe
) f ON f.nprobe = g.nprobe AND f.qid = g.qid AND f.row_id = g.row_id AND f.r <= {K} GROUP BY g.nprobe, g.qid) GROUP BY nprobe"""
_TABLE = ORACLE["candidate_table"].removeprefix(_CTE).replace("SELECT t.qid AS query_id", ", final AS (SELECT t.qid AS query_id", 1)
ORACLE["diagnostic_summary"] = _CTE + _TABLE + """) SELECT count(*) AS n, round(avg(CAST(final_class = 'SafeIn' AS INTEGER)), 5) AS safein, round(avg(CAST(final_class = 'SafeOut' AS INTEGER)), 5) AS safeout, round(avg(CAST(final_class = 'Uncertain' AS INTEGER)), 5) AS uncertain,
round(avg(CAST(s2_class IS NOT NULL AS INTEGER)), 5) AS stage2, round(quantile_cont(abs_err_s1, 0.5), 5) AS p50, round(quantile_cont(abs_err_s1, 0.95), 5) AS p95, round(quantile_cont(abs_err_s1, 0.99), 5) AS p99, round(quantile_cont(abs_err_s1, 0.999), 5) AS p999 FROM final"""
ORACLE["probe_statistics"] = _CTE + f"SELECT t.qid, t.cluster_id, " + ", ".join(f"count(*) FILTER ({c} = '{x}') AS {n}_{x.lower()}" for c, n in (("s1_class", "s1"), ("cls", "final")) for x in ("SafeIn", "SafeOut", "Uncertain")) + f" FROM {_BOTH} t JOIN p ON p.qid = t.qid AND p.cluster_id = t.cluster_id WHERE cluster_rank <= {NPROBE} GROUP BY t.qid, t.cluster_id"
ORACLE["truth_ids"] = _CTE + "SELECT DISTINCT row_id FROM gt"
ORACLE["code_symbols"] = _CTE + f"SELECT level, n, round(n / t, 5) AS share, round(-(n / t) * log2(n / t), 5) AS bits FROM (SELECT level, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT CAST(unnest(list_transform(un, lambda x: (CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END) * (least({2.0**EX_BITS - 1}, floor(abs(x) * CAST({SCALE!r} AS DOUBLE) + 1e-5)) + 0.5))) AS DOUBLE) AS level FROM (SELECT {_unit('e')} AS un FROM b JOIN c USING (cluster_id))) GROUP BY level)"
