"""An inverted-file index kept as tables: records, codes, centroids and one row of settings.

Codes are rotated residuals at a few bits a component, stored as small odd integers (sign and magnitude), which Parquet packs to their bits. They are range-sorted by cluster and row,
so a large cluster is spread over files and a probe of few clusters skips the rest by file statistics. Only what is bounded by ``nlist`` is
broadcast. A search estimates distances from codes, sets a query's frontier at the k-th smallest upper bound, compares the raw vectors of candidates
whose lower bound is not beyond it, and joins payload to the final rows. Candidates are made and compared in the tasks, each raw vector being read once for all queries; only a task's nearest leave it.

Null vectors and vectors that hold a null or non-finite component are not indexed. An empty table is refused, as it has no centroids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skerry.functions import codes as C
from skerry.functions import vectors as V
from skerry.operators import pairs as P
from skerry.operators import search as S

VERSION = 2
TABLES = ("records", "codes", "centroids", "settings")


def _encoder(dim: int, ex_bits: int, seed: int):
    rotation, scale = C.Rotation(dim, seed), C.scale_for(dim, ex_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code = C.encode(np.stack(pdf["r"].to_numpy()).astype(float), rotation, ex_bits, scale)
                levels = (2 * code["magnitude"].astype(np.int16) + 1) * np.where(code["sign"], 1, -1)
                yield pd.DataFrame({"cluster_id": pdf["cluster_id"], "row_id": pdf["row_id"], "norm_oc": code["norm"], "factor": code["factor"], "levels": list(levels.astype(np.int16))})

    return run


METRICS = ("l2", "ip", "cosine")


def build(vectors: DataFrame, centroids: DataFrame, path: str, ex_bits: int = 3, seed: int = 42, metric: str = "l2", progress: Callable[[int, int], None] | None = None) -> Index:
    """Writes the index of ``vectors`` (row_id, embedding and payload columns) under ``path``. ``centroids``: cluster_id, centroid.

    ``metric`` decides clustering and routing: rows are placed by squared distance, for ``cosine`` after both sides are scaled to length 1; queries are routed by inner product for ``ip`` and ``cosine``. Ranks are by
    squared distance of the raw vectors in any case. ``progress`` is told of each written table.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    done = progress or (lambda k, n: None)
    spark = vectors.sparkSession
    whole = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = centroids.first()
    if first is None or whole.isEmpty():
        raise ValueError("nothing to index")
    dim, nlist = len(first["centroid"]), centroids.count()
    if whole.filter(F.size("embedding") != dim).limit(1).count() or not 0 <= ex_bits <= 6:
        raise ValueError(f"expected vectors of {dim} components and 0 to 6 magnitude bits")
    centroids.select("cluster_id", "centroid").coalesce(1).write.parquet(f"{path}/centroids")
    cent = spark.read.parquet(f"{path}/centroids")
    done(1, len(TABLES))
    whole.repartitionByRange("row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/records")
    base = spark.read.parquet(f"{path}/records").select("row_id", "embedding")
    done(2, len(TABLES))
    placed, near = (base, cent) if metric != "cosine" else (base.select("row_id", V.l2_normalize(F.col("embedding")).alias("embedding")), cent.select("cluster_id", V.l2_normalize(F.col("centroid")).alias("centroid")))
    own = S.assign(placed, near).select("row_id", "cluster_id")
    residuals = base.join(own, "row_id").join(S._small(cent, nlist, S.MAX_CENTROIDS), "cluster_id").select("cluster_id", "row_id", V.residual(F.col("embedding"), F.col("centroid")).alias("r"))
    codes = residuals.mapInPandas(_encoder(dim, ex_bits, seed), f"cluster_id {cent.schema['cluster_id'].dataType.simpleString()}, row_id long, norm_oc double, factor double, levels array<smallint>")
    codes.repartitionByRange("cluster_id", "row_id").sortWithinPartitions("cluster_id", "row_id").write.parquet(f"{path}/codes")
    done(3, len(TABLES))
    spark.createDataFrame([(VERSION, dim, nlist, ex_bits, seed, metric)], "version int, dim int, nlist int, ex_bits int, seed long, metric string").coalesce(1).write.parquet(f"{path}/settings")
    done(4, len(TABLES))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index written before; an error where its version is another or its centroids do not fit its settings."""
    records, codes, centroids, settings = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    s = settings.first()
    if s is None or s["version"] != VERSION:
        raise ValueError(f"not an index of version {VERSION}: {path}")
    if centroids.count() != s["nlist"] or centroids.filter(F.size("centroid") != s["dim"]).limit(1).count():
        raise ValueError(f"centroids do not fit the settings: {path}")
    return Index(records, codes, centroids, s["dim"], s["nlist"], s["ex_bits"], s["seed"], s["metric"])


@dataclass
class Index:
    records: DataFrame
    codes: DataFrame
    centroids: DataFrame
    dim: int
    nlist: int
    ex_bits: int
    seed: int
    metric: str = "l2"

    def preload(self) -> Index:
        """Keeps codes and centroids in the executors' memory and disk, read once before the first query."""
        for table in (self.codes, self.centroids):
            table.persist().count()
        return self

    def unload(self) -> Index:
        for table in (self.codes, self.centroids):
            table.unpersist()
        return self

    def route(self, queries: DataFrame, nprobe: int, threshold: int | None = None) -> DataFrame:
        """The clusters that a query probes; by the hierarchy over more than ``threshold`` clusters, for inner products."""
        if self.metric == "cosine":
            turned = queries.select("qid", V.l2_normalize(F.col("qvec")).alias("qvec"), F.col("qvec").alias("raw"))
        else:
            turned = queries.withColumn("raw", F.col("qvec"))
        metric = "l2" if self.metric == "l2" else "ip"
        found = S.route(turned.select("qid", "qvec"), self.centroids, nprobe, metric, self.nlist) if threshold is None else S.route_adaptive(turned.select("qid", "qvec"), self.centroids, nprobe, metric, threshold)
        return found.drop("qvec").join(turned.select("qid", F.col("raw").alias("qvec")), "qid")

    def _scan(self, queries: DataFrame, nprobe: int) -> tuple[DataFrame, DataFrame, P.Frame]:
        """The queries with the clusters that they probe, and codes beside their vectors."""
        clusters = F.array_sort(F.collect_list(F.struct("cluster_rank", "cluster_id")))
        routed = self.route(queries, nprobe).groupBy("qid").agg(clusters.alias("p")).select("qid", F.col("p.cluster_id").alias("probes"))
        rows = S.spread(self.codes.join(self.records.select("row_id", "embedding"), "row_id"))
        return queries.select("qid", "qvec").join(routed, "qid"), rows, P.Frame(*S.centroid_table(self.centroids), C.Rotation(self.dim, self.seed), self.ex_bits, 0.0)

    def candidates(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(qid, row_id, cluster_id, cluster_rank, norm_oc, norm_qc, est1, est2) of all members of the probed clusters: estimates from signs and from all bits."""
        asks, rows, frame = self._scan(queries, nprobe)
        kinds = {"cluster_id": self.centroids.schema["cluster_id"].dataType.simpleString(), "cluster_rank": "int"} | {c: "double" for c in ("norm_oc", "norm_qc", "est1", "est2")}
        of = lambda b: {"cluster_id": frame.ids[b.cluster], "cluster_rank": b.slot + 1, "norm_oc": b.oc[:, None], "norm_qc": b.size, "est1": b.by_signs, "est2": b.est2}
        return P.emit(asks, rows, frame, kinds, of, read=P.read_codes)

    def error_bound(self, queries: DataFrame, nprobe: int, p: float = 1.0) -> float:
        """The p-quantile of the stage-2 error over twice the norms, of the candidates of calibration queries (other ones than those that are to be answered); 1.0 gives the largest."""
        scan = self._scan(queries, nprobe)
        if p >= 1:
            return P.run(*scan, P.Largest, P.read_codes).agg(F.max("most")).first()[0] or 0.0
        of = lambda b: [np.abs(b.est2 - b.true)[b.norms > 0] / (2 * b.norms[b.norms > 0])]
        (e,) = P.ordered(*scan, of, [lambda n: [max(0, int(np.ceil(p * n)) - 1)] if n else []], P.read_codes)
        return next(iter(e.at.values()), 0.0)

    def _frontiers(self, queries: DataFrame, k: int, nprobe: int, bound: float) -> tuple[DataFrame, DataFrame, P.Frame]:
        """:meth:`_scan` with each query's frontier and the number of candidates that it rests on, k at most."""
        asks, rows, frame = self._scan(queries, nprobe)
        upper = P.smallest(asks, rows, frame, k, 1, lambda b: [(b.est2 + 2 * bound * b.norms, 0.0, None)], P.read_codes)
        told = upper.groupBy("qid").agg(F.max("value").alias("frontier"), F.count("*").alias("met"))
        return asks.join(told, "qid"), rows, frame

    def survivors(self, queries: DataFrame, k: int, nprobe: int, bound: float, budget: int = 0) -> DataFrame:
        """Candidates whose lower bound is not beyond the query's frontier, and of those the ``budget`` best by estimate (0: all). Queries with fewer than k keep all."""
        scan = self._frontiers(queries, k, nprobe, bound)
        if not budget:
            return P.emit(*scan, {"cluster_rank": "int", "est": "double"}, lambda b: {"cluster_rank": b.slot + 1, "est": b.est2}, lambda b: _survives(b, k, bound), P.read_codes)
        best = P.smallest(*scan, budget, 1, lambda b: [(np.where(_survives(b, k, bound), b.est2, np.nan), b.slack2, b.est2_of)], P.read_codes)
        return best.select("qid", "row_id", (F.col("slot") + 1).alias("cluster_rank"), F.col("value").alias("est"))

    def search(self, queries: DataFrame, k: int, nprobe: int, bound: float, budget: int = 0, payload: list[str] | None = None) -> DataFrame:
        """(qid, rank, row_id, dist, payload...). ``bound`` is that of :meth:`error_bound`; with the largest error and no budget, the rows are those of an exact search of the probed clusters."""
        if budget:
            found = S.rerank(self.survivors(queries, k, nprobe, bound, budget).select("qid", "row_id").join(queries, "qid"), self.records, k)
        else:
            scan = self._frontiers(queries, k, nprobe, bound)
            best = P.smallest(*scan, k, 1, lambda b: [(np.where(_survives(b, k, bound), b.true, np.nan), b.slack, b.true_of)], P.read_codes, by_row=True)
            found = best.select("qid", "rank", "row_id", F.col("value").alias("dist"))
        extra = [c for c in self.records.columns if c not in ("row_id", "embedding")] if payload is None else payload
        if missing := [c for c in extra if c not in self.records.columns]:
            raise KeyError(f"no such columns: {missing}")
        return S.with_payload(found, self.records.select("row_id", *extra)).select("qid", "rank", "row_id", "dist", *extra) if extra else found


def _survives(b: P.Block, k: int, bound: float) -> np.ndarray:
    frontier, met = (b.asks.told[c].to_numpy()[b.at] for c in ("frontier", "met"))
    return (b.est2 - 2 * bound * b.norms <= frontier + 1e-9) | (met < k)


def frontier_changes(curve: DataFrame, value: str = "kth", tolerance: float = 0.01, least: int = 2) -> DataFrame:
    """Change of each query's value against the probe before, and how many probes in a row it has moved by at most ``tolerance`` (relative), from probe ``least`` on."""
    w = W.Window.partitionBy("qid").orderBy("probed")
    before = F.lag(value).over(w)
    change = F.when(before.isNull(), None).when(before == 0, F.abs(F.col(value))).otherwise(F.abs(F.col(value) - before) / F.abs(before))
    moved = curve.withColumn("change", change)
    still = F.col("change").isNotNull() & (F.col("change") <= tolerance) & (F.col("probed") >= least)
    runs = moved.withColumn("still", still).withColumn("run", F.sum((~F.col("still")).cast("int")).over(w))
    count = F.sum(F.col("still").cast("int")).over(W.Window.partitionBy("qid", "run").orderBy("probed"))
    return runs.select("qid", "probed", value, "change", F.when(F.col("still"), count).otherwise(0).cast("int").alias("stable"))
