"""Inverted-file search over DataFrames: routing, probing, exact rerank, late payload.

Centroids are bounded by ``nlist`` (MAX_CENTROIDS at most are broadcast; beyond that the join shuffles). Query batches are bounded too:
at most QUERY_BLOCK queries are sent to the tasks; more are dealt into blocks, as the base rows are, and each pair of blocks is one task.
Tasks keep the nearest of their rows only; distances are products of matrices, taken again exactly for rows that can be among the nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skerry.functions import vectors as V

MAX_CENTROIDS, QUERY_BLOCK, BASE_BLOCK, ASSIGN_ROWS = 65_536, 65_536, 16_384, 1024
#: Blocks of queries and rows whose pairs are emitted; rows a task at least; blocks of a product; single pairs at once.
EMIT_QUERIES, EMIT_ROWS, SPREAD_ROWS, QUERIES_AT_ONCE, ROWS_AT_ONCE, GATHER = 512, 2048, 1000, 1024, 512, 1 << 15
#: A distance by a product differs from the exact one by less than this share of the squared norms.
SLACK = 1e-11
FOUND = "qid long, row_id long, dist double, slot int"
Work = Callable[[pd.DataFrame], object]


def top_per(df: DataFrame, key: str | list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key with ``rank`` from 1; Spark keeps k rows of a key in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to about three tasks a core, or fewer if there are few: comparing a row with every query costs far more than moving it, and small files come as few partitions."""
    return rows.repartition(max(1, min(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))))


def squared(x: np.ndarray, r: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of single pairs, of the same bits for the same two vectors wherever they stand."""
    out = np.empty(len(r))
    for s in range(0, len(r), GATHER):
        out[s : s + GATHER] = ((x[r[s : s + GATHER]] - q[c[s : s + GATHER]]) ** 2).sum(1)
    return out


def ragged(lists: pd.Series, fill) -> np.ndarray:
    """A row for each list, filled up to the longest."""
    out = np.full((len(lists), max(map(len, lists), default=0)), fill)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


class Best:
    """The k smallest values of each list over any number of offers, in memory for k a list. Ties go by the first ``ties`` columns that come with the values."""

    def __init__(self, lists: int, k: int, ties: int, *kinds):
        self.k, self.ties, self.limit = k, ties, np.full(lists, np.inf)
        self.kept = [np.zeros(0, np.int64), np.zeros(0), *(np.zeros(0, t) for t in kinds)]
        self.new: list[list[np.ndarray]] = []

    def places(self, lists: np.ndarray, value: np.ndarray, slack) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ``value`` (rows, lists) that can be among the smallest, where values are right within ``slack``; NaN is never among them."""
        if value.shape[0] > self.k:
            rough = np.flatnonzero(np.isinf(self.limit[lists]))
            if len(rough):
                kth = np.partition(value[:, rough], self.k - 1, axis=0)[self.k - 1]
                kth = np.where(np.isnan(kth), np.inf, kth)
                self.limit[lists[rough]] = kth + (slack[rough] if isinstance(slack, np.ndarray) else slack)
        return np.nonzero(value <= self.limit[lists] + slack)

    def offer(self, lists: np.ndarray, value: np.ndarray, *columns: np.ndarray) -> None:
        if len(value):
            self.new.append([lists, value, *columns])
            if sum(len(x[0]) for x in self.new) > max(1 << 17, len(self.kept[0])):
                self.settled()

    def settled(self) -> list[np.ndarray]:
        """Lists, values and columns of all that is kept, in order."""
        every = [np.concatenate(c) for c in zip(self.kept, *self.new, strict=True)]
        order = np.lexsort((*reversed(every[1 : 2 + self.ties]), every[0]))
        lists = every[0][order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        self.kept, self.new = [c[order[rank < self.k]] for c in every], []
        last = rank == self.k - 1
        self.limit[lists[last]] = every[1][order[last]]
        return self.kept


def offer_nearest(best: Best, lists: np.ndarray, q: np.ndarray, row: np.ndarray, x: np.ndarray, metric: str = "l2") -> None:
    """Offers all rows of ``x`` to the lists of the queries ``q``: by products of blocks, and those that can be among the nearest again by exact distances."""
    xx, qq = (x**2).sum(1), (q**2).sum(1)
    for a in range(0, len(q), QUERIES_AT_ONCE):
        some, own = slice(a, a + QUERIES_AT_ONCE), lists[a : a + QUERIES_AT_ONCE]
        for b in range(0, len(x), ROWS_AT_ONCE):
            part = slice(b, b + ROWS_AT_ONCE)
            value = x[part] @ q[some].T
            value = xx[part, None] + qq[some] - 2 * value if metric == "l2" else -value
            r, c = best.places(own, value, SLACK * (xx[part].max() + qq[some]))
            exact = squared(x[part], r, q[some], c) if metric == "l2" else -(x[part][r] * q[some][c]).sum(1)
            best.offer(own[c], exact, row[part][r])


def against(queries: DataFrame, base: DataFrame, work: Work, schema: str, emits: bool = False) -> DataFrame:
    """``work(queries)`` is begun once in each task; its ``add(base rows)`` and ``end()`` give the rows of the result.

    ``queries``: qid, qvec and what ``work`` reads; ``base``: row_id and what ``work`` reads. At most QUERY_BLOCK queries are sent along with the tasks, and base rows are read where they are, without a shuffle. More
    queries are dealt into blocks, as base rows are, and each pair of blocks is one task; no block is larger than its bound by more than chance. Blocks are smaller where ``work`` emits its pairs.
    """
    n = queries.count()
    if n <= QUERY_BLOCK:
        told = queries.toArrow().to_pandas()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = None
            for pdf in batches:
                if len(pdf) and len(told):
                    mine = mine or work(told)
                    yield from mine.add(pdf)
            if mine:
                yield from mine.end()

        return base.mapInPandas(scan, schema)
    wide, long = (EMIT_QUERIES, EMIT_ROWS) if emits else (QUERY_BLOCK, BASE_BLOCK)
    parts, blocks = -(-n // wide), max(1, -(-base.count() // long))
    deal = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asks = queries.select("*", deal(parts, "qid").alias("part"), every(blocks).alias("block"))
    dealt = base.withColumn("block", deal(blocks, "row_id", "embedding")).withColumn("part", every(parts))
    empty = pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})

    def cell(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return empty
        mine = work(q.drop(columns=["part", "block"]))
        found = [*mine.add(b.drop(columns=["part", "block"])), *mine.end()]
        return pd.concat(found) if found else empty

    return asks.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInPandas(cell, schema)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


class _Nearest:
    """A search's work: the k nearest rows to each query, of the clusters that ``probes`` names if there is one. ``slots``: lists a query, by ``slot`` of the cluster's place among the probes."""

    def __init__(self, queries: pd.DataFrame, k: int, metric: str, centroids: tuple[np.ndarray, np.ndarray] | None = None, nprobe: int = 0, routing: str = "l2", slots: int = 1, slot: Callable[[np.ndarray], np.ndarray] | None = None):
        self.ids, self.q, self.metric, self.slots = queries["qid"].to_numpy(), matrix(queries["qvec"]), metric, slots
        self.best = Best(len(self.ids) * slots, k, 1, np.int64)
        self.clusters = centroids and centroids[0]
        if centroids:
            self.at, self.place, self.cut = probing(self.q, centroids[1], nprobe, routing)
            self.lists = self.at * slots + (slot(self.place) if slot else 0)

    def add(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        row, x = rows["row_id"].to_numpy(), matrix(rows["embedding"])
        if self.clusters is None:
            offer_nearest(self.best, np.arange(len(self.q)), self.q, row, x, self.metric)
            return iter(())
        own = np.searchsorted(self.clusters, rows["cluster_id"].to_numpy())
        for c in np.unique(own):
            mine, s = own == c, slice(self.cut[c], self.cut[c + 1])
            if s.start < s.stop:
                offer_nearest(self.best, self.lists[s], self.q[self.at[s]], row[mine], x[mine], self.metric)
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        lists, value, row = self.best.settled()
        yield pd.DataFrame({"qid": self.ids[lists // self.slots], "row_id": row, "dist": value, "slot": lists % self.slots})


def probing(q: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str = "l2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries by the cluster that they probe: their places, the cluster's place among their probes from 0, and where each cluster's queries begin."""
    step = max(1, (1 << 23) // max(1, centroids.size))
    first = np.concatenate([np.zeros((0, min(nprobe, len(centroids))), np.int64), *(ranked_clusters(q[a : a + step], centroids, metric)[:, :nprobe] for a in range(0, len(q), step))])
    order = np.argsort(first.ravel(), kind="stable")
    return order // max(1, first.shape[1]), order % max(1, first.shape[1]), np.searchsorted(first.ravel()[order], np.arange(len(centroids) + 1))


def exact_search(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, rank, row_id, dist) by brute force. ``queries``: qid, qvec; ``base``: row_id, embedding. Ties go to the smaller row_id."""
    if metric not in ("l2", "ip"):
        raise ValueError(f"no such metric: {metric}")

    out = against(queries.select("qid", "qvec"), spread(base.select("row_id", "embedding")), lambda told: _Nearest(told, k, metric), FOUND)
    return top_per(out, "qid", k, "dist", "row_id").select("qid", "rank", "row_id", "dist")


def centroid_table(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and the matrix of at most MAX_CENTROIDS centroids."""
    rows = centroids.select("cluster_id", "centroid").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r["cluster_id"])
    return np.array([r["cluster_id"] for r in rows]), np.array([r["centroid"] for r in rows], float)


def ranked_clusters(q: np.ndarray, centroids: np.ndarray, metric: str = "l2") -> np.ndarray:
    """For each query the places of all centroids, nearest first; ties to the earlier."""
    score = ((q[:, None] - centroids[None]) ** 2).sum(2) if metric == "l2" and q.size * len(centroids) < 1 << 24 else -2 * (q @ centroids.T) + (centroids**2).sum(1) if metric == "l2" else -(q @ centroids.T)
    return np.argsort(score, axis=1, kind="stable")


def route(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2", nlist: int | None = None) -> DataFrame:
    """(qid, cluster_id, cluster_rank, score): each query's ``nprobe`` nearest clusters; ties to the smaller cluster."""
    nlist = centroids.count() if nlist is None else nlist
    score = V.l2sq(F.col("qvec"), F.col("centroid")) if metric == "l2" else V.neg_ip(F.col("qvec"), F.col("centroid"))
    scored = queries.crossJoin(_small(centroids.select("cluster_id", "centroid"), nlist, MAX_CENTROIDS)).withColumn("score", score)
    return top_per(scored, "qid", min(nprobe, nlist), "score", "cluster_id").select("qid", "qvec", "cluster_id", F.col("rank").alias("cluster_rank"), "score", "centroid")


def route_two_level(queries: DataFrame, centroids: DataFrame, supers: DataFrame, nprobe: int, n_super: int) -> DataFrame:
    """Scores super-centroids first and then only the children of the best ``n_super`` (inner product)."""
    first = top_per(queries.crossJoin(_small(supers, supers.count(), MAX_CENTROIDS)).withColumn("s", V.neg_ip(F.col("qvec"), F.col("super_centroid"))), "qid", n_super, "s", "super_id").select("qid", "qvec", "super_id")
    scored = first.join(centroids, "super_id").withColumn("score", V.neg_ip(F.col("qvec"), F.col("centroid")))
    return top_per(scored, "qid", nprobe, "score", "cluster_id").select("qid", "qvec", "cluster_id", F.col("rank").alias("cluster_rank"), "score", "centroid")


def super_count(nprobe: int, nlist: int, override: int = 0, factor: float = 0.0) -> int:
    """Super-centroids to expand: as given, else ``factor`` a probe, else one for each 128 clusters; between 1 and nlist."""
    want = override or (int(np.ceil(factor * nprobe)) if factor > 0 else -(-nlist // 128))
    return max(1, min(nlist, want))


def child_budget(nprobe: int, nlist: int, factor: int = 1) -> int:
    return min(nlist, max(1, factor) * nprobe)


def probe(probes: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates of all probed clusters, once each."""
    return probes.join(members, "cluster_id").dropDuplicates(["qid", "row_id"])


def rerank(candidates: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact squared distances of the candidates' raw vectors, and the k nearest."""
    full = candidates.join(vectors.select("row_id", "embedding"), "row_id").withColumn("dist", V.l2sq(F.col("qvec"), F.col("embedding")))
    return top_per(full, "qid", k, "dist", "row_id").select("qid", "rank", "row_id", "dist")


def budget(candidates: DataFrame, most: int) -> DataFrame:
    """The ``most`` best candidates of a query by estimate, earlier probes first; 0 keeps all."""
    return top_per(candidates, "qid", most, "est", "cluster_rank", "row_id").drop("rank") if most else candidates


def with_payload(found: DataFrame, payload: DataFrame) -> DataFrame:
    """Payload columns of the final rows alone."""
    return found.join(payload, "row_id", "left")


def _assigned(vectors: DataFrame, centroids: DataFrame, keep: bool) -> DataFrame:
    ids, c = centroid_table(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), ASSIGN_ROWS):
                part = pdf.iloc[s : s + ASSIGN_ROWS]
                x = matrix(part["embedding"])
                near = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
                found = {"row_id": part["row_id"].to_numpy(), "cluster_id": ids[near]}
                yield pd.DataFrame(found | ({"embedding": part["embedding"].to_numpy()} if keep else {"norm": np.sqrt(((x - c[near]) ** 2).sum(1))}))

    last = f"embedding {vectors.schema['embedding'].dataType.simpleString()}" if keep else "norm double"
    return vectors.select("row_id", "embedding").mapInPandas(run, f"row_id long, cluster_id {centroids.schema['cluster_id'].dataType.simpleString()}, {last}")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(row_id, cluster_id, norm): nearest centroid, ties to the smaller cluster, and the distance to it. One pass of matrix products, no shuffle; centroids are bounded by MAX_CENTROIDS."""
    return _assigned(vectors, centroids, False)


def members(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(row_id, cluster_id, embedding): every row in the cluster of its nearest centroid, as :func:`assign` finds it, with its vector."""
    return _assigned(vectors, centroids, True)


def train_centroids(vectors: DataFrame, nlist: int, metric: str = "l2", seed: int = 42, iterations: int = 10) -> DataFrame:
    """(cluster_id, centroid) by K-means; spherical for cosine."""
    if nlist < 1 or not vectors.limit(nlist).count() == nlist:
        raise ValueError("nlist must be between 1 and the number of vectors")
    v = V.l2_normalize(F.col("embedding")) if metric == "cosine" else V.as_double(F.col("embedding"))
    fit = KMeans(k=nlist, seed=seed, maxIter=iterations, distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(vectors.select(array_to_vector(v).alias("features")))
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(fit.clusterCenters())], "cluster_id int, centroid array<double>")


def ivf_search(queries: DataFrame, centroids: DataFrame, members: DataFrame, k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Route, probe and rerank in one pass over ``members`` (cluster_id, row_id, embedding). Only queries that probe a block's clusters are compared with its rows; a large cluster is spread like any rows. Distances are exact and squared, whatever the routing metric."""
    table = centroid_table(centroids)
    out = against(queries.select("qid", "qvec"), members.select("cluster_id", "row_id", "embedding"), lambda told: _Nearest(told, k, "l2", table, nprobe, metric), FOUND)
    return top_per(out, "qid", k, "dist", "row_id").select("qid", "rank", "row_id", "dist")


def search_curve(queries: DataFrame, centroids: DataFrame, members: DataFrame, k: int, steps: tuple[int, ...]) -> DataFrame:
    """(qid, row_id, dist, step): the k nearest rows of each query among the clusters that a number of probes adds to the number before, in one pass. The k nearest after ``steps[i]`` probes are among the rows with ``step`` up to i."""
    table = centroid_table(centroids)
    slot = lambda place: np.searchsorted(np.array(steps), place + 1)
    out = against(queries.select("qid", "qvec"), members.select("cluster_id", "row_id", "embedding"), lambda told: _Nearest(told, k, "l2", table, max(steps), "l2", len(steps), slot), FOUND)
    return top_per(out, ["qid", "slot"], k, "dist", "row_id").select("qid", "row_id", "dist", F.col("slot").alias("step"))


def frontier_search(candidates: DataFrame, k: int, safein: str = "static") -> DataFrame:
    """Classes under moving frontiers, per query in probe order.

    ``candidates``: qid, cluster_rank, row_id, est, margin, safein_d_k. The SafeOut frontier before a cluster is the k-th smallest est + margin of earlier
    clusters' survivors, the SafeIn frontier the k-th smallest est - margin; both are infinite until there are k, and skip numbers that are not finite. ``safein``: "static" holds estimates against safein_d_k,
    "frontier" against the SafeIn frontier, which admits nothing until it is ready. One group is one query's probed candidates, bounded by nprobe clusters.
    """
    if safein not in ("static", "frontier"):
        raise ValueError(f"no such SafeIn threshold: {safein}")

    def kth(best: np.ndarray) -> float:
        return float(best[-1]) if len(best) == k else np.inf

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, upper, lower = [], np.zeros(0), np.zeros(0)
        for _, c in pdf.sort_values(["cluster_rank", "row_id"]).groupby("cluster_rank"):
            d, m, out_at, in_at = c["est"].to_numpy(), c["margin"].to_numpy(), kth(upper), kth(lower)
            threshold = c["safein_d_k"].to_numpy() if safein == "static" else in_at if np.isfinite(in_at) else -np.inf
            cls = np.where(d > out_at + m, "SafeOut", np.where(d < threshold - m, "SafeIn", "Uncertain"))
            out.append(c.assign(cls=cls, frontier=out_at, safein_frontier=in_at))
            stay = cls != "SafeOut"
            upper, lower = (np.sort(np.r_[best, x[stay][np.isfinite(x[stay])]])[:k] for best, x in ((upper, d + m), (lower, d - m)))
        return pd.concat(out)[["qid", "cluster_rank", "row_id", "est", "margin", "cls", "frontier", "safein_frontier"]]

    return candidates.groupBy("qid").applyInPandas(run, "qid long, cluster_rank int, row_id long, est double, margin double, cls string, frontier double, safein_frontier double")


def search_statistics(classed: DataFrame) -> DataFrame:
    """Counts of a search for each query, from :func:`frontier_search`: SafeIn rows are read with their payload, Uncertain ones as vectors, SafeOut ones not at all."""
    said = lambda c: F.count_if(F.col("cls") == c)
    return classed.groupBy("qid").agg(F.countDistinct("cluster_rank").alias("probed"), F.count("*").alias("candidates"), said("SafeOut").alias("safeout"), said("SafeIn").alias("payload_reads"), said("Uncertain").alias("vector_reads"), F.max_by("frontier", "cluster_rank").alias("last_frontier"))


def early_budget(candidates: DataFrame, most: int, every: int) -> DataFrame:
    """Rows that a budget hands out when its best are emitted after each ``every`` clusters: all that are among the ``most`` best by estimate at one of those times, a superset of :func:`budget`'s."""
    last = F.ceil(F.col("cluster_rank") / every).cast("int")
    times = candidates.withColumn("_from", last).join(candidates.groupBy("qid").agg(F.max(last).alias("_last")), "qid").withColumn("_time", F.explode(F.sequence("_from", "_last")))
    w = W.Window.partitionBy("qid", "_time").orderBy("est", "cluster_rank", "row_id")
    best = times.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return best.groupBy(*candidates.columns).agg(F.min("_time").alias("emitted"))


def super_centroids(centroids: DataFrame, n: int, seed: int = 42, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """The hierarchy over centroids by K-means: (cluster_id, centroid, super_id) and (super_id, super_centroid). Centroids are bounded by MAX_CENTROIDS."""
    renamed = centroids.select(F.col("cluster_id").alias("row_id"), F.col("centroid").alias("embedding"))
    supers = train_centroids(renamed, n, seed=seed, iterations=iterations)
    own = assign(renamed, supers).select(F.col("row_id").alias("cluster_id"), F.col("cluster_id").alias("super_id"))
    return centroids.join(own, "cluster_id"), supers.select(F.col("cluster_id").alias("super_id"), F.col("centroid").alias("super_centroid"))


def route_adaptive(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str, threshold: int, n_super: int = 0) -> DataFrame:
    """Two-level routing for inner products over more than ``threshold`` clusters; exact routing otherwise, and where the hierarchy leaves fewer than ``nprobe`` children."""
    nlist = centroids.count()
    if metric != "ip" or nlist <= threshold:
        return route(queries, centroids, nprobe, metric, nlist)
    with_super, supers = super_centroids(centroids, max(1, int(nlist**0.5)))
    found = route_two_level(queries, with_super, supers, nprobe, super_count(nprobe, nlist, n_super)).drop("super_id")
    short = queries.join(found.groupBy("qid").count().filter(F.col("count") >= min(nprobe, nlist)), "qid", "left_anti")
    return found.join(short, "qid", "left_anti").unionByName(route(short, centroids, nprobe, metric, nlist))


def coarse_builder(vectors: DataFrame, nlist: int, train_rows: int, metric: str = "l2", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Centroids trained on the first ``train_rows`` rows by id, and every row's cluster."""
    first = vectors.orderBy("row_id").limit(train_rows)
    centroids = train_centroids(first, nlist, "cosine" if metric in ("ip", "cosine") else "l2", seed)
    rows = vectors.select("row_id", V.l2_normalize(F.col("embedding")).alias("embedding")) if metric == "cosine" else vectors
    return centroids, assign(rows, centroids)


def recover_members(codes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cluster_id, row_id) from an index's payload ids; an error names ids that are not there. ``codes``: cluster_id, external_id; ``ids``: external_id, row_id."""
    lost = codes.join(ids, "external_id", "left_anti").select("external_id").limit(5).collect()
    if lost:
        raise KeyError(f"ids without a row: {[r[0] for r in lost]}")
    return codes.join(ids, "external_id").select("cluster_id", "row_id")


def truth_of_ids(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, rank, row_id) of ground truth given by external ids; null where there is no such row."""
    return truth.join(ids, "external_id", "left").select("qid", "rank", "row_id")


def read_rows(table: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of a table with the given keys, in one semi join whose key range is pushed to the scan; an error for a key without a row."""
    wanted = keys.select(key).distinct()
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    found = table.filter(F.col(key).between(low, high)).join(wanted, key, "left_semi") if low is not None else table.limit(0)
    if found.select(key).distinct().count() != wanted.filter(F.col(key).isNotNull()).count():
        raise KeyError("no row for some keys")
    return found
