"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates and queries are dealt into blocks of bounded size, and each pair of a query block and a candidate block is one task, which sorts its lists once for up to QUERY_BLOCK queries. There every
dimension has its list of candidates sorted by component; a query walks each list from the end that its own component's sign
favours, the faster the larger that component is, scores the candidates it meets in full, and stops once the sum of the components at its positions, the most that
any candidate not yet met could score, is below the k-th score. (An equal bound goes on, as a smaller id wins a tie.) Positions advance in growing steps.
Scores are matrix products of whole numbers in double precision, exact below 2**53. Block results are merged by a ranked window, whose partial step keeps k rows of each task.

Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded with zeros. Rows with a null id take no part. A row is no
candidate for queries of its own id, and repeated rows count once. An empty table gives no rows. Columns besides id and vector are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

K, SCALE, EVERY = 5, 256, 50
CANDIDATE_BLOCK, QUERY_BLOCK, FIRST_STEP, GROWTH = 8192, 4096, 16, 2.0


def threshold_top_k(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and row numbers of one query's best, by score, then id, and how many rows were met. ``order``: for each dimension the rows in ascending component. Vectors hold whole numbers as doubles."""
    n = len(vectors)
    used = np.flatnonzero(query)
    seen, score = np.zeros(n, bool), np.zeros(n)
    pace = np.abs(query[used]) / np.abs(query[used]).max() if len(used) else np.ones(0)
    depth, step, at = np.zeros(len(used), np.int64), float(FIRST_STEP), 0.0
    while not seen.all():
        at, step = at + step, step * GROWTH
        upto = np.minimum(n, np.ceil(at * pace).astype(np.int64))
        fresh = np.full(n, not len(used))
        for d, a, b in zip(used.tolist(), depth.tolist(), upto.tolist(), strict=True):
            fresh[order[d, n - b : n - a] if query[d] > 0 else order[d, a:b]] = True
        fresh &= ~seen
        met = np.flatnonzero(fresh)
        seen |= fresh
        score[met] = vectors[met] @ query
        depth = upto
        if not len(used):
            break
        reached = order[used, np.where(query[used] > 0, n - depth, depth - 1)]
        bound = float((query[used] * vectors[reached, used]).sum())
        good = np.flatnonzero(seen & (ids != own))
        if len(good) >= k and np.partition(score[good], len(good) - k)[len(good) - k] > bound:
            break
    good = np.flatnonzero(seen & (ids != own))
    best = good[np.lexsort((ids[good], -score[good]))[:k]]
    return score[best].astype(np.int64), best, int(seen.sum())


def _cell(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(rows):
            width = max(map(len, [*queries["v"], *rows["v"]]))
            x, q = np.zeros((len(rows), width)), np.zeros((len(queries), width))
            for m, vs in ((x, rows["v"]), (q, queries["v"])):
                for i, v in enumerate(vs):
                    m[i, : len(v)] = v
            ids = rows["id"].to_numpy()
            order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
            for qid, vector in zip(queries["id"].tolist(), q, strict=True):
                score, best, _ = threshold_top_k(vector, qid, x, ids, order, k)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    return run


def quantise(embedding: Column) -> Column:
    """floor(256 x) of each component, or null where the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``vectors`` and ``queries``: id long, v array<long>. Returns query_id, rank, vec_id, score."""
    vectors, queries = (df.filter("id is not null and v is not null").select("id", "v").distinct() for df in (vectors, queries))
    blocks = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("id", "v", deal(blocks).alias("block"), every(query_blocks).alias("part"))
    asks = queries.select("id", "v", deal(query_blocks).alias("part"), every(blocks).alias("block"))
    found = asks.groupBy("part", "block").cogroup(rows.groupBy("part", "block")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantise(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter(f"id % {EVERY} = 0"))


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
