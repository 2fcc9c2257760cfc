"""Work around an index: comparisons of two, migration, threshold samples, and a benchmark run over files."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import layouts as L
from skerry.functions import vectors as V
from skerry.operators import analysis as A
from skerry.operators import search as S
from skerry.plans import index as I
from skerry.sources import vectors as R


def compare_estimates(a: I.Index, b: I.Index, queries: DataFrame, nprobe: int, tolerance: float = 1e-6) -> DataFrame:
    """One row: candidates of both indexes, those in one alone, and those whose estimates differ by more than ``tolerance``."""
    keep = lambda x, k: x.candidates(queries, nprobe).select("qid", "row_id", F.col("est1").alias(f"{k}1"), F.col("est2").alias(f"{k}2"))
    both = keep(a, "a").join(keep(b, "b"), ["qid", "row_id"], "full")
    apart = lambda k: F.count_if(F.abs(F.col(f"a{k}") - F.col(f"b{k}")) > tolerance).alias(f"different_{k}")
    return both.agg(F.count("*").alias("candidates"), F.count_if(F.col("a1").isNull() | F.col("b1").isNull()).alias("in_one"), apart(1), apart(2))


def compare_codes(a: I.Index, b: I.Index) -> DataFrame:
    """One row: rows of both indexes, those in one alone, and those with another cluster or other levels."""
    keep = lambda x, k: x.codes.select("row_id", F.struct("cluster_id", "levels").alias(k))
    both = keep(a, "a").join(keep(b, "b"), "row_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("in_one"), F.count_if(F.col("a") != F.col("b")).alias("different"))


def migrate(index: I.Index, path: str) -> I.Index:
    """The index written again under ``path`` in this version's form; codes, records and settings stay as they are."""
    spark = index.codes.sparkSession
    for name in ("records", "codes", "centroids"):
        getattr(index, name).write.parquet(f"{path}/{name}")
    row = (I.VERSION, index.dim, index.nlist, index.ex_bits, index.seed, index.metric)
    spark.createDataFrame([row], "version int, dim int, nlist int, ex_bits int, seed long, metric string").coalesce(1).write.parquet(f"{path}/settings")
    return I.open_index(spark, path)


def threshold_samples(index: I.Index, queries: DataFrame, k: int, p: float, folder: str, nprobe: int | None = None) -> dict[str, float]:
    """Writes each query's k-th smallest stage-2 estimate as .npy, over all clusters or ``nprobe``, and returns their number and the threshold that ``p`` gives."""
    kth = A.d_k_samples(index.candidates(queries, nprobe or index.nlist), k, "est2").orderBy("qid")
    R.write_vectors(kth.select(F.array(F.col("kth").cast("float")).alias("kth")), folder, "kth", "npy")
    return {"samples": kth.count(), "d_k": A.calibrate_d_k(kth, p)}


def plane_report(index: I.Index) -> DataFrame:
    """(plane, ones, zero_words, entropy, bytes) of the magnitudes' bit planes over all codes, by partial sums."""
    bits, dim = index.ex_bits, index.dim

    def count(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                planes = L.pack_planes((np.abs(np.stack(pdf["levels"].to_numpy())) - 1) // 2, bits)
                for k in range(bits):
                    words = np.pad(planes[:, k], ((0, 0), (0, -planes.shape[2] % 8))).reshape(-1, 8)
                    yield pd.DataFrame({"plane": [k], "ones": [int(np.unpackbits(planes[:, k]).sum())], "zero": [int((words == 0).all(1).sum())], "words": [len(words)], "n": [len(pdf)]})

    parts = index.codes.select("levels").mapInPandas(count, "plane int, ones long, zero long, words long, n long")
    total = parts.groupBy("plane").agg(*(F.sum(c).alias(c) for c in ("ones", "zero", "words", "n")))
    p = F.col("ones") / (F.col("n") * dim)
    term = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return total.select("plane", p.alias("ones"), (F.col("zero") / F.col("words")).alias("zero_words"), (term(p) + term(1 - p)).alias("entropy"), (F.col("n") * L.magnitude_bytes(dim, 1)).alias("bytes"))


def benchmark(spark: SparkSession, base: str, queries: str, truth: str | None, work: str, nlist: int, nprobes: list[int], k: int = 10, metric: str = "l2", progress: Callable[[str], None] | None = None) -> DataFrame:
    """A run over vector files: clusters, index, calibration, and for each nprobe the recall against the truth file (or brute force) with the seconds of the whole batch. (nprobe, queries, recall, seconds)"""
    tell = progress or (lambda what: None)
    rows = R.read_vectors(spark, base).select("row_id", "embedding")
    asks = R.read_vectors(spark, queries).select(F.col("row_id").alias("qid"), V.as_double(F.col("embedding")).alias("qvec"))
    tell("clusters")
    centroids, _ = S.coarse_builder(rows, nlist, 100_000, metric)
    tell("index")
    index = I.build(rows, centroids, f"{work}/index", metric=metric)
    tell("truth")
    right = R.ground_truth(R.read_vectors(spark, truth), k).select("qid", "row_id") if truth else S.exact_search(asks, rows, k).select("qid", "row_id")
    sample = A.sample_without_replacement(rows, "row_id", 100).select(F.col("row_id").alias("qid"), V.as_double(F.col("embedding")).alias("qvec"))
    bound = 1.25 * index.error_bound(sample, max(nprobes))
    n, out = asks.count(), []
    for nprobe in nprobes:
        tell(f"nprobe {nprobe}")
        began = time.time()
        index.search(asks, k, nprobe, bound, payload=[]).write.parquet(f"{work}/found-{nprobe}")
        took = time.time() - began
        out.append((nprobe, n, spark.read.parquet(f"{work}/found-{nprobe}").join(right, ["qid", "row_id"]).count() / max(1, min(k, index.records.count()) * n), took))
    return spark.createDataFrame(out, "nprobe int, queries long, recall double, seconds double")


def kernel_seconds(dim: int = 512, rows: int = 4096, bits: int = 3, rounds: int = 3) -> dict[str, float]:
    """Least seconds of an inner product with all rows from each layout, unpacking included."""
    rng = np.random.default_rng(0)
    values, q = rng.integers(0, 1 << bits, (rows, dim)), rng.normal(size=dim)
    out = {}
    for layout in sorted(set(L.LAYOUTS.values())):
        raw, best = L.pack(values, bits, layout), float("inf")
        for _ in range(rounds):
            began = time.perf_counter()
            L.unpack(raw, bits, dim, layout) @ q
            best = min(best, time.perf_counter() - began)
        out[layout] = best
    return out
