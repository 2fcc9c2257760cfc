"""Vector files as DataFrames: fvecs, ivecs, npy; numbered json lines; payload blobs; and sinks for the same formats.

Files are read by row ranges and written by the tasks where Arrow's file systems reach them (see ``ranges``), else by Spark as whole files, so any store that Spark knows will do.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from skerry.functions import vectors as V
from skerry.operators.analysis import numbered
from skerry.sources.ranges import file_system, read_ranges, write_ranges


def reachable(path: str) -> bool:
    """Whether Arrow's file systems can open the path; else Spark reads and writes whole files, of less than 2 GB each."""
    try:
        file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def parse_vecs(raw: bytes, dtype: str) -> np.ndarray:
    """Records of an int32 width and so many values; every width must equal the first."""
    if not raw:
        return np.zeros((0, 0), dtype)
    dim = int(np.frombuffer(raw, "<i4", 1)[0])
    if dim <= 0 or len(raw) % (4 + 4 * dim):
        raise ValueError("not a whole number of records")
    rows = np.frombuffer(raw, "<i4").reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError("records of different width")
    return rows[:, 1:].copy().view(dtype)


def parse_npy(raw: bytes, dtype: str) -> np.ndarray:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.dtype != np.dtype(dtype) or a.ndim > 2 or (a.ndim == 2 and np.isfortran(a)):
        raise ValueError(f"expected C-ordered {dtype}, found {a.dtype}, {a.ndim} dimensions")
    return a.reshape(len(a), -1)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_id, embedding) by extension: .fvecs, .ivecs or .npy (float32, int32, int64)."""
    end = path.rpartition(".")[2]
    if end not in ("fvecs", "ivecs", "npy"):
        raise ValueError(f"no vector format: {path}")
    if reachable(path):
        return read_ranges(spark, path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                if end == "npy":
                    kind = np.load(io.BytesIO(raw), allow_pickle=False).dtype.str
                    a = parse_npy(raw, kind if kind in ("<f4", "<i4", "<i8") else "<f4")
                else:
                    a = parse_vecs(raw, "<f4" if end == "fvecs" else "<i4")
                yield pd.DataFrame({"file": name, "row_id": np.arange(len(a)), "embedding": list(a.astype(np.float32 if end != "ivecs" and a.dtype.kind == "f" else np.int64))})

    whole = end == "ivecs"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if end == "npy":
        header = files.select(F.substring("content", 1, 128)).first()
        whole = header is not None and b"<i" in bytes(header[0])
    return files.mapInPandas(parse, f"file string, row_id long, embedding array<{'bigint' if whole else 'float'}>")


def ground_truth(rows: DataFrame, k: int) -> DataFrame:
    """(qid, rank, row_id) of id lists; an error if any list is shorter than k."""
    if rows.filter(F.size("embedding") < k).limit(1).count():
        raise ValueError(f"fewer than {k} neighbours")
    return rows.select(F.col("row_id").alias("qid"), F.posexplode(F.slice("embedding", 1, k)).alias("rank", "row_id"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, image_id, caption): blank lines are neither kept nor numbered; -1 for no id.

    Numbers run on over partitions by per-partition counts, so no row moves to one task.
    """
    text = spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    placed = text.withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    line = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(before), "part")  # a row for each input split
    return out.select(line.alias("line_no"), F.coalesce(F.get_json_object("value", "$.image_id").cast("long"), F.lit(-1)).alias("image_id"), F.get_json_object("value", "$.caption").alias("caption"))


def payload_slices(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(row_id, payload) by (row_id, offset, length) of a blob file; an error if a slice leaves it. Slices are range-sorted by offset, so a task reads one stretch of the file, in pieces; the blob is never held whole."""
    system, name = file_system(path)
    size = system.get_file_info(name).size
    if index.filter((F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") + F.col("length") > size)).limit(1).count():
        raise ValueError("slice outside the blob")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, name = file_system(path)
        with system.open_input_file(name) as f:
            for pdf in batches:
                for s in range(0, len(pdf), 1024):
                    part = pdf.iloc[s : s + 1024]
                    yield pd.DataFrame({"row_id": part["row_id"], "payload": [f.read_at(n, o) for o, n in zip(part["offset"].tolist(), part["length"].tolist(), strict=True)]})

    return index.select("row_id", "offset", "length").repartitionByRange("offset").sortWithinPartitions("offset").mapInPandas(cut, "row_id long, payload binary")


def ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, external_id) of an id file: one id a row."""
    return read_vectors(spark, path).select("row_id", F.element_at("embedding", 1).alias("external_id"))


def subset_by_truth(passages: DataFrame, truth: DataFrame, k: int, key: str = "pid") -> DataFrame:
    """Passages that are among the first ``k`` neighbours of some query, with new dense row numbers in the old order. ``truth``: qid, rank, and the key; ``passages``: row_id, the key, text columns."""
    wanted = truth.filter(F.col("rank") < k).select(key).distinct()
    kept = passages.join(wanted, key, "left_semi").withColumnRenamed("row_id", "source_row")
    return numbered(kept, "source_row").withColumnRenamed("place", "row_id")


def passages(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(row_id, metadata, columns of the table) of a table of passages in its order by ``pid``; metadata is one json object a row. An error if there are not ``rows`` of them."""
    table = spark.read.parquet(path)
    out = numbered(table, "pid").withColumnRenamed("place", "row_id").withColumn("metadata", F.to_json(F.struct(*table.columns)))
    if rows is not None and out.count() != rows:
        raise ValueError(f"expected {rows} passages")
    return out


def pooled_frames(frames: DataFrame) -> DataFrame:
    """(video_id, embedding): unit vectors of the mean picture features followed by the mean sound features. ``frames``: video_id, rgb, audio; partial means, so a long video is not held whole."""
    means = frames.groupBy("video_id").agg(*(Summarizer.mean(array_to_vector(V.as_double(F.col(c)))).alias(c) for c in ("rgb", "audio")))
    whole = F.concat(*(vector_to_array(c) for c in ("rgb", "audio")))
    return means.select("video_id", V.l2_normalize(whole).alias("embedding"))


def vecs_bytes(rows: np.ndarray, dtype: str = "<f4") -> bytes:
    out = np.empty((len(rows), rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = np.ascontiguousarray(rows, dtype).view("<i4")
    return out.tobytes()


def write_columns(df: DataFrame, path: str, required: list[str]) -> None:
    """A columnar table; every required column must be there, others are left out."""
    if missing := [c for c in required if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    df.select(*required).write.mode("errorifexists").parquet(path)


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if missing := [c for c in columns or () if c not in table.columns]:
        raise KeyError(f"no such columns: {missing}")
    return table.select(*columns) if columns else table


def npy_bytes(rows: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(rows), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def write_vectors(df: DataFrame, folder: str, column: str = "embedding", kind: str = "fvecs", file_rows: int = 262_144) -> int:
    """Rows of ``column`` (arrays, or numbers for npy) in their order as files ``part-NNNNN`` of .fvecs, .ivecs or .npy; returns the number of files.

    Tasks write their own files of at most ``file_rows`` rows. Only to a store that Arrow cannot reach they pass through the driver, one at a time. Null vectors are refused.
    """
    if kind not in ("fvecs", "ivecs", "npy"):
        raise ValueError(f"no vector format: {kind}")
    if reachable(folder):
        return write_ranges(df, folder, column, kind, file_rows)

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            if pdf[column].isna().any():
                raise ValueError("null vector")
            held += pdf[column].tolist()
            while len(held) >= file_rows:
                yield shape(held[:file_rows])
                held = held[file_rows:]
        if held:
            yield shape(held)

    def shape(rows: list) -> pd.DataFrame:
        a = np.array(rows)
        a = a.astype({"fvecs": "<f4", "ivecs": "<i4", "npy": "<i8" if a.dtype.kind == "i" else "<f4"}[kind])
        return pd.DataFrame({"raw": [npy_bytes(a) if kind == "npy" else vecs_bytes(a, a.dtype.str)]})

    spark, n = df.sparkSession, 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in df.select(column).mapInPandas(blobs, "raw binary").toLocalIterator():
        path = hadoop(f"{folder}/part-{n:05d}.{kind}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytes(row["raw"]))
        out.close()
        n += 1
    return n


def export_clustering(centroids: DataFrame, members: DataFrame, folder: str) -> None:
    """Centroids (.fvecs, by cluster) and each row's cluster (.ivecs of width 1, by row)."""
    write_vectors(centroids.orderBy("cluster_id"), f"{folder}/centroids", "centroid", "fvecs")
    write_vectors(members.orderBy("row_id").select(F.array(F.col("cluster_id").cast("int")).alias("cluster")), f"{folder}/assignments", "cluster", "ivecs")
