"""A data source for vector files that reads row ranges and writes on executors.

Readers need a header only, so a file of any length is many partitions of ROWS_PER_SPLIT rows each. Writers put files beside the folder's name and the driver moves them in once all tasks are done,
so a lost or repeated task leaves nothing behind. Files are reached through Arrow's file systems (local paths, s3, gcs, hdfs); for other stores see ``skerry.sources.vectors``.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS_PER_SPLIT, ROWS_PER_BATCH, NAME = 262_144, 8192, "skerry_vectors"
KINDS = {"<f4": "float", "<i4": "bigint", "<i8": "bigint"}


def file_system(path: str):
    """The file system of a path and the path in it; an error where Arrow knows none."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Layout:
    """Where rows stand in a file."""

    path: str
    rows: int
    width: int
    dtype: str
    start: int
    lead: int  # bytes before each row


def layout(path: str) -> Layout:
    """From a file's header and length; an error where they do not fit together."""
    system, name = file_system(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as f:
        if path.endswith(".npy"):
            head = f.read(12)
            if head[:6] != b"\x93NUMPY":
                raise ValueError(f"no npy file: {path}")
            wide = head[6] > 1
            length = struct.unpack("<I", head[8:12])[0] if wide else struct.unpack("<H", head[8:10])[0]
            start = (12 if wide else 10) + length
            f.seek(12 if wide else 10)
            said = ast.literal_eval(f.read(length).decode("latin1"))
            shape, dtype = said["shape"], said["descr"]
            if dtype not in KINDS or not 1 <= len(shape) <= 2 or (said["fortran_order"] and len(shape) == 2 and min(shape) > 1):
                raise ValueError(f"expected C-ordered float32, int32 or int64 of one or two dimensions: {path}")
            out = Layout(path, shape[0], shape[1] if len(shape) == 2 else 1, dtype, start, 0)
        elif path.endswith((".fvecs", ".ivecs")):
            width = struct.unpack("<i", f.read(4))[0] if size else 0
            if size and (width <= 0 or size % (4 + 4 * width)):
                raise ValueError(f"not a whole number of records: {path}")
            out = Layout(path, size // (4 + 4 * width) if size else 0, width, "<f4" if path.endswith(".fvecs") else "<i4", 0, 4)
        else:
            raise ValueError(f"no vector format: {path}")
    if size < out.start + out.rows * (out.lead + out.width * np.dtype(out.dtype).itemsize):
        raise ValueError(f"shorter than its header says: {path}")
    return out


def files_of(path: str) -> list[str]:
    """The files that a path, a folder or a pattern names, in order."""
    from fnmatch import fnmatch

    from pyarrow import fs

    folder, _, pattern = path.rpartition("/")
    if not any(c in pattern for c in "*?["):
        system, name = file_system(path)
        if system.get_file_info(name).type != fs.FileType.Directory:
            return [path]
        folder, pattern = path.rstrip("/"), "*.*vecs" if any(x.path.endswith("vecs") for x in system.get_file_info(fs.FileSelector(name))) else "*.npy"
    system, name = file_system(folder)
    return sorted(f"{folder}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and fnmatch(x.base_name, pattern))


@dataclass
class Rows(InputPartition):
    layout: Layout
    first: int
    count: int


class VectorReader(DataSourceReader):
    def __init__(self, layouts: list[Layout], rows: int):
        self.layouts, self.rows = layouts, rows

    def partitions(self) -> list[Rows]:
        return [Rows(x, a, min(self.rows, x.rows - a)) for x in self.layouts for a in range(0, x.rows, self.rows)] or [Rows(self.layouts[0], 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        x = partition.layout
        kind = np.dtype(x.dtype)
        step = x.lead + x.width * kind.itemsize
        target = pa.float32() if KINDS[x.dtype] == "float" else pa.int64()
        system, name = file_system(x.path)
        with system.open_input_file(name) as f:
            f.seek(x.start + partition.first * step)
            for a in range(0, partition.count, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.count - a)
                raw = np.frombuffer(f.read(n * step), np.uint8).reshape(n, step)
                if x.lead and (raw[:, :4].copy().view("<i4") != x.width).any():
                    raise ValueError(f"records of different width: {x.path}")
                values = np.ascontiguousarray(raw[:, x.lead :]).view(kind).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.width), pa.array(values).cast(target))
                yield pa.RecordBatch.from_arrays([pa.array([x.path] * n), pa.array(np.arange(partition.first + a, partition.first + a + n)), lists], ["file", "row_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, column: str, kind: str, file_rows: int):
        self.folder, self.column, self.kind, self.file_rows = folder.rstrip("/"), column, kind, file_rows
        self.staging = f"{self.folder}.{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from skerry.sources.vectors import npy_bytes, vecs_bytes

        system, base = file_system(self.staging)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem, files, held, rows = f"part-{context.partitionId():05d}", [], [], 0

        def close(a: np.ndarray) -> None:
            a = a.astype({"fvecs": "<f4", "ivecs": "<i4", "npy": "<i8" if a.dtype.kind == "i" else "<f4"}[self.kind])
            name = f"{stem}-{len(files):05d}.{self.kind}"
            at = f"{base}/{context.taskAttemptId()}-{name}"
            with system.open_output_stream(at) as out:
                out.write(npy_bytes(a) if self.kind == "npy" else vecs_bytes(a, a.dtype.str))
            files.append(at)

        for batch in iterator:
            values = batch.column(batch.schema.get_field_index(self.column))
            if values.null_count:
                raise ValueError("null vector")
            if not len(values):
                continue
            a = np.array(values.to_pylist()) if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else values.to_numpy(zero_copy_only=False)
            held.append(a)
            rows += len(a)
            while rows >= self.file_rows:
                whole = np.concatenate(held)
                close(whole[: self.file_rows])
                held, rows = [whole[self.file_rows :]], len(whole) - self.file_rows
        if rows:
            close(np.concatenate(held))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.folder)
        system.create_dir(base, recursive=True)
        for message in messages:
            for at in message.files if message else ():
                system.move(at, f"{base}/{at.rpartition('/')[2].partition('-')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = file_system(self.staging)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class VectorSource(DataSource):
    """Options: path, split_rows; for writing, column, kind and file_rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _layouts(self) -> list[Layout]:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no files: {self.options['path']}")
        found = [layout(f) for f in files]
        if len({KINDS[x.dtype] for x in found}) > 1:
            raise ValueError("files of different kinds")
        return found

    def schema(self) -> str:
        return f"file string, row_id long, embedding array<{KINDS[self._layouts()[0].dtype]}>"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self._layouts(), int(self.options.get("split_rows", ROWS_PER_SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], self.options["column"], self.options["kind"], int(self.options["file_rows"]))


def read_ranges(spark, path: str, split_rows: int = ROWS_PER_SPLIT):
    """(file, row_id, embedding) of a file, folder or pattern, by row ranges."""
    spark.dataSource.register(VectorSource)
    return spark.read.format(NAME).option("path", path).option("split_rows", str(split_rows)).load()


def write_ranges(df, folder: str, column: str = "embedding", kind: str = "fvecs", file_rows: int = ROWS_PER_SPLIT) -> int:
    """Rows of ``column`` in their order as files ``part-PARTITION-NUMBER`` of .fvecs, .ivecs or .npy, written by the tasks; returns the number of files. Null vectors are refused, and nothing is left of a run that failed."""
    if kind not in ("fvecs", "ivecs", "npy"):
        raise ValueError(f"no vector format: {kind}")
    df.sparkSession.dataSource.register(VectorSource)
    df.select(column).write.format(NAME).mode("append").option("path", folder).option("column", column).option("kind", kind).option("file_rows", str(file_rows)).save()
    from pyarrow import fs

    system, base = file_system(folder)
    return sum(x.path.endswith(kind) for x in system.get_file_info(fs.FileSelector(base)))
