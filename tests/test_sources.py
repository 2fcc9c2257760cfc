"""Vector files by row ranges, blobs, adapters and samples."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import analysis as A
from skerry.sources import ranges as G
from skerry.sources import vectors as R


def test_ranges_of_several_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 6)).astype("<f4")
    (tmp_path / "a.fvecs").write_bytes(R.vecs_bytes(x[:25]))
    (tmp_path / "b.fvecs").write_bytes(R.vecs_bytes(x[25:]))
    got = G.read_ranges(spark, f"{tmp_path}/*.fvecs", 7)
    assert got.rdd.getNumPartitions() == 4 + 3
    assert [list(r["embedding"]) for r in got.orderBy("file", "row_id").collect()] == x.tolist()
    assert G.read_ranges(spark, str(tmp_path)).count() == 40


@pytest.mark.parametrize("values", [np.arange(12, dtype="<i8"), np.arange(12, dtype="<i4").reshape(4, 3), np.arange(12, dtype="<f4").reshape(6, 2), np.arange(12, dtype="<i8").reshape(2, 6)])
def test_npy_kinds(spark, tmp_path, values):
    np.save(tmp_path / "x.npy", values)
    got = [list(r["embedding"]) for r in R.read_vectors(spark, str(tmp_path / "x.npy")).orderBy("row_id").collect()]
    assert got == values.reshape(len(values), -1).tolist()


def test_files_that_do_not_fit(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2), "<f4")))
    np.save(tmp_path / "d.npy", np.ones(3))
    (tmp_path / "s.fvecs").write_bytes(b"\x02\x00\x00\x00" + bytes(7))
    (tmp_path / "w.ivecs").write_bytes(R.vecs_bytes(np.ones((1, 2)), "<i4") + b"\x01\x00\x00\x00" + bytes(8))
    (tmp_path / "n.npy").write_bytes(b"nothing of the kind")
    for name in ("f.npy", "d.npy", "s.fvecs", "w.ivecs", "n.npy"):
        with pytest.raises(Exception, match="expected|whole number|different width|no npy|DATA_SOURCE|ValueError"):
            R.read_vectors(spark, str(tmp_path / name)).collect()
    (tmp_path / "e.fvecs").write_bytes(b"")
    assert R.read_vectors(spark, str(tmp_path / "e.fvecs")).isEmpty()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "row_id long, embedding array<float>")
    with pytest.raises(Exception, match="null vector"):
        R.write_vectors(df, str(tmp_path / "out"), kind="npy")
    assert list(tmp_path.iterdir()) == []
    assert R.write_vectors(df.filter("row_id = 0").repartition(3), str(tmp_path / "out"), kind="ivecs") == 1


def test_blob_slices(spark, tmp_path):
    blob = bytes(range(200))
    (tmp_path / "blob").write_bytes(blob)
    index = spark.createDataFrame([(i, i * 7, i % 5) for i in range(20)] + [(20, 200, 0)], "row_id long, offset long, length long")
    assert {r["row_id"]: bytes(r["payload"]) for r in R.payload_slices(spark, str(tmp_path / "blob"), index).collect()} == {r["row_id"]: blob[r["offset"] : r["offset"] + r["length"]] for r in index.collect()}
    for bad in ((0, -1, 1), (0, 199, 2), (0, 3, -1)):
        with pytest.raises(ValueError):
            R.payload_slices(spark, str(tmp_path / "blob"), spark.createDataFrame([bad], index.schema))


def test_columns_and_truth(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, name string, more double")
    R.write_columns(df, str(tmp_path / "t"), ["id", "name"])
    assert R.read_columns(spark, str(tmp_path / "t")).columns == ["id", "name"] and R.read_columns(spark, str(tmp_path / "t"), ["name"]).collect()[0][0] == "a"
    for f in (lambda: R.write_columns(df, str(tmp_path / "u"), ["absent"]), lambda: R.read_columns(spark, str(tmp_path / "t"), ["more"])):
        with pytest.raises(KeyError):
            f()
    rows = spark.createDataFrame([(0, [5, 6, 7]), (1, [8, 9, 5])], "row_id long, embedding array<bigint>")
    assert sorted(tuple(r) for r in R.ground_truth(rows, 2).collect()) == [(0, 0, 5), (0, 1, 6), (1, 0, 8), (1, 1, 9)]
    with pytest.raises(ValueError):
        R.ground_truth(rows, 4)


def test_adapters(spark, tmp_path):
    spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "pid long, passage string").write.parquet(str(tmp_path / "p"))
    table = R.passages(spark, str(tmp_path / "p"), 3)
    assert [(r["row_id"], json.loads(r["metadata"])) for r in table.orderBy("row_id").collect()] == [(k, {"pid": p, "passage": t}) for k, (p, t) in enumerate([(10, "a"), (20, "b"), (30, "c")])]
    with pytest.raises(ValueError):
        R.passages(spark, str(tmp_path / "p"), 4)
    truth = spark.createDataFrame([(0, 0, 30), (0, 1, 20), (1, 0, 10)], "qid long, rank long, pid long")
    assert [(r["pid"], r["row_id"], r["source_row"]) for r in R.subset_by_truth(table, truth, 1).orderBy("row_id").collect()] == [(10, 0, 0), (30, 1, 2)]
    np.save(tmp_path / "ids.npy", np.array([7, 5, 9], "<i8"))
    assert [tuple(r) for r in R.ordered_ids(spark, str(tmp_path / "ids.npy")).orderBy("row_id").collect()] == [(0, 7), (1, 5), (2, 9)]
    frames = spark.createDataFrame([("v", [3.0, 0.0], [1.0]), ("v", [5.0, 0.0], [5.0]), ("z", [0.0, 0.0], [0.0])], "video_id string, rgb array<double>, audio array<double>")
    got = {r["video_id"]: list(r["embedding"]) for r in R.pooled_frames(frames).collect()}
    assert np.allclose(got["v"], [0.8, 0, 0.6]) and got["z"] == [0, 0, 0]


def test_numbers_samples_and_codes(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k")).repartition(5)
    assert all(r["k"] == r["place"] for r in A.numbered(df, "k").collect())
    drawn = A.sample_with_replacement(df, "k", 300).collect()
    assert len(drawn) == 300 and 80 < len({r["k"] for r in drawn}) < 100 and sorted(r["draw"] for r in drawn) == list(range(300))
    assert A.sample_with_replacement(df.limit(0), "k", 3).isEmpty()
    once = [r["k"] for r in A.sample_without_replacement(df, "k", 40).collect()]
    assert len(set(once)) == 40 and once == [r["k"] for r in A.sample_without_replacement(df, "k", 40).collect()]
    words = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "w string, at long")
    codes = A.dictionary(words, "w", "at")
    back = A.decode(spark.createDataFrame([(0,), (1,), (9,)], "code int"), codes, "w")
    assert {r["code"]: r["w"] for r in back.collect()} == {0: "b", 1: "a", 9: ""}
    assert A.max_or_zero(df.limit(0), "k") == 0 and A.max_or_zero(df, "k") == 99
    assert [A.kth_place(10, 50), A.kth_place(10, 50, True), A.kth_place(10, 5)] == [9, 10, 4] and [A.upper_index_double(p, 10) for p in (-1, 0.5, 2)] == [0, 4, 9]
