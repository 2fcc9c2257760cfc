import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry import catalog
from skerry.functions import codes as C
from skerry.functions import vectors as V
from skerry.operators import analysis as A
from skerry.operators import search as S
from skerry.plans import index as I
from skerry.plans.inspect import plan_nodes
from skerry.sources import vectors as R


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf, same, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name])


def test_all_clusters_give_the_exact_answer(spark, sf):
    base = catalog._base(spark, sf)
    q, cent = catalog._queries(spark, sf), catalog._centroids(base)
    a = S.ivf_search(q, cent, base, 10, 99).select("qid", "rank", "row_id")
    b = S.exact_search(q, base, 10).select("qid", "rank", "row_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["ivf_search", "index_search"])
def test_searches_find_nine_of_ten(spark, name):
    """Recall against brute force over a whole table, as the index is held to."""
    sf = "/root/testdata/sf0.01"
    truth = catalog.exact_search(spark, sf).select("qid", "row_id")
    assert truth.join(catalog.QUERIES[name](spark, sf), ["qid", "row_id"]).count() >= 0.9 * truth.count()


def test_no_probe_gives_nothing(spark, sf):
    base = catalog._base(spark, sf)
    assert S.route(catalog._queries(spark, sf), catalog._centroids(base), 0).isEmpty()


def test_candidates_are_found_without_a_cross_product(spark, sf):
    assert not plan_nodes(catalog._candidates(spark, sf))["CartesianProduct"]


@pytest.mark.parametrize("dim", [16, 64, 192, 70])
def test_rotation_is_orthogonal(dim):
    x = np.random.default_rng(0).normal(size=(5, dim))
    r = C.Rotation(dim)
    assert np.allclose(r.invert(r.apply(x)), x) and np.allclose(np.linalg.norm(r.apply(x), axis=1), np.linalg.norm(x, axis=1))


def test_more_bits_estimate_better():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(200, 64)), rng.normal(size=64)
    true = ((x - q) ** 2).sum(1)
    rotation, scale = C.Rotation(64), C.scale_for(64, 3)
    code = C.encode(x, rotation, 3, scale)
    errors = [np.abs(C.estimate(q, code, rotation, stage) - true).mean() for stage in (1, 2)]
    assert errors[1] < errors[0] / 3
    sign, magnitude = C.unpack(C.pack(code), 64)
    assert (sign == code["sign"]).all() and (magnitude == code["magnitude"]).all()


def test_zero_vector_codes():
    code = C.encode(np.zeros((1, 64)), C.Rotation(64), 3, 10.0)
    assert np.isfinite(C.estimate(np.ones(64), code, C.Rotation(64))).all()


def test_bit_packing():
    v = np.array([0, 5, 7, 3, 1])
    assert C.bit_width(v) == 3 and C.bit_width(np.array([300])) == 0 and C.bit_width(np.zeros(2, int)) == 1
    assert (C.bit_unpack(C.bit_pack(v, 3), 3, 5) == v).all()


def test_low_index_is_float32():
    assert A.low_index(0.99, 100) == 0 and A.low_index(0.5, 10) == 5


def test_strict_class_bounds(spark):
    df = spark.range(1).select(V.classify(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("a"), V.classify_margin(F.lit(5.0), F.lit(1.0), F.lit(9.0), F.lit(1.0)).alias("b"), V.recall_at(F.array(F.lit(1)), F.array().cast("array<int>"), 1).alias("c"))
    assert tuple(df.first()) == ("Uncertain", "SafeOut", 0.0)


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(R.vecs_bytes(x))
    np.save(tmp_path / "b.npy", x)
    for name in ("a.fvecs", "b.npy"):
        got = R.read_vectors(spark, str(tmp_path / name)).orderBy("row_id").collect()
        assert [list(r["embedding"]) for r in got] == x.tolist()
    with pytest.raises(ValueError):
        R.parse_vecs(b"\x01\x00\x00\x00", "<f4")
    with pytest.raises(ValueError):
        R.read_vectors(spark, "x.txt")


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image_id": 7, "caption": "a \\"b\\""}\n \t\n{"caption": ""}\n')
    got = [tuple(r) for r in R.read_json_lines(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()]
    assert got == [(0, 7, 'a "b"'), (1, -1, "")]


def test_stream_append(spark, sf, tmp_path):
    from skerry.streaming.ingest import append

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    append(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["event_id", "value"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def _index(spark, sf, folder, bits=3):
    base = catalog._base(spark, sf).withColumn("kind", F.col("cluster_id"))
    return I.build(base.drop("cluster_id"), catalog._centroids(base), str(folder), bits)


def test_index_of_all_clusters_gives_the_exact_answer(spark, sf, tmp_path):
    _index(spark, sf, tmp_path / "i")
    index = I.open_index(spark, str(tmp_path / "i"))
    q = catalog._queries(spark, sf)
    found = index.search(q, 10, 99, index.error_bound(q, 99))
    assert found.columns == ["qid", "rank", "row_id", "dist", "kind"]
    a, b = found.select("qid", "rank", "row_id"), S.exact_search(q, catalog._base(spark, sf), 10).select("qid", "rank", "row_id")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    everything = index.candidates(q, 99).count()
    assert index.survivors(q, 10, 99, index.error_bound(q, 99)).count() < everything / 2
    assert index.survivors(q, 10, 99, 1.0, 20).groupBy("qid").count().agg(F.max("count")).first()[0] == 20


def test_index_estimates_match_numpy(spark, sf, tmp_path):
    index = _index(spark, sf, tmp_path / "i")
    q = catalog._queries(spark, sf).limit(2)
    rotation, scale = C.Rotation(64), C.scale_for(64, 3)
    cent = {r["cluster_id"]: np.array(r["centroid"]) for r in index.centroids.collect()}
    x = {r["row_id"]: np.array(r["embedding"], float) for r in index.records.collect()}
    queries = {r["qid"]: np.array(r["qvec"]) for r in q.collect()}
    for r in index.candidates(q, 2).collect():
        code = C.encode((x[r["row_id"]] - cent[r["cluster_id"]])[None], rotation, 3, scale)
        for stage in (1, 2):
            assert abs(r[f"est{stage}"] - C.estimate(queries[r["qid"]] - cent[r["cluster_id"]], code, rotation, stage)[0]) < 1e-6


def test_index_odd_rows(spark, sf, tmp_path):
    base = catalog._base(spark, sf)
    bad = spark.createDataFrame([(-1, None), (-2, [float("nan")] * 64), (-3, [None] * 64)], "row_id long, embedding array<float>")
    index = I.build(base.select("row_id", "embedding").union(bad), catalog._centroids(base), str(tmp_path / "i"), 0)
    assert index.codes.count() == base.count() and index.search(catalog._queries(spark, sf), 3, 2, 1.0).columns == ["qid", "rank", "row_id", "dist"]
    with pytest.raises(ValueError):
        I.build(base.limit(0), catalog._centroids(base), str(tmp_path / "none"))
    with pytest.raises(KeyError):
        index.search(catalog._queries(spark, sf), 3, 2, 1.0, payload=["absent"])
    spark.createDataFrame([(9, 64, 10, 3, 42, "l2")], "version int, dim int, nlist int, ex_bits int, seed long, metric string").write.mode("overwrite").parquet(str(tmp_path / "i/settings"))
    with pytest.raises(ValueError):
        I.open_index(spark, str(tmp_path / "i"))


def test_many_queries_are_searched_in_blocks(spark, sf, monkeypatch):
    base, q = catalog._base(spark, sf), catalog._queries(spark, sf)
    want = {m: S.exact_search(q, base, 7, m).collect() for m in ("l2", "ip")}
    monkeypatch.setattr(S, "QUERY_BLOCK", 6)
    monkeypatch.setattr(S, "BASE_BLOCK", 90)
    for m in want:
        got = {(r["qid"], r["rank"]): r for r in S.exact_search(q, base, 7, m).collect()}
        assert len(got) == len(want[m])
        assert all(got[r["qid"], r["rank"]]["row_id"] == r["row_id"] and abs(got[r["qid"], r["rank"]]["dist"] - r["dist"]) < 1e-9 for r in want[m])
    assert S.exact_search(q.limit(0), base, 7).isEmpty() and S.exact_search(q, base.limit(0), 7).isEmpty()


def test_routing_counts():
    assert [S.super_count(8, 1000), S.super_count(8, 1000, 5), S.super_count(8, 10, 0, 2.0), S.super_count(1, 1)] == [8, 5, 10, 1]
    assert [S.child_budget(8, 100, 2), S.child_budget(8, 10, 2), S.child_budget(8, 100, 0)] == [16, 10, 8]


def test_vector_sinks(spark, tmp_path):
    x = np.arange(40, dtype="<f4").reshape(10, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<float>").coalesce(1)
    for kind in ("fvecs", "npy"):
        assert R.write_vectors(df, str(tmp_path / kind), kind=kind, file_rows=4) == 3
        got = R.read_vectors(spark, f"{tmp_path / kind}/*.{kind}").orderBy("file", "row_id").collect()
        assert [list(r["embedding"]) for r in got] == x.tolist()
    with pytest.raises(ValueError):
        R.write_vectors(df, str(tmp_path / "x"), kind="txt")
    R.export_clustering(df.select(F.col("row_id").alias("cluster_id"), F.col("embedding").alias("centroid")), df.select("row_id", (F.col("row_id") % 3).alias("cluster_id")), str(tmp_path / "c"))
    back = R.read_vectors(spark, f"{tmp_path / 'c/assignments'}/*.ivecs").orderBy("file", "row_id").collect()
    assert [r["embedding"][0] for r in back] == [i % 3 for i in range(10)]


def test_addresses_round_trip():
    sizes = np.array([1, 2, 5, 1, 300, 1, 7]) * 16
    offsets = 64 + np.cumsum(sizes) - sizes
    a, b = C.decode_addresses(C.encode_addresses(offsets, sizes, 16, 3), 16)
    assert (a == offsets).all() and (b == sizes).all() and not len(C.decode_addresses([], 16)[0])
    with pytest.raises(ValueError):
        C.encode_addresses(offsets + 1, sizes, 16)


def test_block_ratios():
    assert C.block_ratios(bytes(8192))["zlib"] < 0.05 and C.block_ratios(b"")["lzma"] == 1.0
    assert C.block_ratios(np.random.default_rng(0).bytes(8192))["bz2"] == 1.0
