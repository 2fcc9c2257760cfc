"""Packed forms: exact round trips, and estimates that equal the plain ones."""

import numpy as np
import pytest

from skerry.functions import codes as C
from skerry.functions import layouts as L

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("layout", sorted(L.LAYOUTS))
@pytest.mark.parametrize("bits", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("dim", [64, 96, 70])
def test_magnitudes_round_trip(layout, bits, dim):
    v = RNG.integers(0, 1 << bits, (9, dim))
    raw = L.pack(v, bits, layout)
    assert (L.unpack(raw, bits, dim, layout) == v).all()
    if L.LAYOUTS[layout] == "fields":
        assert raw.shape[1] == L.magnitude_bytes(dim, bits)
    if L.LAYOUTS[layout] == "tiles":
        assert raw.shape[1] == L.tile_bytes(dim, bits)


def test_fields_refuse_what_does_not_fit():
    with pytest.raises(ValueError):
        L.pack_fields(np.array([[8]]), 3)


def coded(dim=64, bits=3, n=70):
    x, rotation = RNG.normal(size=(n, dim)), C.Rotation(dim)
    return x, rotation, C.encode(x, rotation, bits, C.scale_for(dim, bits))


def test_plane_and_sum_forms_give_the_multi_bit_estimate():
    _, rotation, code = coded()
    q = RNG.normal(size=64)
    want, norm = C.estimate(q, code, rotation, 2), np.linalg.norm(q)
    unit = rotation.apply(q[None] / norm)[0]
    planes = L.pack_planes(code["magnitude"], 3)
    assert np.allclose(L.plane_estimate(planes, code["sign"], code["factor"], unit, code["norm"], norm), want)
    for name in L.ESTIMATORS:
        assert np.allclose(C.calibration_distance(code, unit, norm, 3, name), want)
    assert L.ex_bias(3) == -7.5 and L.combined_ip(1.0, 2.0, 3.0, 1) == 2 + 2 - 4.5
    signs = C.calibration_distance(code, unit, norm, 0)
    assert np.allclose(np.maximum(signs, 0), C.estimate(q, code, rotation, 1))
    with pytest.raises(ValueError):
        L.plane_estimate(planes, code["sign"], code["factor"] * 0, unit, code["norm"], norm)


def test_table_lookup_gives_the_sign_estimate():
    _, rotation, code = coded()
    q = RNG.normal(size=64)
    norm = np.linalg.norm(q)
    unit = rotation.apply(q[None] / norm)[0]
    blocks = L.sign_blocks(code["sign"])
    assert blocks.shape == (3, 16, 32) and all((L.signs_of(blocks, r, 64) == code["sign"][r]).all() for r in range(70))
    table, total, width = L.quantised_table(unit)
    whole, same = L.quantise(unit, float(np.abs(unit).max()))
    assert (L.lookup_table(whole) == table).all() and same == width and total == whole.astype(int).sum()
    raw = L.accumulate(table, blocks)[:70]
    assert (raw == code["sign"] @ whole.astype(int)).all()
    assert np.allclose(L.dequantise(raw, total, width, 64, code["norm"], norm), C.estimate(q, code, rotation, 1), atol=1e-2)
    assert L.quantise(np.zeros(3))[0].tolist() == [0, 0, 0]


def test_a_block_is_left_out_only_if_all_its_vectors_are():
    left = 0
    for seed in range(60):
        rng = np.random.default_rng(seed)
        x, rotation = rng.normal(size=(32, 16)) * rng.uniform(0.1, 3), C.Rotation(16)
        code = C.encode(x, rotation, 0, 0.0)
        q = rng.normal(size=16) * rng.uniform(0.1, 3)
        norm = np.linalg.norm(q)
        table, total, width = L.quantised_table(rotation.apply(q[None] / norm)[0])
        d = L.dequantise(L.accumulate(table, L.sign_blocks(code["sign"])), total, width, 16, code["norm"], norm)
        margin = 0.1 * code["norm"] * norm
        if L.block_is_out(table, total, width, 16, code["norm"], norm, 2.0, margin):
            left += 1
            assert (d > 2.0 + margin).all()
    assert left


def test_best_scales_beat_any_other():
    unit = RNG.normal(size=(20, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def fit(scale):
        c = np.minimum(7, (scale[:, None] * np.abs(unit)).astype(int)) + 0.5
        return (c * np.abs(unit)).sum(1) / np.sqrt((c * c).sum(1))

    best = fit(C.best_scales(unit, 3))
    for s in np.linspace(0.5, 80, 400):
        assert (fit(np.full(20, s)) <= best + 1e-9).all()
    x, rotation = RNG.normal(size=(50, 64)), C.Rotation(64)
    q = RNG.normal(size=64)
    true = ((x - q) ** 2).sum(1)
    errors = [np.abs(C.estimate(q, code, rotation) - true).mean() for code in (C.encode_best(x, rotation, 3), C.encode(x, rotation, 3, C.scale_for(64, 3)))]
    assert errors[0] < errors[1] * 1.3
    assert C.encode_best(np.zeros((1, 64)), rotation, 3)["factor"][0] == 0


def test_rotated_residuals_are_linear():
    q, c, r = RNG.normal(size=(4, 192)), RNG.normal(size=(3, 192)), C.Rotation(192)
    got = C.turned_residuals(q, c, r)
    assert np.allclose(got[2, 1], r.apply((q[2] - c[1])[None])[0])


@pytest.mark.parametrize("dim", [1, 48, 70, 100])
def test_blocked_rotation(dim):
    x, r = RNG.normal(size=(5, dim)), C.Rotation(dim, blocks=True)
    assert np.allclose(r.invert(r.apply(x)), x) and np.allclose(np.linalg.norm(r.apply(x), axis=1), np.linalg.norm(x, axis=1))


def test_raw_addresses_and_streams():
    offsets, sizes = np.array([0, 640, 64, 320]), np.array([64, 64, 128, 0])
    table = L.raw_addresses(offsets, sizes, 64)
    a, b = L.decode_raw(table, 64)
    assert (a == offsets).all() and (b == sizes).all()
    assert L.decode_raw(table, 64, np.array([2, 0]))[0].tolist() == [64, 0] and L.decode_raw(table, 64, 1) == (640, 64)
    for bad in (offsets + 1, offsets - 64, offsets + (1 << 40)):
        with pytest.raises(ValueError):
            L.raw_addresses(bad, sizes, 64)
    s = RNG.integers(0, 9, (8, 20))
    assert (L.separate(L.interleave(s), 8) == s).all() and L.interleave(s)[:8].tolist() == s[:, 0].tolist()
    assert (L.prefix_sums(s)[:, 1:] == np.cumsum(s, axis=1)[:, :-1]).all() and not L.prefix_sums(s)[:, 0].any()


def test_plane_statistics():
    got = L.plane_statistics(L.pack_planes(np.array([[0, 1, 0, 1] * 16, [0, 1, 0, 1] * 16]), 2))
    assert got["zero_words"].tolist() == [0, 1] and got["entropy"].tolist() == [1, 0] and got["bytes"].tolist() == [16, 16]


def test_names():
    assert L.format_key(64, 3, "1+n", "Direct3") == "dim=64;bits=3;estimator=official;layout=fields"
    for kind in (L.ESTIMATORS, L.LAYOUTS):
        with pytest.raises(ValueError):
            L.named(kind, "nothing")
