"""Rotations and multi-bit residual codes in numpy, applied batch by batch through Arrow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised transform of each row; the width is a power of two."""
    x, width = np.array(x, float), 1
    while width < x.shape[1]:
        y = x.reshape(len(x), -1, 2, width)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
        width *= 2
    return x


@dataclass
class Rotation:
    """An orthogonal map: signs and a Hadamard transform for powers of two, rounds of them on halves for multiples of 64, else a random basis; or, if asked for, shuffled components in blocks of powers of two."""

    dim: int
    seed: int = 42
    rounds: int = 4
    blocks: bool = False

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.kind = "hadamard" if self.dim & (self.dim - 1) == 0 else "kac" if self.dim % 64 == 0 else "random"
        self.signs = rng.choice([-1.0, 1.0], (self.rounds, self.dim))
        if self.blocks:
            self.kind, self.order, self.cuts, left = "blocks", rng.permutation(self.dim), [0], self.dim
            while left:
                self.cuts.append(self.cuts[-1] + (1 << (left.bit_length() - 1)))
                left = self.dim - self.cuts[-1]
        if self.kind == "random":
            self.basis = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]

    def _window(self, k: int) -> slice:
        width = 1 << (self.dim.bit_length() - 1)
        return slice(0, width) if k % 2 == 0 else slice(self.dim - width, self.dim)

    def _blocks(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([walsh_hadamard(x[:, a:b]) / np.sqrt(b - a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, float)
        if self.kind == "blocks":
            return self._blocks((x * self.signs[0])[:, self.order])
        if self.kind == "random":
            return x @ self.basis
        if self.kind == "hadamard":
            return walsh_hadamard(x * self.signs[0]) / np.sqrt(self.dim)
        for k in range(self.rounds):
            x = x * self.signs[k]
            w = self._window(k)
            x[:, w] = walsh_hadamard(x[:, w]) / np.sqrt(w.stop - w.start)
            x = self._mix(x)
        return x

    def invert(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, float)
        if self.kind == "blocks":
            out = np.empty_like(x)
            out[:, self.order] = self._blocks(x)
            return out * self.signs[0]
        if self.kind == "random":
            return x @ self.basis.T
        if self.kind == "hadamard":
            return walsh_hadamard(x) / np.sqrt(self.dim) * self.signs[0]
        for k in reversed(range(self.rounds)):
            x = self._mix(x)
            w = self._window(k)
            x[:, w] = walsh_hadamard(x[:, w]) / np.sqrt(w.stop - w.start)
            x = x * self.signs[k]
        return x

    def _mix(self, x: np.ndarray) -> np.ndarray:
        """Sum and difference of the halves, which is its own inverse."""
        a, b = np.split(x, 2, axis=1)
        return np.concatenate((a + b, a - b), axis=1) / np.sqrt(2)


def scale_for(dim: int, ex_bits: int, samples: int = 100, seed: int = 42) -> float:
    """The mean best scale of unit Gaussian directions for codes of ex_bits magnitude bits."""
    if not ex_bits:
        return 0.0
    x = np.abs(np.random.default_rng(seed).normal(size=(samples, dim)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top = 2**ex_bits - 1
    tries = np.linspace(0.3, 1.2, 64)[:, None] * (top + 0.5) / x.max(1)[None, :]
    c = np.minimum(top, np.floor(tries[:, :, None] * x[None])) + 0.5
    fit = (c * x).sum(2) / np.sqrt((c * c).sum(2))
    return float(tries[fit.argmax(0), np.arange(samples)].mean())


def best_scales(unit: np.ndarray, ex_bits: int) -> np.ndarray:
    """Each direction's best scale, exactly: a code changes only where a component passes a whole number, so the fit is taken after each such step in ascending scale."""
    x, top = np.abs(unit), 2**ex_bits - 1
    out = np.zeros(len(x))
    for i, row in enumerate(x):
        use = np.flatnonzero(row > 0)
        if not len(use) or not ex_bits:
            continue
        steps = (np.arange(1, top + 1)[:, None] / row[use]).ravel()
        order = np.argsort(steps, kind="stable")
        owner = np.tile(use, top)[order]
        level = np.tile(np.arange(1, top + 1)[:, None], len(use)).ravel()[order]
        inner = 0.5 * row.sum() + np.cumsum(row[owner])
        square = 0.25 * len(row) + np.cumsum(2.0 * level)  # (c + 1/2)^2 - (c - 1/2)^2 = 2 c
        best = int(np.argmax(inner / np.sqrt(square)))
        last = steps[order][best]
        out[i] = last * (1 + 1e-9)
    return out


def encode_best(residuals: np.ndarray, rotation: Rotation, ex_bits: int) -> dict[str, np.ndarray]:
    """As :func:`encode`, each vector under its own best scale."""
    size = np.linalg.norm(residuals, axis=1)
    unit = rotation.apply(residuals / np.where(size > 0, size, 1)[:, None])
    c = np.minimum(2**ex_bits - 1, (best_scales(unit, ex_bits)[:, None] * np.abs(unit)).astype(np.int64))
    inner = ((c + 0.5) * np.abs(unit)).sum(1)
    return {"norm": size, "sign": unit >= 0, "magnitude": c.astype(np.uint8), "factor": np.divide(1, inner, out=np.zeros(len(inner)), where=inner > 0)}


def turned_residuals(queries: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Rotated residuals of every query to every centroid, (queries, centroids, dim), from one rotation of each: the map is linear."""
    return rotation.apply(queries)[:, None] - rotation.apply(centroids)[None]


def calibration_distance(code: dict[str, np.ndarray], unit: np.ndarray, query_norm: float, ex_bits: int, estimator: str | None = "legacy") -> np.ndarray:
    """The distance that calibration takes: the sum form if the estimator is official, the multi-bit form if there are magnitudes, else signs alone, not held at 0."""
    from skerry.functions import layouts as L

    sign = np.where(code["sign"], 1.0, -1.0)
    if not ex_bits:
        ip = (sign @ unit) / np.sqrt(len(unit))
        return code["norm"] ** 2 + query_norm**2 - 2 * code["norm"] * query_norm * ip
    if estimator and L.named(L.ESTIMATORS, estimator) == "official":
        lower = L.sum_form(code["sign"], code["magnitude"], ex_bits)
        ip = L.combined_ip(code["sign"] @ unit, lower @ unit, unit.sum(), ex_bits)
    else:
        ip = (sign * (code["magnitude"] + 0.5)) @ unit
    return L.distance(ip * code["factor"], code["norm"], query_norm)


def encode(residuals: np.ndarray, rotation: Rotation, ex_bits: int, scale: float) -> dict[str, np.ndarray]:
    """Norms, sign bits, magnitudes and the factor that makes the code's inner product unbiased."""
    size = np.linalg.norm(residuals, axis=1)
    unit = rotation.apply(residuals / np.where(size > 0, size, 1)[:, None])
    c = np.minimum(2**ex_bits - 1, (scale * np.abs(unit) + 1e-5).astype(np.int64)) if ex_bits else np.zeros(unit.shape, np.int64)
    inner = ((c + 0.5) * np.abs(unit)).sum(1)
    return {"norm": size, "sign": unit >= 0, "magnitude": c.astype(np.uint8), "factor": np.divide(1, inner, out=np.zeros(len(inner)), where=inner > 0)}


def estimate(query_residual: np.ndarray, code: dict[str, np.ndarray], rotation: Rotation, stage: int = 2) -> np.ndarray:
    """Squared distances of one query residual to all coded residuals: stage 1 from signs alone, stage 2 from all bits; at least 0."""
    q = np.linalg.norm(query_residual)
    unit = rotation.apply(query_residual[None] / (q if q > 0 else 1))[0]
    sign = np.where(code["sign"], 1.0, -1.0)
    ip = (sign @ unit) / np.sqrt(len(unit)) if stage == 1 else ((sign * (code["magnitude"] + 0.5)) @ unit) * code["factor"]
    return np.maximum(0, code["norm"] ** 2 + q**2 - 2 * code["norm"] * q * ip)


def pack(code: dict[str, np.ndarray]) -> list[bytes]:
    return [s.tobytes() + m.tobytes() for s, m in zip(np.packbits(code["sign"], axis=1, bitorder="little"), code["magnitude"], strict=True)]


def unpack(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    cut = -(-dim // 8)
    return np.unpackbits(raw[:, :cut], axis=1, bitorder="little", count=dim).astype(bool), raw[:, cut:]


def quantise_query(q: np.ndarray) -> tuple[np.ndarray, float]:
    """14-bit integers and their width."""
    width = float(np.abs(q).max()) / 8191 if len(q) else 0.0
    return np.rint(q / width).astype(np.int16) if width else np.zeros(len(q), np.int16), width


def bit_width(values: np.ndarray, most: int = 256) -> int:
    """Bits for the largest value, at least 1; 0 if any is above ``most``."""
    top = int(values.max()) if len(values) else 0
    return 0 if top > most else max(1, top.bit_length())


def bit_pack(values: np.ndarray, width: int) -> bytes:
    bits = (np.asarray(values, np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def bit_unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1)


def encode_addresses(offsets: np.ndarray, sizes: np.ndarray, page: int, block: int = 64) -> list[tuple[int, int, int, bytes]]:
    """(first page, rows, bits, packed page counts) of each block of records that follow one another; bits is 0 where counts are too large to pack and then stand as uint32."""
    offsets, sizes = np.asarray(offsets, np.int64), np.asarray(sizes, np.int64)
    if (offsets % page).any() or (sizes % page).any():
        raise ValueError("offset or size is not a multiple of the page")
    if (offsets[1:] != offsets[:-1] + sizes[:-1]).any():
        raise ValueError("records do not follow one another")
    out = []
    for a in range(0, len(sizes), block):
        pages = sizes[a : a + block] // page
        bits = bit_width(pages)
        out.append((int(offsets[a] // page), len(pages), bits, bit_pack(pages, bits) if bits else pages.astype("<u4").tobytes()))
    return out


def decode_addresses(blocks: list[tuple[int, int, int, bytes]], page: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all records, by a prefix sum over each block."""
    offsets, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, n, bits, raw in blocks:
        pages = (bit_unpack(raw, bits, n) if bits else np.frombuffer(raw, "<u4")).astype(np.int64)
        offsets.append((first + np.cumsum(pages) - pages) * page)
        sizes.append(pages * page)
    return np.concatenate(offsets), np.concatenate(sizes)


def block_ratios(raw: bytes, block: int = 4096) -> dict[str, float]:
    """Compressed size over size, block by block, for each compressor at hand; 1 for a block that does not shrink."""
    import bz2
    import lzma
    import zlib

    tools = {"zlib": zlib.compress, "bz2": bz2.compress, "lzma": lzma.compress}
    blocks = [raw[a : a + block] for a in range(0, len(raw), block)]
    return {name: sum(min(len(b), len(f(b))) for b in blocks) / len(raw) if raw else 1.0 for name, f in tools.items()}
