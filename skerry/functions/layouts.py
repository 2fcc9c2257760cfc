"""Physical forms of codes, query tables and addresses in numpy, each with its inverse.

Parquet already packs small integers, so the index does without these; they are for exchange with files that hold codes in such forms, for studies of their sizes, and as the plain
statement of what a packed estimate computes. Rows are vectors, columns dimensions; every function takes whole batches.
"""

from __future__ import annotations

import numpy as np


# Magnitudes of a few bits -------------------------------------------------------------------------------------------


def magnitude_bytes(dim: int, bits: int) -> int:
    """Bytes of a vector's magnitudes as consecutive fields."""
    return -(-dim * bits // 8)


def pack_fields(values: np.ndarray, bits: int) -> np.ndarray:
    """Consecutive fields of ``bits``, lowest bit first: pairs in a byte for 4 bits, four for 2, across bytes for 3."""
    v = np.asarray(values, np.uint8)
    if v.size and int(v.max()) >> bits:
        raise ValueError(f"a value does not fit {bits} bits")
    planes = (v[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(v), -1), axis=1, bitorder="little")


def unpack_fields(raw: np.ndarray, bits: int, dim: int) -> np.ndarray:
    flat = np.unpackbits(raw, axis=1, bitorder="little", count=dim * bits).reshape(len(raw), dim, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(2).astype(np.uint8)


def pack_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """One plane of a bit a dimension after another: (rows, bits, dim / 8)."""
    v = np.asarray(values, np.uint8)
    return np.packbits((v[:, None, :] >> np.arange(bits, dtype=np.uint8)[None, :, None]) & 1, axis=2, bitorder="little")


def unpack_planes(raw: np.ndarray, dim: int) -> np.ndarray:
    flat = np.unpackbits(raw, axis=2, bitorder="little", count=dim)
    return (flat << np.arange(raw.shape[1], dtype=np.uint8)[None, :, None]).sum(1).astype(np.uint8)


def tile_width(dim: int, most: int = 512) -> int:
    """Dimensions of a tile: the largest power of two up to ``most`` that divides ``dim``, at least 8."""
    width = most
    while width > 8 and dim % width:
        width //= 2
    return width


def tile_bytes(dim: int, bits: int, most: int = 512) -> int:
    """Bytes of a vector whose planes are kept tile by tile."""
    width = tile_width(dim, most)
    return -(-dim // width) * bits * width // 8


def pack_tiles(values: np.ndarray, bits: int, most: int = 512) -> np.ndarray:
    """The planes of one tile of dimensions after those of another; the last tile is filled up with zeros."""
    v = np.asarray(values, np.uint8)
    width = tile_width(v.shape[1], most)
    padded = np.pad(v, ((0, 0), (0, -v.shape[1] % width)))
    return np.concatenate([pack_planes(t, bits).reshape(len(v), -1) for t in np.split(padded, padded.shape[1] // width, axis=1)], axis=1)


def unpack_tiles(raw: np.ndarray, bits: int, dim: int, most: int = 512) -> np.ndarray:
    width = tile_width(dim, most)
    tiles = [unpack_planes(t.reshape(len(raw), bits, width // 8), width) for t in np.split(raw, raw.shape[1] // (bits * width // 8), axis=1)]
    return np.concatenate(tiles, axis=1)[:, :dim]


def plane_statistics(planes: np.ndarray, word: int = 8) -> dict[str, np.ndarray]:
    """Of each plane: share of words of ``word`` bytes that are zero, entropy of its bits, bytes."""
    out = []
    for k in range(planes.shape[1]):
        raw = np.ascontiguousarray(planes[:, k])
        words = np.pad(raw, ((0, 0), (0, -raw.shape[1] % word))).reshape(-1, word)
        ones = np.unpackbits(raw).mean() if raw.size else 0.0
        p = np.array([ones, 1 - ones])
        out.append(((words == 0).all(1).mean() if len(words) else 0.0, float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0, raw.nbytes))
    return {name: np.array(x) for name, x in zip(("zero_words", "entropy", "bytes"), zip(*out, strict=True), strict=True)}


# Estimates from packed forms ----------------------------------------------------------------------------------------


def ex_bias(bits: int) -> float:
    """What the sum form of a code subtracts for each query component."""
    return -(2.0**bits - 0.5)


def combined_ip(sign_ip: np.ndarray, magnitude_ip: np.ndarray, query_sum: np.ndarray, bits: int) -> np.ndarray:
    """Inner product of a code in sum form: sign bit times 2**bits plus the lower bits, less the bias. ``sign_ip``: over dimensions with the sign bit."""
    return 2.0**bits * sign_ip + magnitude_ip + ex_bias(bits) * query_sum


def sum_form(sign: np.ndarray, magnitude: np.ndarray, bits: int) -> np.ndarray:
    """Lower bits of the sum form: magnitudes as they are above zero, and counted down below it, so that sign * (magnitude + 0.5) = 2**bits * bit + lower - (2**bits - 0.5)."""
    return np.where(sign, magnitude, (1 << bits) - 1 - magnitude).astype(np.uint8)


def distance(ip: np.ndarray, vector_norm: np.ndarray, query_norm: np.ndarray) -> np.ndarray:
    """Squared distance from a normalised inner product, at least 0."""
    return np.maximum(0, vector_norm**2 + query_norm**2 - 2 * vector_norm * query_norm * ip)


def plane_estimate(planes: np.ndarray, sign: np.ndarray, factor: np.ndarray, unit: np.ndarray, vector_norm: np.ndarray, query_norm: float) -> np.ndarray:
    """Stage-2 distances plane by plane, without decoding magnitudes; a factor is required of every row."""
    if not (factor > 0).all():
        raise ValueError("a row without a factor")
    signed = np.where(sign, 1.0, -1.0) * unit
    ip = 0.5 * signed.sum(1)
    for k in range(planes.shape[1]):
        bits = np.unpackbits(planes[:, k], axis=1, bitorder="little", count=len(unit)).astype(bool)
        ip = ip + 2.0**k * np.where(bits, signed, 0).sum(1)
    return distance(ip * factor, vector_norm, query_norm)


def quantise(q: np.ndarray, most: float | None = None, bits: int = 14) -> tuple[np.ndarray, float]:
    """Whole numbers of ``bits`` and their width; ``most``: the largest magnitude, if the caller has it."""
    most = float(np.abs(q).max(initial=0.0)) if most is None else most
    width = most / (2 ** (bits - 1) - 1)
    return (np.rint(q / width) if width > 0 else np.zeros(len(q))).astype(np.int16), width


def lookup_table(q: np.ndarray) -> np.ndarray:
    """For each four dimensions the sums over the 16 sets of them: (dim / 4, 16)."""
    sets = (np.arange(16)[:, None] >> np.arange(4)) & 1
    return np.pad(np.asarray(q, np.int64), (0, -len(q) % 4)).reshape(-1, 4) @ sets.T


def quantised_table(q: np.ndarray, most: float | None = None) -> tuple[np.ndarray, int, float]:
    """The lookup table of the 14-bit query, the query's sum and its width."""
    whole, width = quantise(q, most)
    return lookup_table(whole), int(whole.astype(np.int64).sum()), width


def sign_blocks(sign: np.ndarray, block: int = 32) -> np.ndarray:
    """Sign bits four dimensions at a time, ``block`` vectors side by side: (blocks, dim / 4, block), the last block filled up with zeros."""
    padded = np.pad(sign.astype(np.uint8), ((0, -len(sign) % block), (0, -sign.shape[1] % 4)))
    nibbles = (padded.reshape(len(padded), -1, 4) << np.arange(4, dtype=np.uint8)).sum(2).astype(np.uint8)
    return nibbles.reshape(-1, block, nibbles.shape[1]).transpose(0, 2, 1)


def signs_of(blocks: np.ndarray, row: int, dim: int) -> np.ndarray:
    """One vector's sign bits."""
    nibbles = blocks[row // blocks.shape[2], :, row % blocks.shape[2]]
    return ((nibbles[:, None] >> np.arange(4)) & 1).reshape(-1)[:dim].astype(bool)


def accumulate(table: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The table's sums over each vector's sign bits."""
    return table[np.arange(len(table))[None, :, None], blocks].sum(1).reshape(-1)


def dequantise(raw: np.ndarray, query_sum: int, width: float, dim: int, vector_norm: np.ndarray, query_norm: float) -> np.ndarray:
    """Stage-1 distances from accumulated sums: twice the sum over set bits less the whole sum is the signed sum."""
    return distance((2.0 * raw - query_sum) * width / np.sqrt(dim), vector_norm, query_norm)


def block_is_out(table: np.ndarray, query_sum: int, width: float, dim: int, vector_norms: np.ndarray, query_norm: float, frontier: float, margin: np.ndarray) -> bool:
    """Whether no vector of a block can be within the frontier: the largest sum that any sign pattern gives bounds the inner product, and the block's norms the rest."""
    best = min(1.0, (2.0 * table.max(1).sum() - query_sum) * width / np.sqrt(dim))
    nearest = np.clip(query_norm * best, vector_norms.min(), vector_norms.max())  # the norm at which the bound is least
    least = nearest**2 + query_norm**2 - 2 * nearest * query_norm * best
    return bool(least > frontier + margin.max())


# Addresses and streams ----------------------------------------------------------------------------------------------


def raw_addresses(offsets: np.ndarray, sizes: np.ndarray, page: int) -> np.ndarray:
    """(offset, size) in pages as two uint32 a record; records need not follow one another."""
    both = np.stack([np.asarray(offsets, np.int64), np.asarray(sizes, np.int64)], axis=1)
    if (both % page).any():
        raise ValueError("offset or size is not a multiple of the page")
    pages = both // page
    if (pages < 0).any() or (pages >> 32).any():
        raise ValueError("an address does not fit 32 bits of pages")
    return pages.astype("<u4")


def decode_raw(table: np.ndarray, page: int, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all records, or of those at the given places."""
    rows = table[at].astype(np.int64) * page
    return rows[..., 0], rows[..., 1]


def prefix_sums(streams: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums of each stream (row)."""
    return np.cumsum(streams, axis=1) - streams


def interleave(streams: np.ndarray) -> np.ndarray:
    """Streams (rows) as one sequence that takes a value of each in turn."""
    return np.ascontiguousarray(np.asarray(streams).T).reshape(-1)


def separate(sequence: np.ndarray, streams: int) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(sequence).reshape(-1, streams).T)


# Settings -----------------------------------------------------------------------------------------------------------

#: Names under which estimators and layouts may be given.
ESTIMATORS = {"legacy": "legacy", "multi_bit": "legacy", "official": "official", "official_1_plus_n": "official", "1+n": "official"}
LAYOUTS = {"fields": "fields", "packed": "fields", "direct3": "fields", "nibble4": "fields", "two_bit": "fields", "2bit": "fields", "planes": "planes", "bitplanes": "planes", "direct_bitplanes": "planes", "vector_bitplanes": "planes", "tiles": "tiles", "bit_major_tiles": "tiles", "vector_bit_major_tiles": "tiles"}


def named(kind: dict[str, str], name: str) -> str:
    key = name.strip().lower().replace("-", "_")
    if key not in kind:
        raise ValueError(f"no such name: {name}")
    return kind[key]


def format_key(dim: int, bits: int, estimator: str, layout: str) -> str:
    """One string for all settings that decide whether two indexes hold the same codes."""
    return f"dim={dim};bits={bits};estimator={named(ESTIMATORS, estimator)};layout={named(LAYOUTS, layout)}"


def pack(values: np.ndarray, bits: int, layout: str) -> np.ndarray:
    kind = named(LAYOUTS, layout)
    return pack_fields(values, bits) if kind == "fields" else pack_planes(values, bits).reshape(len(values), -1) if kind == "planes" else pack_tiles(values, bits)


def unpack(raw: np.ndarray, bits: int, dim: int, layout: str) -> np.ndarray:
    kind = named(LAYOUTS, layout)
    return unpack_fields(raw, bits, dim) if kind == "fields" else unpack_planes(raw.reshape(len(raw), bits, -1), dim) if kind == "planes" else unpack_tiles(raw, bits, dim)
