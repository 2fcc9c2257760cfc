"""Vector arithmetic, bounds and classes as native Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def neg_ip(a: Column, b: Column) -> Column:
    """Smaller is nearer, as for distances."""
    return -dot(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def residual(v: Column, centre: Column) -> Column:
    return F.zip_with(as_double(v), as_double(centre), lambda x, y: x - y)


def pad_to(v: Column, multiple: int = 64) -> Column:
    """Zeros up to the next multiple, unless the length is a power of two."""
    n = F.size(v)
    power = F.bit_count(n) == 1
    return F.when(power, as_double(v)).otherwise(F.concat(as_double(v), F.array_repeat(F.lit(0.0), F.pmod(-n, F.lit(multiple)).cast("int"))))


def sign_code(v: Column) -> Column:
    """Sign bits (1 where >= 0), 32 dimensions a long."""
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1)
    bits = lambda w: F.transform(F.slice(v, w * 32 + 1, F.lit(32)), lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i)).otherwise(0.0))
    return F.transform(words, lambda w: F.aggregate(bits(w), F.lit(0.0), lambda s, x: s + x).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def popcount_total(code: Column) -> Column:
    return F.aggregate(code, F.lit(0), lambda s, x: s + F.bit_count(x))


def popcount_distance(differing: Column, dim: int, vector_norm: Column, query_norm: Column) -> Column:
    """Stage-1 distance from the Hamming distance of sign codes, at least 0."""
    ip = 1 - 2 * differing / F.lit(float(dim))
    return F.greatest(F.lit(0.0), vector_norm * vector_norm + query_norm * query_norm - 2 * vector_norm * query_norm * ip)


def epsilon(c: float, bits: int, dim: int) -> float:
    return c * 2 ** (-bits / 2) / dim**0.5


def classify(d: Column, tau_in: Column, tau_out: Column) -> Column:
    return F.when(d < tau_in, "SafeIn").when(d > tau_out, "SafeOut").otherwise("Uncertain")


def classify_fixed(d: Column, d_k: Column, eps: Column) -> Column:
    return classify(d, d_k - 2 * eps, d_k + 2 * eps)


def classify_margin(d: Column, d_k: Column, safein_d_k: Column, margin: Column) -> Column:
    """SafeOut is tested first."""
    return F.when(d > d_k + 2 * margin, "SafeOut").when(d < safein_d_k - 2 * margin, "SafeIn").otherwise("Uncertain")


def classify_adaptive(d: Column, frontier: Column, safein_d_k: Column, margin_out: Column, margin_in: Column | None = None) -> Column:
    margin_in = margin_out if margin_in is None else margin_in
    return F.when(d > frontier + margin_out, "SafeOut").when(d < safein_d_k - margin_in, "SafeIn").otherwise("Uncertain")


def safe_rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def recall_at(found: Column, truth: Column, k: int) -> Column:
    """Shared ids of the first k over the smaller of k and the truth's size; 0 for no truth."""
    return F.when(F.size(truth) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), F.slice(truth, 1, k))) / F.least(F.lit(k), F.size(truth)))


def levels(unit: Column, scale: float, ex_bits: int) -> Column:
    """Signed code levels of a unit residual: magnitude capped at 2^ex_bits - 1, plus a half, with the component's sign."""
    top = float(2**ex_bits - 1)
    return F.transform(unit, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0) * (F.least(F.lit(top), F.floor(F.abs(x) * F.lit(float(scale)) + F.lit(1e-5)).cast("double")) + 0.5))


def level_distance(code: Column, factor: Column, query_unit: Column, vector_norm: Column, query_norm: Column) -> Column:
    """Stage-2 distance from code levels, at least 0. ``factor`` is 1 / (levels . unit), 0 for a zero residual."""
    ip = dot(code, query_unit) * factor
    return F.greatest(F.lit(0.0), vector_norm * vector_norm + query_norm * query_norm - 2 * vector_norm * query_norm * ip)
