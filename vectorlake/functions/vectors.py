"""Vector math as Column expressions (double precision), and score and quantisation codecs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import EPSILON, metric

TIERS = ("u8", "u16", "f32")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def l2_squared(a: Column, b: Column) -> Column:
    """M1: the engine's "l2" distance."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    """M2."""
    return F.sqrt(l2_squared(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """M3: 1 where a vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale <= EPSILON, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def negative_dot(a: Column, b: Column) -> Column:
    """M4."""
    return -dot(a, b)


def distance(name: str, a: Column, b: Column) -> Column:
    """M5: distance by metric name; smaller is nearer."""
    return {"l2": l2_squared, "cosine": cosine_distance, "dot": negative_dot}[metric(name)](a, b)


def score(d: Column) -> Column:
    """M7: 1 / (1 + distance), infinite at -1."""
    return F.when(d == -1, F.lit(float("inf"))).otherwise(1 / (1 + d))


def normalize(v: Column) -> Column:
    """M8: scaled to length 1; unchanged where there is no length."""
    n = norm(v)
    return F.when(n > EPSILON, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def _scale(tier: str) -> float:
    return {"u8": 127.5, "u16": 32767.5}[tier]


def encode(v: Column, tier: str) -> Column:
    """Integer codes of components clamped to [-1, 1]; ``f32`` leaves the vector."""
    if tier == "f32":
        return v.cast("array<float>")
    s = _scale(tier)
    return F.transform(doubles(v), lambda x: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) * s + 0.5).cast("int"))


def decode(codes: Column, tier: str) -> Column:
    """M12."""
    if tier == "f32":
        return doubles(codes)
    s = _scale(tier)
    return F.transform(codes, lambda q: q.cast("double") / s - 1)


def coded_distance(name: str, query: Column, codes: Column, tier: str) -> Column:
    """Distance from a query to a coded vector."""
    return distance(name, query, decode(codes, tier))


def quantized_distance(name: str, query: Column, codes: Column, tier: str) -> Column:
    """As ``coded_distance``, but true (rooted) L2, and the largest double where lengths differ."""
    d = coded_distance(name, query, codes, tier)
    d = F.sqrt(d) if metric(name) == "l2" else d
    return F.when(F.size(query) != F.size(codes), F.lit(1.7976931348623157e308)).otherwise(d)


def tier_of_layer(layer: Column, layers: int) -> Column:
    """u8 outside, f32 in the last layer, u16 between."""
    return F.when(layer == 0, "u8").when(layer >= layers - 1, "f32").otherwise("u16")


def bytes_per_dimension(tier: Column) -> Column:
    """M19."""
    return F.when(tier == "u8", 1).when(tier == "u16", 2).otherwise(4)


def percentile(values: Column, p: float) -> Column:
    """Nearest rank, ``round(p * (n - 1))`` of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.lit(p) * (F.size(values) - 1) + 0.5).cast("int"))
