"""Vector arithmetic as Spark column expressions.

Vectors are ``array<float>``. Sums are in double precision, component by component, so results don't depend on the
machine. A value that every component needs (a norm) is bound once: written into the lambda it would be evaluated for
each component, and the optimiser puts it back there even if it was a column of its own.

A null vector gives null. Lengths that differ give null, as the shorter vector has nulls where the longer goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALES = {"int8": 127, "int16": 32767}
_ALIASES = {"fp32": "fp32", "float32": "fp32", "f32": "fp32", "int8": "int8", "q8": "int8", "int16": "int16", "q16": "int16"}


def parse_quantization(name: str) -> str:
    """``fp32``, ``int8`` or ``int16`` of any of their names."""
    try:
        return _ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown quantization {name!r}") from None


def bits(mode: str) -> int:
    return {"fp32": 32, "int8": 8, "int16": 16}[parse_quantization(mode)]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y))


def sum_of_squares(v: Column | str) -> Column:
    """Sum in double precision of squares in single precision."""
    return _sum(F.transform(_col(v), lambda x: (x.cast("float") * x.cast("float")).cast("double")))


def magnitude(v: Column | str) -> Column:
    return F.sqrt(sum_of_squares(v)).cast("float")


def normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    v = _col(v)
    factor = bound(sum_of_squares(v), lambda total: F.when(total > 0, (1 / F.sqrt(total)).cast("float")).otherwise(F.lit(1.0).cast("float")))
    return F.when(v.isNotNull(), bound(factor, lambda s: F.transform(v, lambda x: x.cast("float") * s)))


def truncate(v: Column | str, dim: int, renormalize: bool = True) -> Column:
    """The first ``dim`` components, as a unit vector unless ``renormalize`` is off."""
    if dim < 1:
        raise ValueError("dim must be positive")
    head = F.slice(_col(v), 1, dim)
    return normalize(head) if renormalize else head


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of vectors of any length; NaN if one of them is zero."""
    product = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(product == 0, F.lit(float("nan"))).otherwise(dot(a, b) / product)


def cosine_or_zero(a: Column | str, b: Column | str) -> Column:
    """As ``cosine``, but 0 for a zero vector and for lengths that differ."""
    return F.when(F.size(_col(a)) != F.size(_col(b)), F.lit(0.0)).otherwise(F.nanvl(cosine(a, b), F.lit(0.0)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """``1 - dot`` of unit vectors, the dot product clamped to [-1, 1]."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    def square(x: Column, y: Column) -> Column:
        return (x.cast("double") - y) * (x.cast("double") - y)

    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), square)))


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "euclidean":
        return euclidean_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def side(normal: Column | str, v: Column | str, threshold: Column | str) -> Column:
    """(margin, left): signed distance to a hyperplane, and whether that is the left side."""
    margin = dot(normal, v) - _col(threshold)
    return F.struct(margin.alias("margin"), (margin <= 0).alias("left"))


def quantize(v: Column | str, mode: str) -> Column:
    """Codes of components clamped to [-1, 1]; halves are rounded away from zero."""
    mode = parse_quantization(mode)
    if mode == "fp32":
        return _col(v).cast("array<float>")
    kind = "tinyint" if mode == "int8" else "smallint"
    return F.transform(_col(v), lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double"))) * SCALES[mode]).cast(kind))


def dequantize(codes: Column | str, mode: str) -> Column:
    mode = parse_quantization(mode)
    if mode == "fp32":
        return _col(codes).cast("array<float>")
    return F.transform(_col(codes), lambda c: (c.cast("double") / SCALES[mode]).cast("float"))


def dot_codes(query: Column | str, codes: Column | str, mode: str) -> Column:
    """Inner product of a vector with a quantised one."""
    mode = parse_quantization(mode)
    return dot(query, codes) if mode == "fp32" else dot(query, codes) / SCALES[mode]
