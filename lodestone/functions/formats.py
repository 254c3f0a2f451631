"""Names, widths and durations as reports print them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vector import bits, parse_quantization


def quantization_label(mode: str) -> str:
    """Short name of a mode, ``unknown`` for what is none."""
    try:
        return parse_quantization(mode)
    except ValueError:
        return "unknown"


def quantization_bits(mode: str) -> int:
    """Bits of a component, 0 for what is no mode."""
    try:
        return bits(mode)
    except ValueError:
        return 0


def duration_text(ns: int | None) -> str | None:
    """Nanoseconds as ``1.50s``, ``2.3ms``, ``4.0µs`` or ``12ns``, whichever unit is the largest with at least one."""
    if ns is None:
        return None
    for unit, size, digits in (("s", 10**9, 2), ("ms", 10**6, 1), ("µs", 10**3, 1)):
        if ns >= size:
            return f"{ns / size:.{digits}f}{unit}"
    return f"{ns}ns"


def duration(ns: Column) -> Column:
    """``duration_text`` of a column. In Python, as the JVM's formatter rounds decimal halves up where reports round the binary value."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([duration_text(n) for n in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ns.cast("bigint"))


def progress_line(stage: str, current: int, total: int) -> str:
    """``[stage] 3/20 (15.0%)``; nothing if there is nothing to do."""
    return f"[{stage}] {current}/{total} ({100 * current / total:.1f}%)" if total else ""
