"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.shared import bounded_batches, drop_folder, exists, materialize, place, qualified, read_bytes, shared_folder, write_bytes

__all__ = ["bounded_batches", "drop_folder", "exists", "materialize", "place", "qualified", "read_bytes", "shared_folder", "write_bytes"]

#: Bytes of text that the vectorised kernels work on at once; bounds their memory, never what is processed.
SLICE_BYTES = 1 << 20


class Scratch:
    """Intermediate tables of one call, which ``finish`` deletes once its result is written."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """``df`` written and read again, as by ``materialize``."""
        path = shared_folder(df.sparkSession, what)
        df.write.parquet(path)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame, what: str) -> DataFrame:
        out = materialize(df, what)
        self.drop()
        return out

    def drop(self) -> None:
        for spark, path in self.paths:
            drop_folder(spark, path)
        self.paths.clear()


def quoted(name: str) -> str:
    """A column's name as SQL takes it, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def fresh(columns: Sequence[str], stem: str) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; a null is an empty text."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row has a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
