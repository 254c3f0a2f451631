"""Vectors packed into blocks, so that pairs of blocks can be solved by matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.shared import bounded_batches, expected_bytes, materialize, small

PACKED = "block string, n int, ids binary, matrix binary"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


UNIT_ROWS = 8192


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Unit vectors with the bits of the column expression: squares in single precision, summed one after another in double. Zero rows stay."""
    v = v.astype(np.float32)
    if v.ndim == 2 and len(v) > UNIT_ROWS:  # sums of so many rows at once
        out = np.empty_like(v)
        for low in range(0, len(v), UNIT_ROWS):
            out[low : low + UNIT_ROWS] = unit_rows(v[low : low + UNIT_ROWS])
        return out
    total = np.add.accumulate((v * v).astype(np.float64), axis=-1)[..., -1:]
    return v * np.where(total > 0, 1 / np.sqrt(np.where(total > 0, total, 1)), 1).astype(np.float32)


def quantize_rows(v: np.ndarray, mode: str) -> np.ndarray:
    """Codes with the bits of the column expression: clamped to [-1, 1], halves away from zero."""
    if mode == "fp32":
        return v.astype(np.float32)
    scaled = np.clip(v.astype(np.float64), -1, 1) * {"int8": 127, "int16": 32767}[mode]
    whole = np.trunc(scaled)
    return (whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)).astype(mode)


def pack(vectors: DataFrame, rows: int, kind: str, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of (id, vec) as blocks of at most ``rows`` vectors, ``prepare`` applied, with components of numpy type ``kind``."""

    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []
        have = 0

        def close() -> pa.RecordBatch:
            nonlocal have, nth
            nth += 1
            out = [pa.array([f"{part}-{nth}"]), pa.array([have], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vecs).tobytes()], pa.binary())]
            ids.clear()
            vecs.clear()
            have = 0
            return pa.RecordBatch.from_arrays(out, names=["block", "n", "ids", "matrix"])

        for b in batches:
            own, m = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column(1))
            m = (prepare(m) if prepare is not None else m).astype(kind, copy=False)
            at = 0
            while at < len(own):
                take = min(len(own) - at, rows - have)
                ids.append(own[at : at + take])
                vecs.append(m[at : at + take])
                have, at = have + take, at + take
                if have == rows:
                    yield close()
        if have:
            yield close()

    return vectors.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(run, PACKED)


#: Rows of a block of a side that Spark finds small.
SMALL_ROWS = 256


def packed(vectors: DataFrame, rows: int, kind: str, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``pack`` for the side whose blocks are the units of work: of a small table, which may lie in one file, smaller ones, brought to as many tasks as there are cores."""
    if not small(vectors):
        return pack(vectors, rows, kind, prepare)
    blocks, parts = pack(vectors, min(rows, SMALL_ROWS), kind, prepare), vectors.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(parts, "block") if vectors.rdd.getNumPartitions() < parts else blocks


#: Bytes of the blocks that a task of a cartesian product pairs its own with: a task that meets more of them has to measure fewer pairs, as its best are known sooner.
GATHERED_BYTES = 48 << 20


def spread(blocks: DataFrame, what: str) -> DataFrame:
    """``blocks`` written once, in as many files as give all cores their share, whatever files the vectors came in."""
    return materialize(blocks.repartition(2 * blocks.sparkSession.sparkContext.defaultParallelism), what)


def gathered(blocks: DataFrame) -> DataFrame:
    """Written ``blocks`` in partitions of about ``GATHERED_BYTES``, for the side that every task goes through."""
    return blocks.coalesce(max(1, -(-expected_bytes(blocks) // GATHERED_BYTES)))


def unpack(ids: bytes | pa.Buffer, raw: bytes | pa.Buffer, kind: str) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(raw, kind).reshape(len(own), -1)


class Top:
    """The best ``k`` of what was added for each query, by value, then id; a larger value is better."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.row, self.id, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        row, near, val = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.value, value])
        order = np.lexsort((near, -val, row))
        row, near, val = row[order], near[order], val[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.id, self.value = row[keep], near[keep], val[keep]
        last = place == self.k - 1
        self.least[row[last]] = val[last]


#: Vectors of a block whose products with the queries are held at once.
TILE = 1024


def margin_of(dim: int) -> float:
    """Bound of the error of a sum of ``dim`` products in single precision, as a share of the product of the lengths."""
    return max(1e-5, 1.2e-7 * (dim + 8))


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a contiguous matrix that is nearly all false: eight places are looked at as one number."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.nonzero(mask)
    at = np.flatnonzero(flat.view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.divmod(at[flat[at]], mask.shape[1])


@dataclass
class Kind:
    """Queries, vectors and best of one way to measure, of several that one product in single precision sifts; no value is farther than ``away`` from that product over the lengths."""

    top: Top
    q: np.ndarray
    m: np.ndarray
    scale: float = 1.0
    away: float = 0.0


def best_pairs(top: Top, q: np.ndarray, ids: np.ndarray, m: np.ndarray, metric: str, scale: float, exclude_self: bool, step: int = TILE) -> None:
    """Add all pairs of the queries ``q`` with the rows of ``m`` that can be among the best.

    Values are products over ``scale`` ("dot"), distances turned ("euclidean"), or, of unit vectors, ``1 - product``
    turned ("cosine").
    """
    sift([Kind(top, q, m, scale)], q, ids, m, metric, scale, exclude_self, step)


def sift(kinds: list[Kind], q: np.ndarray, ids: np.ndarray, m: np.ndarray, metric: str, scale: float, exclude_self: bool, step: int = TILE) -> None:
    """``best_pairs`` of several kinds of the same vectors, whose ``k`` is the same.

    Products of ``q`` and ``m`` in single precision sift with a margin for their error; what passes is summed in double
    precision, component by component, which gives the same bits as a fold over the components. A query that hasn't
    ``k`` yet is bounded by the best of the rows at hand, all others by the least of their best.
    """
    turned, k, own = metric == "euclidean", kinds[0].top.k, kinds[0].top.ids
    long, share = q.astype(np.float64), margin_of(q.shape[1])
    exact = [long if x.q is q else x.q.astype(np.float64) for x in kinds]
    size, away = np.sqrt((long**2).sum(axis=1)), max(x.away for x in kinds)
    single = np.concatenate([2 * long, np.ones((len(q), 1))], axis=1).astype(np.float32) if turned else q.astype(np.float32)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    rough, mask = np.empty((len(q), min(step, len(m))), np.float32), np.empty((len(q), min(step, len(m))), bool)

    def measure() -> None:
        r, c = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        if exclude_self:
            other = own[r] != ids[c]
            r, c = r[other], c[other]
        for at in range(0, len(r), 1 << 15):
            row, col = r[at : at + (1 << 15)], c[at : at + (1 << 15)]
            for x, whole in zip(kinds, exact):
                if turned:
                    value = -np.sqrt(np.add.accumulate((whole[row] - x.m[col].astype(np.float64)) ** 2, axis=1)[:, -1])
                else:
                    value = np.add.accumulate(whole[row] * x.m[col].astype(np.float64), axis=1)[:, -1]
                    value = value / x.scale if metric == "dot" else np.clip(value, -1, 1) - 1
                good = value >= x.top.least[row]
                x.top.add(row[good], ids[col[good]], value[good])

    for low in range(0, len(m), step):
        part = m[low : low + step].astype(np.float32)
        square = np.einsum("ij,ij->i", part, part, dtype=np.float64)
        most = float(np.sqrt(square.max()))
        least = np.minimum.reduce([x.top.least for x in kinds]) - away
        if turned:  # the squared distance turned, but for the square of the query
            part = np.concatenate([part, -square[:, None].astype(np.float32)], axis=1)
            margin = share * (1 + (size + most) ** 2)
            bound = size**2 - np.minimum(least, 0) ** 2 - margin
        else:
            margin = share * (1e-30 + size * most)
            bound = (least * scale if metric == "dot" else least + 1) - margin
        if rough.shape[1] != len(part):
            rough, mask = np.empty((len(q), len(part)), np.float32), np.empty((len(q), len(part)), bool)
        np.matmul(single, part.T, out=rough)
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and rough.shape[1] > k + 1:  # the k best of this part, the query itself apart
            kth = np.partition(rough[new], rough.shape[1] - k - 1, axis=1)[:, rough.shape[1] - k - 1]
            bound[new] = np.maximum(bound[new], (np.minimum(kth, 1) if metric == "cosine" else kth) - 2 * margin[new] - 2 * away * scale)
        np.greater_equal(rough, bound.astype(np.float32)[:, None], out=mask)
        r, c = hits(mask)
        waiting.append((r, c + low))
        if len(new) or sum(len(r) for r, _ in waiting) > 2 * len(q):
            measure()
    if waiting:
        measure()
