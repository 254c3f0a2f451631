"""Recall of searches against a truth, sweeps over dimensions and quantisation, and pairwise similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import vector as V
from lodestone.operators import index as I
from lodestone.operators.blocks import Kind, Top, gathered, hits, margin_of, pack, packed, quantize_rows, sift, spread, unit_rows, unpack
from lodestone.operators.shared import small


def sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``n`` rows that follow from the seed and their ids alone."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col))), id_col).limit(n)


def first_by_id(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def recall(truth: DataFrame, found: DataFrame, empty: float = 0.0) -> DataFrame:
    """(query_id, recall): common ids over the smaller of both sets; ``empty`` where one has none."""
    a = truth.groupBy("query_id").agg(F.collect_set("id").alias("truth"))
    b = found.groupBy("query_id").agg(F.collect_set("id").alias("found"))
    both = a.join(b, "query_id", "full")
    least = F.least(F.coalesce(F.size("truth"), F.lit(0)), F.coalesce(F.size("found"), F.lit(0)))
    least = F.when(F.col("truth").isNull() | F.col("found").isNull(), F.lit(0)).otherwise(least)
    return both.select("query_id", F.when(least > 0, F.size(F.array_intersect("truth", "found")) / least).otherwise(F.lit(empty)).alias("recall"))


def sweep(vectors: DataFrame, dims: list[int], modes: list[str], k: int = 10, base_dim: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(dim, mode, bytes, recall): mean recall@k of each prefix and quantisation against whole vectors in fp32, a query itself apart.

    One pass over the pairs of blocks serves all configurations: a task keeps the best of a query for each of them, and
    what is shuffled is ``k`` rows a query, configuration and task.
    """
    asked = (vectors if queries is None else queries).select("id", F.col("vec").cast("array<float>").alias("vec"))
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    _, count = I.measured(rows, base_dim)
    modes = [V.parse_quantization(m) for m in modes]
    kinds: list[tuple[int | None, str]] = [(None, "fp32"), *((d, m) for d in dims for m in modes)]

    def cut(m: np.ndarray, dim: int | None) -> np.ndarray:
        return unit_rows(m) if dim is None else unit_rows(unit_rows(m[:, :dim]))  # a prefix is made a unit vector, then indexed or asked for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[str, tuple[list[Top], dict]] = {}
        last, heads, coded = "", {}, []
        for b in batches:
            for block, q_ids, q_raw, name, ids, raw in zip(*(b.column(i) for i in range(6))):
                if block.as_py() not in tops:
                    own, q = unpack(q_ids.as_buffer(), q_raw.as_buffer(), "float32")
                    tops[block.as_py()] = ([Top(own, k) for _ in kinds], {dim: cut(q, dim) for dim, _ in kinds})
                if name.as_py() != last:
                    theirs, m = unpack(ids.as_buffer(), raw.as_buffer(), "float32")
                    heads = {dim: cut(m, dim) for dim, _ in kinds}
                    last, coded = name.as_py(), [quantize_rows(heads[dim], mode) for dim, mode in kinds]
                    scales = [float(V.SCALES.get(mode, 1)) for _, mode in kinds]
                    near = [m.shape[1] if dim is None and m.shape[1] in heads else dim for dim, _ in kinds]  # whose product sifts: codes are so near to their vectors that one does for all of them
                    away = [float(np.sqrt(((heads[dim] - c / s) ** 2).sum(axis=1).max())) * 1.001 + 1e-6 for dim, c, s in zip(near, coded, scales)]
                own_tops, own_heads = tops[block.as_py()]
                for dim in dict.fromkeys(near):
                    same = [Kind(own_tops[n], own_heads[d], coded[n], scales[n], away[n]) for n, (d, _) in enumerate(kinds) if near[n] == dim]
                    sift(same, own_heads[dim], theirs, heads[dim], "dot", 1.0, True)
        for found, _ in tops.values():
            for n, top in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.row), n, np.int32)), pa.array(top.ids[top.row]), pa.array(top.id), pa.array(top.value)], names=["kind", "query_id", "id", "score"])

    left, right = packed(asked, I.QUERY_ROWS, "float32").select("block", "ids", "matrix"), pack(rows, I.CORPUS_ROWS, "float32").select("block", "ids", "matrix")
    if not small(asked) and not small(rows):
        left, right = spread(left, "query-blocks"), gathered(spread(right, "corpus-blocks"))
    pairs = left.toDF("q_block", "q_ids", "q_matrix").crossJoin(right)
    found = pairs.mapInArrow(run, "kind int, query_id bigint, id bigint, score double").repartition("query_id")
    w = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    there = lambda n: F.max((F.col("kind") == n).cast("int"))
    each = best.groupBy("query_id", "id").agg(*(there(n).alias(f"k{n}") for n in range(len(kinds))))
    sums = [F.sum(f"k{n}").alias(f"n{n}") for n in range(len(kinds))] + [F.sum(F.col("k0") * F.col(f"k{n}")).alias(f"c{n}") for n in range(len(kinds))]
    query = each.groupBy("query_id").agg(*sums)
    least = lambda n: F.least("n0", f"n{n}")
    means = query.agg(*(F.avg(F.when(least(n) > 0, F.col(f"c{n}") / least(n)).otherwise(0.0)).alias(f"r{n}") for n in range(1, len(kinds))))
    lines = [F.struct(F.lit(d).alias("dim"), F.lit(m).alias("mode"), F.lit(index_size(count, d, m)).cast("bigint").alias("bytes"), F.col(f"r{n}").alias("recall")) for n, (d, m) in enumerate(kinds) if n]
    return means.select(F.inline(F.array(*lines)))


def index_size(count: int, dim: int, mode: str) -> int:
    """Bytes of an index file: header, 32-bit ids, codes."""
    return 20 + 4 * count + count * dim * (V.bits(mode) // 8)


class Side:
    """A block of a pair: ids, vectors, their lengths, single-precision unit vectors to sift by, and the last ``tail`` components, which aren't part of a vector."""

    def __init__(self, ids: pa.Buffer, raw: pa.Buffer, tail: int):
        self.ids, m = unpack(ids, raw, "float64")
        if tail:
            order = np.argsort(m[:, -1], kind="stable")
            self.ids, m = self.ids[order], m[order]
        self.m, self.tail = np.ascontiguousarray(m[:, : m.shape[1] - tail]), m[:, m.shape[1] - tail :]
        self.size = np.sqrt(np.add.accumulate(self.m * self.m, axis=1)[:, -1])
        self.none = ~((self.size > 0) & np.isfinite(self.size))  # cosines with these are NaN
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.where(self.none[:, None], 0, self.m / self.size[:, None]).astype(np.float32)
        self.low, self.high = self.ids.min(), self.ids.max()


def _cosines(x: Side, y: Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Summed component by component in double precision; NaN with a zero vector."""
    out = np.empty(len(r))
    for at in range(0, len(r), 1 << 15):
        row, col = r[at : at + (1 << 15)], c[at : at + (1 << 15)]
        size = x.size[row] * y.size[col]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + (1 << 15)] = np.where(size == 0, np.nan, np.add.accumulate(x.m[row] * y.m[col], axis=1)[:, -1] / size)
    return out


def _rough(x: Side, y: Side) -> np.ndarray:
    """Cosines in single precision; below all for those that are NaN."""
    rough = x.unit @ y.unit.T
    if x.none.any():
        rough[x.none] = -np.inf
    if y.none.any():
        rough[:, y.none] = -np.inf
    return rough


def _pairs(vectors: DataFrame, use: Callable[[Iterator[tuple[Side, Side, bool]]], Iterator[pa.RecordBatch]], out: str, tail: int = 0) -> DataFrame:
    """``use`` of all pairs of blocks in the upper triangle, and whether both are the same."""
    blocks = packed(vectors, 2048, "float64").select("block", "ids", "matrix")
    other = blocks
    if not small(vectors):
        blocks = spread(blocks, "pair-blocks")  # read many times
        other = gathered(blocks)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Side, Side, bool]]:
        last, x = None, None
        for batch in batches:
            for name, i, v, second, j, w in zip(*(batch.column(n) for n in range(6))):
                if name.as_py() != last:
                    last, x = name.as_py(), Side(i.as_buffer(), v.as_buffer(), tail)
                same = last == second.as_py()
                yield x, x if same else Side(j.as_buffer(), w.as_buffer(), tail), same

    pairs = blocks.toDF("a_block", "a_ids", "a_matrix").crossJoin(other.toDF("b_block", "b_ids", "b_matrix")).where("a_block <= b_block")
    return pairs.mapInArrow(lambda batches: use(solved(batches)), out)


def _single(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<float>").cast("array<double>").alias("vec"))


def pairwise(vectors: DataFrame, best: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs of rows with ``a < b``, each once; rows without a vector are left out.

    With ``best``, each task gives no more than the ``best`` most similar pairs, which hold those of all; NaN of zero
    vectors is none of them. Products in single precision sift, with a margin for their error; cosines that may be among
    the best are summed component by component, as all are without ``best``.
    """

    def kept_apart(x: Side, y: Side, same: bool, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = x.ids[r] < y.ids[c] if same else x.ids[r] != y.ids[c]
        return r[good], c[good]

    def use(blocks: Iterator[tuple[Side, Side, bool]]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for x, y, same in blocks:
            if best is None:
                for low in range(0, len(x.ids), 32):
                    r, c = kept_apart(x, y, same, *(n.reshape(-1) for n in np.mgrid[low : min(low + 32, len(x.ids)), : len(y.ids)]))
                    a, b = x.ids[r], y.ids[c]
                    yield pa.RecordBatch.from_arrays([pa.array(n) for n in (np.minimum(a, b), np.maximum(a, b), _cosines(x, y, r, c))], names=["a", "b", "similarity"])
                continue
            rough, margin = _rough(x, y), margin_of(x.m.shape[1])
            least = kept[2][best - 1] - margin if len(kept[2]) == best else -np.inf
            if np.isneginf(least):
                valid = rough[x.ids[:, None] < y.ids[None, :] if same else x.ids[:, None] != y.ids[None, :]]
                if len(valid) > best:
                    least = float(np.partition(valid, len(valid) - best)[len(valid) - best]) - 2 * margin
            r, c = kept_apart(x, y, same, *hits(rough >= np.float32(least)))
            for at in range(0, len(r), 1 << 16):
                row, col = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                value, a, b = _cosines(x, y, row, col), x.ids[row], y.ids[col]
                good = ~np.isnan(value)
                a, b, value = (np.concatenate([old, new[good]]) for old, new in zip(kept, (np.minimum(a, b), np.maximum(a, b), value)))
                order = np.lexsort((b, a, -value))[:best]
                kept = (a[order], b[order], value[order])
        if best is not None and len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["a", "b", "similarity"])

    return _pairs(_single(vectors), use, "a bigint, b bigint, similarity double")


def similarity_of_groups(vectors: DataFrame, group_col: str) -> DataFrame:
    """(group_a, group_b, pairs, most) of rows (id, vec) with a whole number as group: of all pairs ``a < b``, how many there are and the largest similarity.

    The group goes with the vector into its block, so each task gives a row for each two groups that it met and no pair
    leaves it. Rows of a block are ordered by group, so pairs are counted, and the largest of their products in single
    precision found, by rectangles; only what may be above the largest so far is summed in double precision.
    """

    def use(blocks: Iterator[tuple[Side, Side, bool]]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[float, float], tuple[int, float]] = {}

        def meet(x: Side, y: Side, rough: np.ndarray, before: np.ndarray | None) -> None:
            """Of the pairs (row of x, row of y) that ``before`` has, or all."""
            edges = [np.flatnonzero(np.diff(s.tail[:, 0], prepend=np.nan) != 0) for s in (x, y)]
            spans = [np.diff(e, append=len(s.ids)) for e, s in zip(edges, (x, y))]
            if before is None:
                n = spans[0][:, None] * spans[1][None, :]
            else:
                if not before.any():
                    return
                rough = np.where(before, rough, np.float32(-np.inf))
                n = np.add.reduceat(np.add.reduceat(before, edges[0], axis=0, dtype=np.int32), edges[1], axis=1)
            top = np.maximum.reduceat(np.maximum.reduceat(rough, edges[0], axis=0), edges[1], axis=1).astype(np.float64)
            keys = [[(g, h) for h in y.tail[edges[1], 0].tolist()] for g in x.tail[edges[0], 0].tolist()]
            have, margin = np.array([[kept.get(k, (0, -np.inf))[1] for k in line] for line in keys]), margin_of(x.m.shape[1])
            bound = np.where((top + margin >= have) & ~np.isneginf(top), np.maximum(have - margin, top - 2 * margin), np.inf)
            lines = np.flatnonzero(np.repeat((bound < np.inf).any(axis=1), spans[0]))
            if len(lines):
                part = rough if len(lines) == len(rough) else rough[lines]
                limit = np.repeat(bound.astype(np.float32), spans[1], axis=1)[np.repeat(np.arange(len(bound)), spans[0])[lines]]
                r, c = hits(part >= limit)
                r = lines[r]
                cosine = _cosines(x, y, r, c)
                g, h = (np.repeat(np.arange(len(s)), s)[at] for s, at in zip(spans, (r, c)))
                np.maximum.at(have, (g, h), np.where(np.isnan(cosine), -np.inf, cosine))
            for line, counts, best in zip(keys, n.tolist(), have.tolist()):
                for key, count, most in zip(line, counts, best):
                    if count:
                        kept[key] = (kept.get(key, (0, 0))[0] + count, most)

        for x, y, same in blocks:
            rough = _rough(x, y)
            if not same and x.high < y.low:
                meet(x, y, rough, None)
            elif not same and y.high < x.low:
                meet(y, x, np.ascontiguousarray(rough.T), None)
            else:
                meet(x, y, rough, x.ids[:, None] < y.ids[None, :])
                if not same:
                    meet(y, x, np.ascontiguousarray(rough.T), y.ids[:, None] < x.ids[None, :])
        if kept:
            a, b = zip(*kept)
            n, most = zip(*kept.values())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64)), pa.array(n, pa.int64()), pa.array(most, pa.float64())], names=["group_a", "group_b", "pairs", "most"])

    kind = vectors.select(group_col).dtypes[0][1]
    tailed = F.concat(F.col("vec").cast("array<float>").cast("array<double>"), F.array(F.col(group_col).cast("double")))
    rows = vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.col(group_col).isNotNull()).select("id", tailed.alias("vec"))
    parts = _pairs(rows, use, "group_a bigint, group_b bigint, pairs bigint, most double", 1)
    both = parts.groupBy("group_a", "group_b").agg(F.sum("pairs").alias("pairs"), F.max("most").alias("most"))
    most = F.when(F.col("most") > float("-inf"), F.col("most"))
    return both.select(F.col("group_a").cast(kind).alias("group_a"), F.col("group_b").cast(kind).alias("group_b"), "pairs", most.alias("most"))


def most_similar(vectors: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` pairs of rows with the largest similarity, the first by ids of equals."""
    return pairwise(vectors, n).orderBy(F.desc("similarity"), "a", "b").limit(n)


def argmax_pair(vectors: DataFrame) -> DataFrame:
    """(a, b, similarity): the pair of the largest similarity above 0, the first by ids of equals; where none is above 0, the least id twice and 0."""
    best = most_similar(vectors, 1).where("similarity > 0")
    least = vectors.where(F.col("vec").isNotNull()).agg(F.min("id").alias("least"))
    both = least.join(best, F.lit(True), "left").where("least is not null")  # a row each
    return both.select(F.coalesce("a", "least").alias("a"), F.coalesce("b", "least").alias("b"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
