"""Exact k-nearest-neighbour join of a table of vectors with itself or another, over Voronoi cells.

Both sides are assigned to the nearest of some pivots. Of each cell a summary is kept: how many queries, the largest
distance of a query to the pivot, and the ``k`` least distances of data to the pivot. From these follows, for a cell
``i`` of queries, a bound ``theta`` on the distance of its queries' k-th neighbour (``U_i + |p_i p_j| + |p_j s|`` for
the nearest data), and from that the data that can matter: ``s`` of cell ``j`` only if
``|p_j s| >= |p_i p_j| - U_i - theta_i``. Cells are put together into groups of about ``GROUP`` queries (a cell with
more is cut), data are replicated to the groups that need them, and each group is solved by itself in blocks. A group
that needs more than ``PART`` data is cut by a hash of the data, its queries go to every part, and the best of the parts
are brought together; so no task takes a group of any size, and a few queries don't bring all data to one task.

Blocks are sifted in single precision with a margin for its error, scaled so that it can't overflow, and what passes is
measured in double precision in the order of the components, so results are those of comparing all pairs. Neighbours
are ordered by distance, then id.

Pivots come from a bounded sample, which decides how much is pruned and nothing else. Their number grows with the
square root of the data up to ``PIVOTS``, as the summaries (formed by the executors) and the pairs of cells are handled
on the driver.

Defined cases: rows with a null id or vector, without components, with a null or NaN component or one over ``HUGE`` (its
square would be infinite), or of another dimension than most rows of the data have (the larger of equals) are neither
queries nor data; an id that occurs in several rows is its least vector; in a join of a table with itself a row isn't its
own neighbour, in one of two tables equal ids mean nothing unless ``exclude_self`` says so; fewer than ``k`` others give
all of them; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import Scratch, column

K = 10
PIVOTS = 1024
GROUP = 4096
PART = 1 << 16
BLOCK = 1024
HUGE = 1e150


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def clean(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that count, and their dimension. Vectors of floats stay so."""
    kind = df.select(column(vec_col)).dtypes[0][1]
    rows = df.select(column(id_col).cast("bigint").alias("id"), column(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= HUGE))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & good)
    if dim is None:
        most = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        dim = most["dim"] if most else 1
    rows = rows.where(F.size("vec") == dim)
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # only ids are shuffled for this
        return rows, dim
    return rows.groupBy("id").agg(F.min("vec").alias("vec")), dim


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots**2).sum(axis=1)
        for b in batches:
            vec = _vectors(b.column(1))
            cell, far = np.zeros(len(vec), np.int32), np.zeros(len(vec))
            for low in range(0, len(vec), BLOCK):
                own = vec[low : low + BLOCK]
                with np.errstate(over="ignore", invalid="ignore"):  # any cell will do, as long as the distance is right
                    best = (norms[None, :] - 2 * own @ pivots.T).argmin(axis=1)
                    far[low : low + BLOCK] = np.sqrt(((own - pivots[best]) ** 2).sum(axis=1))
                cell[low : low + BLOCK] = best
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(far)], names=["id", "vec", "cell", "far"])

    return run


def bounds(pivots: np.ndarray, queries: list[tuple[int, int, float]], nearest: list[tuple[int, list[float]]], k: int) -> tuple[dict[int, float], dict[int, dict[int, float]]]:
    """``theta`` of each query cell, and for each query cell the least distance to its pivot that data of a data cell must have.

    ``queries``: (cell, number, largest distance); ``nearest``: (cell, least distances of data). Cells of which nothing can matter are pruned later.
    """
    theta, least = {}, {}
    if not nearest:
        return theta, least
    cells = np.array([j for j, _ in nearest])
    owner = np.repeat(np.arange(len(cells)), [len(x) for _, x in nearest])
    close = np.concatenate([np.asarray(x, float) for _, x in nearest])
    for i, _, largest in queries:
        apart = np.sqrt(((pivots[cells] - pivots[i]) ** 2).sum(axis=1))
        upper = largest + apart[owner] + close
        theta[i] = float(np.partition(upper, k - 1)[k - 1]) if len(upper) >= k else float("inf")
        slack = 1e-9 * (1 + largest + apart)  # for rounding
        bound = apart - largest - theta[i] - slack
        least[i] = dict(zip(cells.tolist(), np.where(np.isnan(bound), -np.inf, bound).tolist()))
    return theta, least


def group_cells(pivots: np.ndarray, queries: list[tuple[int, int, float]], most: int) -> list[list[int]]:
    """Query cells in groups of about ``most`` queries: from the cell farthest from the rest on, always the nearest cell to the group."""
    number = {i: n for i, n, _ in queries}
    left, groups = sorted(number), []
    if not left:
        return groups
    centre = pivots[left].mean(axis=0)
    while left:
        own = pivots[left]
        start = left[int(((own - centre) ** 2).sum(axis=1).argmax())]
        group, total = [start], number[start]
        left.remove(start)
        for i in sorted(left, key=lambda i: (float(((pivots[i] - pivots[start]) ** 2).sum()), i)):
            if total + number[i] > most:
                break
            group.append(i)
            total += number[i]
        left = [i for i in left if i not in set(group)]
        groups.append(group)
    return groups


class _Best:
    """The ``k`` nearest so far of a block of queries, none farther than ``bound``."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, k: int, bound: np.ndarray, exclude_self: bool):
        self.ids, self.vec, self.k, self.exclude_self = ids, vec, k, exclude_self
        self.most = float(np.abs(vec).max(initial=0))
        self.unit, self.single, self.square = 0.0, vec, vec
        self.kth = bound * (1 + 1e-9)
        self.row, self.id, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, vec: np.ndarray) -> None:
        most = max(self.most, float(np.abs(vec).max(initial=0)), 1e-300)
        unit = 2.0 ** np.ceil(np.log2(most))  # components are at most 1 then
        if unit != self.unit:
            self.unit, self.single = unit, (self.vec / unit).astype(np.float32)
            self.square = (self.single**2).sum(axis=1)
        single = (vec / unit).astype(np.float32)
        square = (single**2).sum(axis=1)
        for low in range(0, len(self.ids), 512):
            self._add(ids, vec, single, square, low, min(len(self.ids), low + 512))

    def _add(self, ids: np.ndarray, vec: np.ndarray, single: np.ndarray, square: np.ndarray, low: int, high: int) -> None:
        rough = self.square[low:high, None] + square[None, :] - 2 * (self.single[low:high] @ single.T)
        margin = 1e-4 * (1e-30 + self.square[low:high] + square.max(initial=0))
        limit = (self.kth[low:high] / self.unit) ** 2
        if not np.isfinite(limit).all() and rough.shape[1] > self.k + 1:  # the block's own k nearest are bound enough
            limit = np.fmin(limit, np.partition(rough, self.k, axis=1)[:, self.k] + 2 * margin)
        q, d = np.nonzero(rough <= (limit + margin)[:, None])
        q += low
        if self.exclude_self:
            other = self.ids[q] != ids[d]
            q, d = q[other], d[other]
        if not len(q):
            return
        exact = np.zeros(len(q))
        for at in range(0, len(q), 1 << 15):
            part = slice(at, at + (1 << 15))
            # one component after the other, as a plain loop would
            exact[part] = np.sqrt(np.add.accumulate((self.vec[q[part]] - vec[d[part]]) ** 2, axis=1)[:, -1])
        near = exact <= self.kth[q]
        q, d, exact = q[near], d[near], exact[near]
        first, last = np.searchsorted(self.row, [low, high])
        row, near, dist = np.concatenate([self.row[first:last], q]), np.concatenate([self.id[first:last], ids[d]]), np.concatenate([self.dist[first:last], exact])
        order = np.lexsort((near, dist, row))
        row, near, dist = row[order], near[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.id, self.dist = (np.concatenate([old[:first], new[keep], old[last:]]) for old, new in ((self.row, row), (self.id, near), (self.dist, dist)))
        full = place == self.k - 1
        self.kth[row[full]] = np.minimum(self.kth[row[full]], dist[full])


def _solve(k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: int | None = None
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []
        limits: list[np.ndarray] = []
        best: _Best | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.row):
                place = np.arange(len(best.row)) - np.searchsorted(best.row, best.row) + 1
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.row]), pa.array(best.id), pa.array(place.astype(np.int32)), pa.array(best.dist)], names=["query_id", "id", "rank", "distance"])

        for b in batches:
            if not b.num_rows:
                continue
            groups, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            code = groups.astype(np.int64) * 2 + kinds
            edge = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            own_ids, own, limit = b.column(2).to_numpy(), _vectors(b.column(3)), b.column(4).to_numpy()
            for low, high in zip(edge, edge[1:]):
                if groups[low] != group:
                    yield from close()
                    group, ids, vecs, limits, best = int(groups[low]), [], [], [], None
                if kinds[low] == 0:
                    ids.append(own_ids[low:high])
                    vecs.append(own[low:high])
                    limits.append(limit[low:high])
                elif ids:
                    if best is None:
                        best = _Best(np.concatenate(ids), np.concatenate(vecs), k, np.concatenate(limits), exclude_self)
                    for at in range(low, high, BLOCK):
                        best.add(own_ids[at : min(high, at + BLOCK)], own[at : min(high, at + BLOCK)])
        yield from close()

    return run


def knn_join(queries: DataFrame, data: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, group: int = GROUP, part: int = PART, exclude_self: bool | None = None) -> DataFrame:
    """(query_id, id, rank, distance): the ``k`` nearest rows of ``data`` (or of ``queries`` itself) to every query by Euclidean distance."""
    if k < 1:
        raise ValueError("k must be positive")
    spark, scratch = queries.sparkSession, Scratch()
    exclude_self = data is None if exclude_self is None else exclude_self
    out = "query_id bigint, id bigint, rank int, distance double"
    right, dim = clean(queries if data is None else data, id_col, vec_col)
    # bounded by PIVOTS; which rows are taken changes the work alone
    taken = right.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max(1, min(pivots, int(right.count() ** 0.5)))).collect()
    if not taken:
        return spark.createDataFrame([], out)
    points = np.unique(np.array([r.vec for r in taken], np.float64), axis=0)
    assigned = {}
    for name, rows in (("data", right), ("queries", right if data is None else clean(queries, id_col, vec_col, dim)[0])):
        if name == "queries" and data is None:
            assigned[name] = assigned["data"]
            continue
        kind = f"id bigint, vec {rows.dtypes[1][1]}, cell int, far double"
        assigned[name] = scratch.keep(rows.mapInArrow(_assign(points), kind), f"{name}-cells")
    asked, against = assigned["queries"], assigned["data"]
    query_cells = [(r.cell, r.n, r.far) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()]
    if not query_cells:
        return spark.createDataFrame([], out)
    number = {i: n for i, n, _ in query_cells}
    rows_of = {r.cell: r.n for r in against.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # a query that is among the data may be its own nearest, so one more is needed; tasks give theirs, then cells
    want, kind = k + exclude_self, "cell int, far double"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = against.select("cell", "far").mapInArrow(_least(want), kind).repartition(tasks, "cell").mapInArrow(_least(want), kind)
    found: dict[int, list[float]] = {}
    for r in near.collect():  # at most ``want`` for each of PIVOTS cells
        found.setdefault(r.cell, []).append(r.far)
    theta, least = bounds(points, query_cells, [(j, sorted(x)) for j, x in sorted(found.items())], want)
    homes: list[tuple] = []
    needed: list[tuple] = []
    total, cut = 0, False
    for cells in group_cells(points, query_cells, group):
        wanted: dict[int, float] = {}
        for i in cells:
            for j, x in least.get(i, {}).items():
                wanted[j] = min(wanted.get(j, float("inf")), x)
        across, down = -(-sum(number[i] for i in cells) // group), -(-sum(rows_of[j] for j in wanted) // part)
        homes += [(i, total, across, down, theta.get(i, float("inf"))) for i in cells]
        needed += [(j, total, across, down, x) for j, x in wanted.items()]
        total, cut = total + across * down, cut or down > 1
    # at most PIVOTS rows, and their square, whatever the tables' size; Spark broadcasts them only if they are small
    shape = ["cell", "base", "across", "down"]
    home, pair = (_small(spark, [*shape, last], rows) for last, rows in (("theta", homes), ("least", needed)))
    column_of, row_of = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int") for seed, n in ((1, "across"), (2, "down")))
    own = asked.join(home, "cell").withColumn("at", column_of)
    own = own.select(F.explode(F.expr("transform(sequence(0, down - 1), d -> base + at * down + d)")).alias("grp"), F.lit(0).alias("kind"), "id", "vec", "theta")
    sent = against.join(pair, "cell").where("far >= least").withColumn("at", row_of)
    sent = sent.select(F.explode(F.expr("transform(sequence(0, across - 1), a -> base + a * down + at)")).alias("grp"), F.lit(1).alias("kind"), "id", "vec", F.lit(0.0).alias("theta"))
    both = own.union(sent).repartition(max(1, min(total, 64 * tasks)), "grp").sortWithinPartitions("grp", "kind")
    solved = both.mapInArrow(_solve(k, exclude_self), out)
    if cut:  # the best of all parts of a group
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        solved = solved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scratch.finish(solved, "neighbours")


def _small(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    columns = list(zip(*rows)) or [[]] * len(names)
    kinds = [pa.int32()] * (len(names) - 1) + [pa.float64()]
    return spark.createDataFrame(pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds)}))


def _least(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            cell, far = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((far, cell))
            cell, far = cell[order], far[order]
            place = np.arange(len(cell)) - np.searchsorted(cell, cell)
            for c in np.unique(cell).tolist():
                own = far[(cell == c) & (place < k)]
                kept[c] = np.sort(np.concatenate([kept.get(c, own[:0]), own]))[:k]
        if kept:
            n = [len(x) for x in kept.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(kept), np.int32), n)), pa.array(np.concatenate(list(kept.values())))], names=["cell", "far"])

    return run
