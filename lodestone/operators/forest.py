"""Forests of random hyperplanes for approximate search.

The corpus is cut by a hash of the id into shards that fit a task's memory; each shard has its own forest, built
whole in one task from the shard's vectors, and written as a file to the index folder. A query goes to every shard,
the shard's candidates are measured exactly, and the best of all shards are merged. A corpus of one shard gives the
textbook forest: each tree splits a node by the plane halfway between two of its vectors until a leaf has at most
``leaf`` items; a search follows all trees by one queue, nearest plane first, until ``search_k`` leaves were visited.

Where a search collects fewer than ``k`` candidates of a shard, the shard is searched whole. With ``search_k`` of at
least all leaves, results are exact. Distances rise; equal ones are ordered by id.

A fixed ``search_k`` finds less the larger the shards are. With ``recall`` the leaves of each shard follow from
measuring: a sample of the queries is held against the exact answers, and the least number of leaves is taken at
which the recall, less twice its standard error, is that asked for. Where so many leaves would hold more items than
the shard has, the shard is searched whole, which is exact.
"""

from __future__ import annotations

import heapq
import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import vector as V
from lodestone.operators import index as I
from lodestone.operators.blocks import Top, best_pairs, matrix, pack, unit_rows, unpack
from lodestone.operators.shared import bounded_batches, place, qualified, read_bytes, write_bytes

SHARD_BYTES = 64 << 20
#: Queries that ``recall`` is measured with, and queries of a block.
MEASURED = 96
QUERY_ROWS = 1024
_STRIDE = 7919


@dataclass(frozen=True)
class Options:
    """Values of ``trees`` or ``leaf`` below 1 become 1 and 32."""

    metric: str = "cosine"
    trees: int = 20
    leaf: int = 32
    seed: int = 1

    def __post_init__(self) -> None:
        if self.metric not in ("cosine", "euclidean"):
            raise I.VectorError(f"unknown metric {self.metric!r}")
        if self.trees < 1:
            object.__setattr__(self, "trees", 1)
        if self.leaf < 1:
            object.__setattr__(self, "leaf", 32)


@dataclass
class Tree:
    """Nodes by number, the root being 0; ``left`` is -1 for a leaf, whose ``items`` are positions."""

    normal: list[np.ndarray | None] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    items: list[np.ndarray | None] = field(default_factory=list)

    def add(self, normal=None, threshold: float = 0.0, items=None) -> int:
        self.normal.append(normal)
        self.threshold.append(threshold)
        self.left.append(-1)
        self.right.append(-1)
        self.items.append(items)
        return len(self.left) - 1

    def leaves(self) -> int:
        return sum(x < 0 for x in self.left)


@dataclass
class Forest:
    options: Options
    ids: np.ndarray
    vectors: np.ndarray
    trees: list[Tree]


def grow(vectors: np.ndarray, leaf: int, seed: int) -> Tree:
    """One tree over all rows."""
    rng = np.random.default_rng(seed)
    tree = Tree()
    todo = [(np.arange(len(vectors)), -1, False)]
    while todo:
        items, parent, is_left = todo.pop()
        node = -1
        if len(items) > leaf:
            a, b = rng.integers(len(items)), rng.integers(len(items))
            if a == b:  # one more try
                b = rng.integers(len(items))
            one, two = vectors[items[a]], vectors[items[b]]
            normal = two - one
            if not normal.any():
                normal = rng.standard_normal(vectors.shape[1]).astype(np.float32)
            normal = unit_rows(normal)
            threshold = np.float32(normal @ ((one + two) / 2))
            low = vectors[items] @ normal <= threshold
            if low.any() and not low.all():
                node = tree.add(normal, float(threshold))
                todo.append((items[~low], node, False))
                todo.append((items[low], node, True))
        if node < 0:  # small enough, or nothing to tell its items apart
            node = tree.add(items=items.astype(np.int32))
        if parent >= 0:
            (tree.left if is_left else tree.right)[parent] = node
    return tree


def build_local(ids: np.ndarray, vectors: np.ndarray, options: Options) -> Forest:
    order = np.argsort(ids, kind="stable")
    own = vectors[order].astype(np.float32)
    if options.metric == "cosine":
        own = unit_rows(own)
    return Forest(options, ids[order], own, [grow(own, options.leaf, options.seed + t * _STRIDE) for t in range(options.trees)])


def candidates(forest: Forest, query: np.ndarray, search_k: int) -> np.ndarray:
    """Positions in the first ``search_k`` leaves."""
    found = visit(forest, query, search_k)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def visit(forest: Forest, query: np.ndarray, search_k: int) -> list[np.ndarray]:
    """Items of the first ``search_k`` leaves in order, all trees in one queue by the distance to the last plane crossed."""
    queue: list[tuple[float, int, int, int]] = [(0.0, t, t, 0) for t in range(len(forest.trees))]
    heapq.heapify(queue)
    order, visited, found = len(queue), 0, []
    while queue and visited < search_k:
        _, _, t, node = heapq.heappop(queue)
        tree = forest.trees[t]
        if tree.left[node] < 0:
            visited += 1
            found.append(tree.items[node])
            continue
        margin = float(tree.normal[node] @ query) - tree.threshold[node]
        near, far = (tree.left[node], tree.right[node]) if margin <= 0 else (tree.right[node], tree.left[node])
        heapq.heappush(queue, (abs(margin), order, t, near))
        heapq.heappush(queue, (abs(margin) + 1e-6, order + 1, t, far))
        order += 2
    return found


def distances(metric: str, query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    q, v = query.astype(np.float64), vectors.astype(np.float64)
    if not len(v):
        return np.zeros(0)
    if metric == "euclidean":
        return np.sqrt(np.add.accumulate((v - q) ** 2, axis=1)[:, -1])
    return 1 - np.clip(np.add.accumulate(v * q, axis=1)[:, -1], -1, 1)


def search_local(forest: Forest, query: np.ndarray, k: int, search_k: int | None = None, exclude: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` nearest candidates; a shard that gave fewer than ``k`` is searched whole."""
    if forest.options.metric == "cosine":
        query = unit_rows(query)
    want = k + (exclude is not None)
    at = candidates(forest, query, search_k if search_k and search_k > 0 else len(forest.trees) * want)
    if len(at) < want:
        at = np.arange(len(forest.ids))
    ids, away = forest.ids[at], distances(forest.options.metric, query, forest.vectors[at])
    if exclude is not None:
        ids, away = ids[ids != exclude], away[ids != exclude]
    order = np.lexsort((ids, away))[:k]
    return ids[order], away[order]


def search_whole(forest: Forest, queries: np.ndarray, k: int, exclude: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and distances of the ``k`` nearest of all vectors, for every query: ``best_pairs`` of the shard as one block."""
    metric = forest.options.metric
    q = unit_rows(queries) if metric == "cosine" else queries.astype(np.float32)
    top = Top(exclude if exclude is not None else np.arange(len(q)), k)
    if len(q) and len(forest.ids):
        best_pairs(top, q, forest.ids, forest.vectors, metric, 1.0, exclude is not None)
    edge = np.searchsorted(top.row, np.arange(len(q) + 1))
    return [(top.id[low:high], 0 - top.value[low:high]) for low, high in zip(edge, edge[1:])]


def leaves_for(forest: Forest, queries: np.ndarray, k: int, recall: float, exclude: np.ndarray | None = None) -> int:
    """Least number of leaves at which ``queries`` find ``recall`` of their ``k`` nearest, less twice its standard error; 0: search the shard whole."""
    most = len(forest.ids) // forest.options.leaf
    truth = search_whole(forest, queries, k, exclude)
    if not most or not len(queries) or not all(len(ids) for ids, _ in truth):
        return 0
    place = np.argsort(forest.ids, kind="stable")
    hits = np.zeros((len(queries), most + 1))
    asked = unit_rows(queries) if forest.options.metric == "cosine" else queries
    for n, (q, (ids, _)) in enumerate(zip(asked, truth)):
        near = np.zeros(len(forest.ids), bool)
        near[place[np.searchsorted(forest.ids, ids, sorter=place)]] = True
        for leaf, items in enumerate(visit(forest, q, most)):
            new = items[near[items]]
            near[new] = False
            hits[n, leaf + 1] = len(new) / len(ids)
    got = np.cumsum(hits, axis=1)
    sure = got.mean(axis=0) - 2 * got.std(axis=0) / np.sqrt(len(got))
    enough = np.flatnonzero(sure >= recall)
    return int(enough[0]) if len(enough) else 0


def build(vectors: DataFrame, folder: str, options: Options = Options(), id_col: str = "id", vec_col: str = "vec", shard_bytes: int = SHARD_BYTES, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Build and write the forest; (shard, file, rows, leaves) of each shard. Files of lost attempts aren't listed.

    ``progress(trees done, trees in all)`` is called on the driver while the executors build, as their tasks end, and at the end.
    """
    from lodestone.sources.index_files import write_forest

    bounded_batches(vectors.sparkSession)
    folder = qualified(vectors.sparkSession, folder)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    dim, count = I.measured(rows)
    shards = max(1, -(-count * dim * 4 // shard_bytes))
    grown = vectors.sparkSession.sparkContext.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(shard: int) -> pa.RecordBatch:
            own = held.pop(shard)
            forest = build_local(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]), options)
            grown.add(len(forest.trees))
            name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.forest"
            write_bytes(f"{folder}/{name}.ids", forest.ids.astype("<i8").tobytes())
            write_bytes(f"{folder}/{name}", write_forest(Forest(options, np.arange(len(forest.ids)), forest.vectors, forest.trees)))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(forest.ids)], pa.int64()), pa.array([sum(t.leaves() for t in forest.trees)], pa.int64())], names=["shard", "file", "rows", "leaves"])

        for b in batches:
            if not b.num_rows:
                continue
            shard, ids, vecs = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)).astype(np.float32)
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for low, high in zip(edge, edge[1:]):
                for done in [s for s in held if s != shard[low]]:
                    yield close(done)
                held.setdefault(int(shard[low]), []).append((ids[low:high], vecs[low:high]))
        for done in list(held):
            yield close(done)

    hashed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vec")
    built = hashed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, file string, rows bigint, leaves bigint")
    with _watched(grown, shards * options.trees, progress):
        listed = [r.asDict() for r in built.collect()]  # a row a shard
    write_bytes(f"{folder}/forest.json", json.dumps({"options": asdict(options), "dim": dim, "shards": listed}).encode())
    return load(vectors.sparkSession, folder)


@contextmanager
def _watched(done: Accumulator, total: int, progress: Callable[[int, int], None] | None) -> Iterator[None]:
    """Tells ``progress`` what is done while the block runs, and that all is at its end."""
    if progress is None:
        yield
        return
    ended = threading.Event()

    def watch() -> None:
        last = -1
        while not ended.wait(0.2):
            now = min(done.value, total - 1)  # a task that ran twice counts twice
            if now != last:
                progress(now, total)
                last = now

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
    progress(total, total)


def _about(spark: SparkSession, folder: str) -> dict:
    return json.loads(read_bytes(f"{qualified(spark, folder)}/forest.json"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, file, rows, leaves) of a written forest."""
    about = _about(spark, folder)
    return spark.createDataFrame([(r["shard"], r["file"], r["rows"], r["leaves"]) for r in about["shards"]], "shard int, file string, rows bigint, leaves bigint")


_open: dict[tuple[str, bool], Forest] = {}


def open_shard(folder: str, file: str, trees: bool = True) -> Forest:
    """Read once in each Python worker; one shard is held at a time. Without ``trees`` only ids and vectors are read, which is all that a search of the whole shard needs."""
    from lodestone.sources.index_files import forest_head, read_forest

    key = (f"{folder}/{file}", trees)
    if key not in _open:
        _open.clear()
        if trees:
            forest = read_forest(read_bytes(key[0]))
        else:
            system, path = place(key[0])
            with system.open_input_file(path) as f:
                forest = forest_head(f)
        forest.ids = np.frombuffer(read_bytes(f"{key[0]}.ids"), "<i8")
        _open[key] = forest
    return _open[key]


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row a node: (shard, tree, node, leaf, hyperplane, threshold, left, right, items)."""
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float32()), pa.float32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for b in batches:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest = open_shard(folder, file)
                for t, tree in enumerate(forest.trees):
                    rows = [(shard, t, n, left < 0, normal, threshold, left, right, None if items is None else forest.ids[items]) for n, (normal, threshold, left, right, items) in enumerate(zip(tree.normal, tree.threshold, tree.left, tree.right, tree.items))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "tree", "node", "leaf", "hyperplane", "threshold", "left", "right", "items"])

    return load(spark, folder).select("shard", "file").mapInArrow(run, "shard int, tree int, node int, leaf boolean, hyperplane array<float>, threshold float, left int, right int, items array<bigint>")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, position, id, vec) of the vectors that a forest's files hold."""
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                forest = open_shard(folder, file)
                for low in range(0, len(forest.ids), 4096):
                    part = forest.vectors[low : low + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.reshape(-1)))
                    places = np.arange(low, low + len(part), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(places), pa.array(forest.ids[low : low + 4096]), lists], names=["shard", "position", "id", "vec"])

    return load(spark, folder).select("shard", "file").mapInArrow(run, "shard int, position bigint, id bigint, vec array<float>")


def vector_at(spark: SparkSession, folder: str, shard: int, position: int) -> np.ndarray:
    """The vector at a place of a shard; an ``IndexError`` beyond its end."""
    folder = qualified(spark, folder)
    file = next((s["file"] for s in _about(spark, folder)["shards"] if s["shard"] == shard), None)
    if file is None or position < 0:
        raise IndexError(position)
    return open_shard(folder, file).vectors[position]


def _over_shards(queries: DataFrame, folder: str, answer, out: str, names: list[str], whole: frozenset[str] = frozenset()) -> DataFrame:
    """``answer(forest, ids, vectors, file)`` for every block of queries and every shard; those of the files ``whole`` are opened without trees."""
    folder = qualified(queries.sparkSession, folder)
    blocks = pack(queries.select(F.col("id"), F.col("vec").cast("array<float>").alias("vec")), QUERY_ROWS, "float32").select("block", "ids", "matrix")
    shards = load(queries.sparkSession, folder).select("shard", "file")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, ids, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own, q = unpack(ids.as_py(), raw.as_py(), "float32")
                yield pa.RecordBatch.from_arrays(answer(open_shard(folder, file, file not in whole), own, q, file), names=names)

    # a row a shard: names alone, which Spark broadcasts while they are small; a task gets the blocks of few shards
    ordered = blocks.crossJoin(shards).repartitionByRange(parts, "file", "block").sortWithinPartitions("file")
    return ordered.select("file", "ids", "matrix").mapInArrow(run, out)


def measured_leaves(queries: DataFrame, folder: str, k: int, recall: float, exclude_self: bool) -> dict[str, int]:
    """Leaves of each shard's file that ``recall`` needs (``leaves_for``), by ``MEASURED`` of the queries."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED).collect()  # bounded
    if not sample:
        return {}
    ids = np.array([r.id if r.id is not None else 0 for r in sample], np.int64)
    q = np.array([r.vec for r in sample], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([leaves_for(open_shard(folder, f), q, k, recall, ids if exclude_self else None) for f in files], pa.int32())], names=["file", "need"])

    shards = load(queries.sparkSession, folder)
    parts = max(1, shards.count())
    return {r.file: r.need for r in shards.select("file").repartition(parts).mapInArrow(run, "file string, need int").collect()}  # a row a shard


def search(queries: DataFrame, folder: str, k: int = 10, search_k: int | None = None, exclude_self: bool = False, id_col: str = "id", vec_col: str = "vec", recall: float | None = None) -> DataFrame:
    """(query_id, id, distance, rank); ``search_k`` leaves of each shard, ``trees * k`` unless given, or as many as ``recall`` needs."""
    if k < 1:
        raise I.VectorError("k must be positive")
    if recall is not None and (search_k is not None or not 0 < recall <= 1):
        raise I.VectorError("recall must be in (0, 1] and takes the place of search_k")
    folder = qualified(queries.sparkSession, folder)
    about = _about(queries.sparkSession, folder)
    dim = about["dim"]
    rows = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    wrong = rows.where(F.col("vec").isNull() | (F.size("vec") != dim)).first()
    if wrong:
        raise I.VectorError(f"query {wrong['id']} isn't of dimension {dim}")
    need = measured_leaves(rows, folder, k, recall, exclude_self) if recall is not None else {}

    # to visit all leaves is to search the shard whole
    whole = frozenset(s["file"] for s in about["shards"] if (not need.get(s["file"]) if recall is not None else search_k is not None and search_k >= s["leaves"]))

    def answer(forest: Forest, ids: np.ndarray, q: np.ndarray, file: str) -> list[pa.Array]:
        if file in whole:
            found = search_whole(forest, q, k, ids if exclude_self else None)
        else:
            found = [search_local(forest, v, k, need.get(file, search_k), int(i) if exclude_self else None) for i, v in zip(ids, q)]
        return [pa.array(np.repeat(ids, [len(a) for a, _ in found])), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([d for _, d in found]))]

    scored = _over_shards(rows, folder, answer, "query_id bigint, id bigint, distance double", ["query_id", "id", "distance"], whole)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_sets(queries: DataFrame, folder: str, search_k: int) -> DataFrame:
    """(query_id, id) of every candidate, without measuring."""

    def answer(forest: Forest, ids: np.ndarray, q: np.ndarray, file: str) -> list[pa.Array]:
        found = [forest.ids[candidates(forest, unit_rows(v) if forest.options.metric == "cosine" else v, search_k)] for v in q]
        return [pa.array(np.repeat(ids, [len(a) for a in found])), pa.array(np.concatenate(found).astype(np.int64))]

    return _over_shards(queries, folder, answer, "query_id bigint, id bigint", ["query_id", "id"]).distinct()


def evaluate(vectors: DataFrame, folder: str, n: int, k: int = 10, search_k: int | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, recall) of the forest against the exact search, for the first ``n`` rows by id."""
    from lodestone.operators.evaluate import first_by_id, recall

    asked = first_by_id(vectors, n)
    rows = vectors.select("id", V.normalize("vec").alias("vec")) if metric == "cosine" else vectors
    near = asked.select("id", V.normalize("vec").alias("vec")) if metric == "cosine" else asked
    truth = I.nearest(near, rows, k, metric, exclude_self=True)
    return recall(truth, search(asked, folder, k, search_k, exclude_self=True))
