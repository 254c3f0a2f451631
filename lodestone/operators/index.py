"""Exact vector index: a table of ids and codes, searched whole.

An index is a folder: a Parquet table (id, codes) and one row of metadata. Building checks the vectors (one
dimension, no duplicate ids, ids and vectors present), makes them unit length and quantises them.
``search`` packs both sides into blocks and solves pairs of blocks by matrix products; ``search_native`` is the same
query in Spark's own operators. Both order by falling score, then id, so ties are decided everywhere alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import vector as V
from lodestone.operators import shared
from lodestone.operators.blocks import Top, best_pairs, gathered, matrix, pack, packed, quantize_rows, spread, unit_rows, unpack
from lodestone.operators.shared import small

QUERY_ROWS = 1024
CORPUS_ROWS = 8192
_KINDS = {"fp32": "float32", "int8": "int8", "int16": "int16"}


class VectorError(ValueError):
    """Vectors or arguments that an index can't be built from or searched with."""


@dataclass(frozen=True)
class Index:
    """``table``: (id bigint, codes array); ``raw``: the checked (id, vec) that it was built from, which a search packs without going through columns of codes."""

    table: DataFrame
    dim: int
    mode: str
    raw: DataFrame | None = None

    def count(self) -> int:
        return self.table.count()

    def vector(self, i: int) -> DataFrame:
        """(id, vec) of one id; no rows if it isn't there."""
        return self.scan().where(F.col("id") == i)

    def scan(self) -> DataFrame:
        """(id, vec) of all rows, dequantised."""
        return self.table.select("id", V.dequantize("codes", self.mode).alias("vec"))

    def for_each(self, call: Callable[[int, np.ndarray], None]) -> None:
        """``call(id, vector)`` for every row, where the rows are; an error in it ends the scan."""

        def run(rows) -> None:
            for r in rows:
                call(r["id"], np.array(r["vec"], np.float32))

        self.scan().foreachPartition(run)

    def map_rows(self, call: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str = "double") -> DataFrame:
        """(id, value): ``call(ids, vectors)`` gives the values of a batch of rows, of the Spark type ``kind``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(call(b.column(0).to_numpy(), matrix(b.column(1))))], names=["id", "value"])

        return self.scan().mapInArrow(run, f"id bigint, value {kind}")

    def metadata(self) -> DataFrame:
        n = self.table.agg(F.count("*").cast("bigint").alias("count"))
        return n.select(F.lit(self.dim).alias("dim"), F.lit(self.mode).alias("mode"), "count", (20 + 4 * F.col("count") + F.col("count") * self.dim * (V.bits(self.mode) // 8)).alias("bytes"))

    def save(self, folder: str, mode: str = "errorifexists") -> None:
        self.table.write.mode(mode).parquet(f"{folder}/vectors")
        self.save_metadata(folder, mode)

    def save_metadata(self, folder: str, mode: str = "errorifexists") -> None:
        self.table.sparkSession.createDataFrame([(self.dim, self.mode)], "dim int, mode string").coalesce(1).write.mode(mode).parquet(f"{folder}/metadata")


def load(spark: SparkSession, folder: str) -> Index:
    about = spark.read.parquet(f"{folder}/metadata").first()
    return Index(spark.read.parquet(f"{folder}/vectors").select("id", "codes"), about["dim"], about["mode"])


def exists(spark: SparkSession, folder: str) -> bool:
    return shared.exists(spark, f"{folder}/metadata/_SUCCESS")


def cached(spark: SparkSession, folder: str, make) -> Index:
    """The index in ``folder``, made and saved first if it isn't there."""
    if not exists(spark, folder):
        make().save(folder, "overwrite")
    return load(spark, folder)


def measured(vectors: DataFrame, dim: int | None = None) -> tuple[int, int]:
    """(dimension, number) of rows (id, vec); an error for none, null, repeated or unequal ones. One job, which shuffles the ids alone."""
    found = vectors.agg(
        F.count("*").alias("n"),
        F.sum((F.col("id").isNull() | F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull())).cast("int")).alias("nulls"),
        F.min(F.size("vec")).alias("least"),
        F.max(F.size("vec")).alias("most"),
        F.count_distinct("id").alias("ids"),
    ).first()
    if not found["n"]:
        raise VectorError("there are no vectors")
    if found["nulls"]:
        raise VectorError(f"{found['nulls']} rows have a null id, vector or component")
    if found["least"] != found["most"] or dim and found["most"] != dim:
        raise VectorError(f"dimensions from {found['least']} to {found['most']}, expected {dim or 'one'}")
    if found["ids"] < found["n"]:
        twice = vectors.groupBy("id").count().where("count > 1").first()
        raise VectorError(f"id {twice['id']} occurs {twice['count']} times")
    return found["most"], found["n"]


def check(vectors: DataFrame, dim: int | None = None) -> int:
    """Dimension of rows (id, vec), with the errors of ``measured``."""
    return measured(vectors, dim)[0]


def build(vectors: DataFrame, mode: str = "int8", dim: int | None = None, id_col: str = "id", vec_col: str = "vec", validate: bool = True) -> Index:
    """Index of unit vectors in ``mode``; ``validate=False`` trusts rows and ``dim``."""
    mode = V.parse_quantization(mode)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    if validate:
        dim = check(rows, dim)
    if dim is None:
        raise VectorError("dim is needed for vectors that aren't checked")
    return Index(rows.select("id", V.quantize(V.normalize("vec"), mode).alias("codes")), dim, mode, rows)


def _queries(index: Index, queries: DataFrame, id_col: str, vec_col: str, normalized: bool, k: int, check_dim: bool) -> DataFrame:
    if k < 1:
        raise VectorError("k must be positive")
    rows = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    if check_dim and not (index.raw is not None and rows.sameSemantics(index.raw)):  # what the index was built from was checked
        wrong = rows.where(F.col("vec").isNull() | (F.size("vec") != index.dim)).first()
        if wrong:
            raise VectorError(f"query {wrong['id']} isn't of dimension {index.dim}")
    return rows


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec", normalized: bool = False, exclude_self: bool = False, check_dim: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows with the largest inner product for each query."""
    own = _queries(index, queries, id_col, vec_col, normalized, k, check_dim)
    scale = float(V.SCALES.get(index.mode, 1))
    mode, asked = index.mode, None if normalized else unit_rows
    if index.raw is not None:
        return ranked(solve(own, index.raw, k, "dot", _KINDS[mode], scale, exclude_self, asked, lambda m: quantize_rows(unit_rows(m), mode)), k)
    corpus = index.table.select("id", F.col("codes").alias("vec"))
    return ranked(solve(own, corpus, k, "dot", _KINDS[mode], scale, exclude_self, asked), k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of rows (id, vec) under a metric, without an index; cosine of unit vectors."""
    kind = "euclidean" if metric == "euclidean" else "dot"
    found = ranked(solve(queries, corpus, k, kind, "float32", 1.0, exclude_self), k)
    away = -F.col("score") if kind == "euclidean" else 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    return found.select("query_id", "id", away.alias("distance"), "rank")


def solve(queries: DataFrame, corpus: DataFrame, k: int, metric: str, kind: str, scale: float, exclude_self: bool, ask: Callable | None = None, keep: Callable | None = None) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each task, which hold the best of all.

    Blocks of queries are paired with blocks of the corpus, by broadcast where Spark finds a side small and as a
    cartesian product otherwise; a task keeps the best of a query over all of its blocks. A cartesian product reads
    each side many times, so both are then packed once and written. ``ask`` and ``keep`` are applied to the vectors of
    queries and corpus as they are packed.
    """
    once = not small(queries) and not small(corpus)
    left = packed(queries, QUERY_ROWS, "float32", ask).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    right = pack(corpus, CORPUS_ROWS, kind, keep).select("ids", "matrix")
    if once:
        left, right = spread(left, "query-blocks"), gathered(spread(right, "corpus-blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[str, tuple[Top, np.ndarray]] = {}
        for b in batches:
            for block, q_ids, q_raw, ids, raw in zip(*(b.column(i) for i in range(5))):
                name = block.as_py()
                if name not in tops:
                    own, q = unpack(q_ids.as_py(), q_raw.as_py(), "float32")
                    tops[name] = (Top(own, k), q)
                top, q = tops[name]
                theirs, m = unpack(ids.as_buffer(), raw.as_buffer(), kind)
                best_pairs(top, q, theirs, m, metric, scale, exclude_self)
        for top, _ in tops.values():
            if len(top.row):
                yield pa.RecordBatch.from_arrays([pa.array(top.ids[top.row]), pa.array(top.id), pa.array(top.value)], names=["query_id", "id", "score"])

    return left.crossJoin(right).mapInArrow(run, "query_id bigint, id bigint, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their rank, from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_native(index: Index, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec", normalized: bool = False, exclude_self: bool = False, all_pairs: bool = True) -> DataFrame:
    """As ``search``, by Spark's own operators: a join of all pairs and a window that keeps the best ``k`` before it shuffles.

    Without ``all_pairs`` the pairs that are measured are those that ``search`` finds, which are all that can be among
    the best: the fold over components is interpreted, so of all pairs it takes too long for more than small tables.
    """
    own = _queries(index, queries, id_col, vec_col, normalized, k, False)
    asked = own.select(F.col("id").alias("query_id"), (F.col("vec") if normalized else V.normalize("vec")).alias("query"))
    if all_pairs:
        pairs = index.table.crossJoin(asked)
        if exclude_self:
            pairs = pairs.where(F.col("id") != F.col("query_id"))
    else:
        found = search(index, queries, k, id_col, vec_col, normalized, exclude_self, False).select("query_id", "id")
        pairs = found.join(asked, "query_id").join(index.table, "id")
    return ranked(pairs.select("query_id", "id", V.dot_codes("query", "codes", index.mode).alias("score")), k)
