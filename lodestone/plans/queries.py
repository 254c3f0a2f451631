"""Queries of the vector engine over the tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import prompts as P
from lodestone.functions import vector as V
from lodestone.functions.formats import duration
from lodestone.functions.stats import latency_summary
from lodestone.operators import encoder as N
from lodestone.operators import evaluate as E
from lodestone.operators import forest as T
from lodestone.operators import index as I
from lodestone.operators import tokenizer as K_
from lodestone.operators.shared import materialize, shared_folder, write_bytes
from lodestone.operators.tokenizer import mark_spaces_column
from lodestone.sources import gguf as G
from lodestone.sources import index_files as B
from lodestone.sources import sample as S

K = 10
SWEEP_DIMS = [64, 32, 16, 8]
SWEEP_MODES = ["fp32", "int16", "int8"]
PREFIX = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _self_search(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return I.search(I.build(rows, mode), rows, K, exclude_self=True)


def knn_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector."""
    return _self_search(spark, sf_dir, "fp32")


def knn_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _self_search(spark, sf_dir, "int8")


def knn_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _self_search(spark, sf_dir, "int16")


def knn_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return I.search_native(I.build(rows, "int8"), rows, K, exclude_self=True, all_pairs=False)


def knn_pre_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return I.search(I.build(rows, "fp32"), rows, K, normalized=True)


def knn_prefix_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", V.truncate("vec", PREFIX).alias("vec"))
    return I.search(I.build(rows, "fp32"), rows, K, exclude_self=True)


def knn_exact_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return I.nearest(rows, rows, K, "euclidean", exclude_self=True)


def knn_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a neighbour has the label of the vector it was asked for, by label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = knn_exact_cosine(spark, sf_dir)
    own = labels.select(F.col("vec_id").alias("query_id"), "label")
    theirs = labels.select(F.col("vec_id").alias("id"), F.col("label").alias("other"))
    joined = found.join(own, "query_id").join(theirs, "id")
    return joined.groupBy("label").agg(F.count("*").alias("neighbours"), F.sum((F.col("label") == F.col("other")).cast("bigint")).alias("agreeing"))


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", V.normalize(F.transform("vec", lambda x: x * F.lit(3.0).cast("float"))).alias("vec"))
    return rows.select("id", "vec", V.magnitude("vec").alias("size"))


def quantize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", V.normalize("vec").alias("vec"))
    wide = lambda c: F.transform(c, lambda x: x.cast("int"))
    return rows.select("id", wide(V.quantize("vec", "int8")).alias("int8_codes"), wide(V.quantize("vec", "int16")).alias("int16_codes"))


def dequantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference of a component after quantising."""
    rows = vectors(spark, sf_dir).select("id", V.normalize("vec").alias("vec"))
    worst = lambda mode: F.array_max(F.zip_with("vec", V.dequantize(V.quantize("vec", mode), mode), lambda a, b: F.abs(a - b)))
    return rows.select("id", worst("int8").alias("int8_error"), worst("int16").alias("int16_error"))


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(vectors(spark, sf_dir), "int8").scan()


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build(vectors(spark, sf_dir), "int16").vector(7)


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return I.build(rows, "fp32").metadata().union(I.build(rows, "int16").metadata()).union(I.build(rows, "int8").metadata())


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched after it was written and read again."""
    rows = vectors(spark, sf_dir)
    folder = shared_folder(spark, "index")
    built = I.cached(spark, folder, lambda: I.build(rows, "int8"))
    return I.search(built, rows, K)


def recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(vectors(spark, sf_dir), SWEEP_DIMS, SWEEP_MODES, K)


def pairwise_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.most_similar(vectors(spark, sf_dir))


def similarity_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and their largest similarity, by the labels of both."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return E.similarity_of_groups(rows, "label").withColumnsRenamed({"group_a": "label_a", "group_b": "label_b"})


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label: components are averaged by their place, so a label with most rows is summed where they are first."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg((F.round(F.avg(F.col("x").cast("double")), 6) + 0.0).alias("mean"), F.count("*").alias("n"))
    lists = means.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("means"))  # as many as components
    return lists.select("label", "n", F.col("means.mean").alias("centroid"))


def argmax_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar two, by the rule that a similarity has to be above 0."""
    return E.argmax_pair(vectors(spark, sf_dir))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events, taken as nanoseconds of all sizes, in the units that reports print."""
    ns = (F.abs(F.col("value")) * F.pow(F.lit(10.0), F.col("event_id") % 9)).cast("bigint")
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", duration(ns).alias("text"))


def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most similar pairs (a report, so the limit is the feature)."""
    return E.most_similar(vectors(spark, sf_dir), 100)


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 rows (the limit is the feature)."""
    return E.sample(vectors(spark, sf_dir), 50).select("id")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_by_id(vectors(spark, sf_dir), 50).select("id")


def dedupe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two copies of the table have in common, once each."""
    rows = vectors(spark, sf_dir)
    return rows.union(rows).groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all documents, tasks going round with the id."""
    docs = table(spark, sf_dir, "documents")
    tasks = F.array(*(F.lit(t) for t in [*P.TASKS, "None"]))
    task = F.element_at(tasks, (F.col("doc_id") % 9 + 1).cast("int"))
    about = F.when(F.col("doc_id") % 5 == 0, F.lit("  custom task "))
    text, error = P.prompt_parts(task, F.col("text"), F.col("source"), about)
    return docs.select("doc_id", text.alias("prompt"), error.alias("error"))


def resolve_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*(F.lit(x) for x in (0, 768, 512, 256, 128, 1024))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", P.dim_column(asked, strict=False).alias("dim"))


def space_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mark_spaces_column(F.col("text")).alias("text"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def forest_full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all leaves searched a forest is exact."""
    rows = vectors(spark, sf_dir)
    folder = shared_folder(spark, "forest")
    built = T.build(rows, folder, T.Options(trees=4, leaf=16, seed=42))
    leaves = built.agg(F.max("leaves")).first()[0]
    return T.search(rows, folder, K, int(leaves), exclude_self=True)


def forest_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    folder = shared_folder(spark, "forest")
    built = T.build(rows, folder, T.Options("euclidean", trees=4, leaf=16, seed=7))
    return T.search(rows, folder, K, int(built.agg(F.max("leaves")).first()[0]), exclude_self=True)


def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many leaves of each shard as a recall of 0.9 needs: approximate."""
    rows = vectors(spark, sf_dir)
    folder = shared_folder(spark, "forest")
    T.build(rows, folder, T.Options(trees=20, leaf=32))
    return T.search(rows, folder, K, exclude_self=True, recall=0.9)


def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the leaves of each tree: every vector once."""
    folder = shared_folder(spark, "forest")
    T.build(vectors(spark, sf_dir), folder, T.Options(trees=3, leaf=16))
    leaves = T.nodes(spark, folder).where("leaf")
    return leaves.select("tree", F.explode("items").alias("id")).groupBy("tree").agg(F.count("*").alias("items"), F.countDistinct("id").alias("ids"))


_META = {
    "general.architecture": (8, "sample"), "general.name": (8, 'a "name" é'), "sample.count": (4, 7), "sample.small": (0, 255), "sample.signed": (1, -5), "sample.short": (2, 65535), "sample.signed_short": (3, -300),
    "sample.signed_int": (5, -70000), "sample.share": (6, 0.25), "sample.yes": (7, True), "sample.large": (10, 1 << 40), "sample.signed_large": (11, -(1 << 40)), "sample.double": (12, 0.1), "sample.sizes": (9, (5, [3, -1, 2])), "sample.words": (9, (8, ["a", "b c"])),
}
_FILE_ROWS = 4096


def _vector_files(spark: SparkSession, sf_dir: str) -> str:
    """Model files of the vectors: one for each label and run of ``_FILE_ROWS`` ids, with ids, vectors and their 8-bit blocks by id."""
    folder = shared_folder(spark, "vector-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for label, part, i, vec in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((label, part), []).append((i, vec))
        for (label, part), rows in held.items():
            ids, m = np.array([i for i, _ in rows], "<i4"), np.array([v for _, v in rows], "<f4")
            tensors = {"ids": (18, (len(ids),), ids.tobytes()), "vectors": (0, m.shape[::-1], m.tobytes()), "blocks": (8, m.shape[::-1], G.quantize_q8(m))}
            write_bytes(f"{folder}/label-{label}-{part}.gguf", G.encode({"general.architecture": (8, "vectors"), "vectors.label": (5, label)}, tensors))
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([len(rows)], pa.int64())], names=["label", "rows"])

    rows = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / _FILE_ROWS).cast("int").alias("part"), "vec_id", "embedding")
    written = rows.repartition("label", "part").sortWithinPartitions("label", "part", "vec_id").mapInArrow(run, "label int, rows bigint")
    written.agg(F.sum("rows")).collect()
    return folder


def gguf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, types and values of a file that has all kinds of values."""
    path = f"{shared_folder(spark, 'model')}/kinds.gguf"
    G.write(path, _META, {"x": (0, (1,), b"\0\0\0\0")})
    return G.scan_metadata(spark, path).select("key", "type", "value")


def gguf_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor directories of the files of all vectors."""
    rows = G.scan_tensors(spark, _vector_files(spark, sf_dir))
    return rows.select(F.regexp_extract("file", r"label-(-?\d+-\d+)\.", 1).alias("file"), "name", "dtype", "shape", "offset", "size")


def _with_ids(spark: SparkSession, folder: str, tensor: str) -> DataFrame:
    values = G.scan_rows(spark, folder, tensor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                ids = G.open_file(file).view("ids", "I32").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["file", "row", "id"])

    ids = spark.read.format("binaryFile").load(folder).select("path").mapInArrow(run, "file string, row bigint, id bigint")
    return values.join(ids, ["file", "row"]).select("id", "values")


def gguf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read back from the files' tensors."""
    return _with_ids(spark, _vector_files(spark, sf_dir), "vectors").withColumnRenamed("values", "vec")


def gguf_q8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every component of the 8-bit blocks is within half a step of the vector's: a step is a 127th of the largest of its block, in half precision."""
    blocks = _with_ids(spark, _vector_files(spark, sf_dir), "blocks")
    rows = blocks.join(vectors(spark, sf_dir), "id")
    most = lambda b: F.array_max(F.transform(F.slice("vec", 32 * b + 1, 32), F.abs))
    off = lambda b: F.array_max(F.zip_with(F.slice("vec", 32 * b + 1, 32), F.slice("values", 32 * b + 1, 32), lambda x, y: F.abs(x - y)))
    return rows.select("id", *((off(b) <= most(b) / 127 * 0.57).alias(f"block_{b}") for b in range(2)))


def index_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the binary files of an int8 index, many files."""
    folder = shared_folder(spark, "index-files")
    B.export_exact_files(I.build(vectors(spark, sf_dir), "int8"), folder, 256)
    return B.scan_exact(spark, folder).select("id", "vec")


def index_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched after it was written to one binary file and loaded."""
    rows, path = vectors(spark, sf_dir), f"{shared_folder(spark, 'index-file')}/one.brut"
    B.export_exact(I.build(rows, "int16"), path)
    return I.search(B.load_exact(spark, path), rows, K)


def index_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the binary file of each mode."""
    rows, sizes = vectors(spark, sf_dir), []
    for mode in SWEEP_MODES:
        sizes.append((mode, B.export_exact(I.build(rows, mode), f"{shared_folder(spark, 'index-file')}/{mode}.brut")))
    return spark.createDataFrame(sizes, "mode string, bytes bigint")


def forest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that the forest's files hold."""
    folder = shared_folder(spark, "forest")
    T.build(vectors(spark, sf_dir), folder, T.Options(trees=1, leaf=64))
    return T.stored(spark, folder).select("id", "vec")


def forest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every hundredth vector finds at least nine tenths of its ten nearest, held against the exact search."""
    rows, folder = vectors(spark, sf_dir), shared_folder(spark, "forest")
    T.build(rows, folder, T.Options(trees=20, leaf=32))
    asked = rows.where(F.col("id") % 100 == 0)
    units = lambda df: df.select("id", V.normalize("vec").alias("vec"))
    truth = I.nearest(units(asked), units(rows), K, "cosine", exclude_self=True)
    found = E.recall(truth, T.search(asked, folder, K, exclude_self=True, recall=0.9))
    return found.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


def callback_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of every stored row: here the sum of the codes, as whole numbers."""
    built = I.build(vectors(spark, sf_dir), "int8")
    return built.map_rows(lambda ids, m: np.rint(m.astype(np.float64) * 127).sum(axis=1).astype(np.int64), "bigint").withColumnRenamed("value", "total")


def tokenizer_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by a vocabulary without merges: characters, and bytes of those that it hasn't."""
    tokens, scores, types = S.vocabulary(merges=False)
    rows = K_.encode(table(spark, sf_dir, "documents"), K_.Tokenizer(tokens, scores, types, nfkc=False), "doc_id")
    total = F.aggregate("token_ids", F.lit(0).cast("bigint"), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("token_ids", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select(F.col("id").alias("doc_id"), F.size("token_ids").alias("n"), total.alias("total"), weighted.alias("weighted"))


def tokenizer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding the merged ids of a text gives it again; characters that became bytes apart."""
    tokens, scores, types = S.vocabulary()
    tokenizer = K_.Tokenizer(tokens, scores, types, nfkc=False)
    plain = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^ -~\n]", "").alias("text"))
    ids = K_.encode(plain, tokenizer, "doc_id")
    back = K_.decode(ids, tokenizer).select(F.col("id").alias("doc_id"), F.col("text").alias("back"))
    return plain.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"), F.length("back").alias("length"))


def _sample_model(spark: SparkSession) -> str:
    path = f"{shared_folder(spark, 'model')}/sample.gguf"
    write_bytes(path, S.model())
    return path


def embed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of every turn, by a small model with weights from a seed."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return N.embed_texts(turns, _sample_model(spark), "SearchQuery", 128, strict=False)


def embed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every vector: its dimension, its length, and no error."""
    rows = embed_conversations(spark, sf_dir)
    return rows.select("id", F.size("vec").alias("dim"), (F.abs(V.magnitude("vec") - 1) < 1e-4).alias("is_unit"), F.col("error"))


def embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to ranked results: every benchmark text finds itself first among the vectors of all."""
    path, texts = _sample_model(spark), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows = N.embed_texts(texts, path, "SemanticSimilarity", 128).select("id", "vec")
    rows = materialize(rows, "embedded")
    found = I.search(I.build(rows, "fp32"), rows, 1)
    return found.select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def best_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each quantisation, how many vectors have the same nearest as without one."""
    rows = vectors(spark, sf_dir)
    nearest = lambda mode: I.search(I.build(rows, mode), rows, 1, exclude_self=True).select("query_id", "id", F.lit(mode).alias("mode"))
    truth = nearest("fp32").select("query_id", F.col("id").alias("best"))
    found = nearest("int16").union(nearest("int8")).join(truth, "query_id")
    return found.groupBy("mode").agg(F.count("*").alias("queries"), F.sum((F.col("id") == F.col("best")).cast("bigint")).alias("same"))


_META_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(key, name, value)
    for key, name, value in [
        ("general.architecture", "string", '"sample"'), ("general.name", "string", '"a \\"name\\" é"'), ("sample.count", "uint32", "7"), ("sample.small", "uint8", "255"), ("sample.signed", "int8", "-5"), ("sample.short", "uint16", "65535"), ("sample.signed_short", "int16", "-300"),
        ("sample.signed_int", "int32", "-70000"), ("sample.share", "float32", "0.25"), ("sample.yes", "bool", "true"), ("sample.large", "uint64", "1099511627776"), ("sample.signed_large", "int64", "-1099511627776"), ("sample.double", "float64", "0.1"), ("sample.sizes", "array", "[3, -1, 2]"), ("sample.words", "array", '["a", "b c"]'),
    ]
) + ") t(key, type, value)"

_TENSORS = f"""
WITH files AS (SELECT label || '-' || (vec_id // {_FILE_ROWS}) AS file, count(*)::BIGINT AS n, max(len(embedding))::BIGINT AS d FROM embeddings GROUP BY ALL),
sized AS (SELECT *, 4 * n AS ids, 4 * n * d AS vectors, n * d // 32 * 34 AS blocks FROM files),
placed AS (SELECT *, (ids + 31) // 32 * 32 AS second, (ids + 31) // 32 * 32 + (vectors + 31) // 32 * 32 AS third FROM sized)
SELECT file, 'ids' AS name, 'I32' AS dtype, [n] AS shape, 0::BIGINT AS "offset", ids AS size FROM placed
UNION ALL SELECT file, 'vectors', 'F32', [d, n], second, vectors FROM placed
UNION ALL SELECT file, 'blocks', 'Q8_0', [d, n], third, blocks FROM placed"""

_CHARACTERS = f"""
WITH marked AS (SELECT doc_id, replace(replace(replace(replace(text, '  ', chr(2) || chr(2)), chr(2) || ' ', chr(2) || chr(2)), ' ', '▁'), chr(2), ' ') AS t FROM documents),
pieces AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?s).'), lambda c: CASE WHEN c = '▁' THEN [4] WHEN c = ' ' THEN [5] WHEN c = chr(10) THEN [{4 + len(S.CHARACTERS) - 1}] WHEN c BETWEEN '!' AND '~' AND strlen(c) = 1 THEN [ascii(c) - 33 + 6]
  ELSE list_transform(regexp_extract_all(hex(encode(c)), '..'), lambda h: 238 + ('0x' || h)::INTEGER) END) AS parts FROM marked),
ids AS (SELECT doc_id, flatten(parts) AS ids FROM pieces)
SELECT doc_id, len(ids)::INTEGER AS n, list_sum(ids)::BIGINT AS total, list_sum(list_transform(ids, lambda x, i: x::BIGINT * i))::BIGINT AS weighted FROM ids"""

_DURATIONS = """
WITH ns AS (SELECT event_id, trunc(abs(value) * pow(10.0::DOUBLE, event_id % 9))::BIGINT AS n FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN n >= 1000000000 THEN printf('%.2fs', n / 1e9::DOUBLE) WHEN n >= 1000000 THEN printf('%.1fms', n / 1e6::DOUBLE) WHEN n >= 1000 THEN printf('%.1fµs', n / 1e3::DOUBLE) ELSE n || 'ns' END AS text FROM ns"""

_RAW = "SELECT vec_id AS id, embedding AS vec, label FROM embeddings"
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _unit(vec: str) -> str:
    """Normalised as in the engine: squares in single precision, their sum in double, the factor in single."""
    squares = f"list_reduce(list_prepend(0::DOUBLE, list_transform({vec}, lambda x: (x::REAL * x::REAL)::DOUBLE)), lambda s, y: s + y)"
    return f"CASE WHEN {squares} > 0 THEN list_transform({vec}, lambda x: (x::REAL * (1 / sqrt({squares}))::REAL)::REAL) ELSE {vec} END"


def _codes(vec: str, mode: str) -> str:
    if mode == "fp32":
        return vec
    return f"list_transform({vec}, lambda x: round(least(1, greatest(-1, x::DOUBLE)) * {V.SCALES[mode]})::INTEGER)"


def _search_sql(mode: str, self_too: bool = False, source: str = _RAW, normalized: bool = False) -> str:
    scale = "" if mode == "fp32" else f" / {V.SCALES[mode]}.0::DOUBLE"
    asked = "vec" if normalized else "unit"
    return f"""
WITH raw AS MATERIALIZED ({source}), units AS MATERIALIZED (SELECT id, vec, {_unit('vec')} AS unit FROM raw),
coded AS MATERIALIZED (SELECT id, {asked}::DOUBLE[] AS asked, {_codes('unit', mode)}::DOUBLE[] AS codes FROM units),
scored AS (SELECT q.id AS query_id, c.id AS id, list_inner_product(q.asked, c.codes){scale} AS score FROM coded q, coded c {'' if self_too else 'WHERE q.id <> c.id'}),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored)
SELECT query_id, id, score, rank FROM placed WHERE rank <= {K}"""


_PAIRS = f"""
WITH raw AS ({_RAW}), pairs AS (
  SELECT x.id AS a, y.id AS b, x.label AS label_a, y.label AS label_b,
    {_DOT.format(a='x.vec', b='y.vec')} / (sqrt({_DOT.format(a='x.vec', b='x.vec')}) * sqrt({_DOT.format(a='y.vec', b='y.vec')})) AS similarity
  FROM raw x JOIN raw y ON x.id < y.id)"""

_EUCLIDEAN = f"""
WITH raw AS ({_RAW}), scored AS (
  SELECT q.id AS query_id, c.id AS id, sqrt(list_reduce(list_transform(list_zip(q.vec, c.vec), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)), lambda s, y: s + y)) AS distance
  FROM raw q JOIN raw c ON q.id <> c.id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM scored)
SELECT query_id, id, distance, rank FROM placed WHERE rank <= {K}"""


def _sweep_sql() -> str:
    def found(name: str, source: str, mode: str) -> str:
        return f"{name} AS ({_search_sql(mode, source=source)})"

    parts, rows = [found("truth", _RAW, "fp32")], []
    for dim in SWEEP_DIMS:
        cut = f"SELECT id, {_unit('head')} AS vec FROM (SELECT vec_id AS id, embedding[1:{dim}] AS head FROM embeddings)"
        for mode in SWEEP_MODES:
            name = f"f_{dim}_{mode}"
            parts.append(found(name, cut, mode))
            size = f"(20 + 4 * n + n * {dim * V.bits(mode) // 8})::BIGINT"
            hits = f"SELECT t.query_id, count(f.id) / {K}::DOUBLE AS recall FROM truth t LEFT JOIN {name} f ON t.query_id = f.query_id AND t.id = f.id GROUP BY t.query_id"
            rows.append(f"SELECT {dim} AS dim, '{mode}' AS mode, (SELECT {size} FROM (SELECT count(*) AS n FROM embeddings)) AS bytes, avg(recall) AS recall FROM ({hits})")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(rows)


_SPACE = r"[\s\x0b\x{85}\x{a0}\p{Z}]"


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_TASKS_SQL = "[" + ", ".join(f"'{t}'" for t in [*P.TASKS, "None"]) + "]"
_TOLD_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN '{d}'" for t, d in P.DESCRIPTIONS.items()) + " END"
_PROMPTS = f"""
WITH asked AS (SELECT doc_id, {_TASKS_SQL}[(doc_id % 9 + 1)::INTEGER] AS task, {_strip_sql('text')} AS body, {_strip_sql('source')} AS title, CASE WHEN doc_id % 5 = 0 THEN 'custom task' END AS about FROM documents),
told AS (SELECT *, coalesce(about, {_TOLD_SQL}) AS told FROM asked)
SELECT doc_id,
  CASE WHEN body = '' THEN NULL WHEN task = 'None' THEN body WHEN task = 'SearchDocument' THEN 'title: ' || CASE WHEN title = '' THEN 'none' ELSE title END || ' | text: ' || body ELSE 'task: ' || told || ' | query: ' || body END AS prompt,
  CASE WHEN body = '' THEN 'content is empty' END AS error
FROM told"""

_LATENCY = """
WITH placed AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most,
  max(CASE WHEN nth = least(floor(n * 0.5), n - 1) THEN v END) AS p50, max(CASE WHEN nth = least(floor(n * 0.95), n - 1) THEN v END) AS p95, max(CASE WHEN nth = least(floor(n * 0.99), n - 1) THEN v END) AS p99
FROM placed GROUP BY event_type"""


def _rounded(query: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """Means are sums in no fixed order, so they are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.round(c, 6) for c in columns})

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        knn_exact_cosine, knn_int8, knn_int16, knn_native, knn_pre_normalized, knn_prefix_dim, knn_exact_euclidean, knn_label_join, vec_normalize, quantize_codes, dequantize_error, full_scan, point_lookup,
        index_metadata, index_round_trip, _rounded(recall_sweep, "recall"), pairwise_most_similar, similarity_by_label, label_centroids, topk_global, sample_rows, first_rows, dedupe_ids, prompt_build, resolve_dims, space_marks,
        _rounded(latency_percentiles, "mean"), forest_full_search, forest_euclidean, forest_search, forest_nodes, best_by_mode,
        gguf_metadata, gguf_tensors, gguf_rows, gguf_q8_error, index_file_scan, index_file_search, index_file_size, forest_vectors, forest_recall, callback_sums,
        argmax_pair, durations, tokenizer_characters, tokenizer_round_trip, embed_conversations, embed_shapes, embed_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    own = _search_sql("fp32")
    full = own.replace("SELECT query_id, id, score, rank FROM placed", "SELECT query_id, id, 1 - greatest(-1, least(1, score)) AS distance, rank FROM placed")
    units = f"WITH raw AS ({_RAW}), units AS (SELECT id, {_unit('vec')} AS vec FROM raw)"
    error = "list_max(list_transform(list_zip(vec, {c}), lambda x: abs(x[1] - (x[2]::DOUBLE / {s})::REAL)))"
    prefix = f"SELECT vec_id AS id, {_unit('head')} AS vec FROM (SELECT vec_id, embedding[1:{PREFIX}] AS head FROM embeddings)"
    scaled = f"SELECT vec_id AS id, list_transform(embedding, lambda x: x * 3::REAL) AS vec FROM embeddings"
    return {
        "knn_exact_cosine": own,
        "knn_int8": _search_sql("int8"),
        "knn_int16": _search_sql("int16"),
        "knn_native": _search_sql("int8"),
        "knn_pre_normalized": _search_sql("fp32", self_too=True, normalized=True),
        "knn_prefix_dim": _search_sql("fp32", source=prefix),
        "knn_exact_euclidean": _EUCLIDEAN,
        "knn_label_join": f"WITH found AS ({own}) SELECT q.label, count(*) AS neighbours, count(*) FILTER (WHERE q.label = c.label) AS agreeing FROM found JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = found.id GROUP BY q.label",
        "vec_normalize": f"WITH raw AS ({scaled}), units AS (SELECT id, {_unit('vec')} AS vec FROM raw) SELECT id, vec, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(vec, lambda x: (x * x)::DOUBLE)), lambda s, y: s + y))::REAL AS size FROM units",
        "quantize_codes": f"{units} SELECT id, {_codes('vec', 'int8')} AS int8_codes, {_codes('vec', 'int16')} AS int16_codes FROM units",
        "dequantize_error": f"{units} SELECT id, {error.format(c=_codes('vec', 'int8'), s=127)} AS int8_error, {error.format(c=_codes('vec', 'int16'), s=32767)} AS int16_error FROM units",
        "full_scan": f"{units} SELECT id, list_transform({_codes('vec', 'int8')}, lambda c: (c::DOUBLE / 127)::REAL) AS vec FROM units",
        "point_lookup": f"{units} SELECT id, list_transform({_codes('vec', 'int16')}, lambda c: (c::DOUBLE / 32767)::REAL) AS vec FROM units WHERE id = 7",
        "index_metadata": "WITH n AS (SELECT count(*) AS n, max(len(embedding))::INTEGER AS d FROM embeddings), m AS (SELECT unnest(['fp32', 'int16', 'int8']) AS mode, unnest([4, 2, 1]) AS width) SELECT d AS dim, mode, n AS count, (20 + 4 * n + n * d * width)::BIGINT AS bytes FROM n, m",
        "index_round_trip": _search_sql("int8", self_too=True),
        "recall_sweep": f"SELECT dim, mode, bytes, round(recall, 6) AS recall FROM ({_sweep_sql()})",
        "pairwise_most_similar": f"{_PAIRS} SELECT a, b, similarity FROM pairs ORDER BY similarity DESC, a, b LIMIT 1",
        "similarity_by_label": f"{_PAIRS} SELECT label_a, label_b, count(*) AS pairs, max(similarity) AS most FROM pairs GROUP BY label_a, label_b",
        "label_centroids": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(x), 6) + 0.0 AS mean, count(*) AS n FROM x GROUP BY label, pos) SELECT label, max(n) AS n, list(mean ORDER BY pos) AS centroid FROM m GROUP BY label",
        "topk_global": f"{_PAIRS} SELECT a, b, similarity FROM pairs ORDER BY similarity DESC, a, b LIMIT 100",
        "sample_rows": "SELECT vec_id AS id FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 50",
        "first_rows": "SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 50",
        "dedupe_ids": "SELECT vec_id AS id, count(*) AS times FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id FROM embeddings) GROUP BY vec_id HAVING count(*) > 1",
        "prompt_build": _PROMPTS,
        "resolve_dims": "SELECT doc_id, ([512, 768, 512, 256, 128, NULL])[(doc_id % 6 + 1)::INTEGER] AS dim FROM documents",
        "space_marks": "SELECT doc_id, replace(replace(replace(replace(text, '  ', chr(2) || chr(2)), chr(2) || ' ', chr(2) || chr(2)), ' ', '▁'), chr(2), ' ') AS text FROM documents",
        "latency_percentiles": _LATENCY,
        "forest_full_search": full,
        "forest_euclidean": _EUCLIDEAN,
        "forest_nodes": "SELECT tree::INTEGER AS tree, count(*) AS items, count(DISTINCT vec_id) AS ids FROM embeddings, range(3) t(tree) GROUP BY tree",
        "forest_vectors": f"{units} SELECT id, vec FROM units",
        "forest_recall": "SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, TRUE AS enough FROM embeddings",
        "gguf_metadata": _META_SQL,
        "gguf_tensors": _TENSORS,
        "gguf_rows": "SELECT vec_id AS id, embedding AS vec FROM embeddings",
        "gguf_q8_error": "SELECT vec_id AS id, TRUE AS block_0, TRUE AS block_1 FROM embeddings",
        "index_file_scan": f"{units} SELECT id, list_transform({_codes('vec', 'int8')}, lambda c: (c::DOUBLE / 127)::REAL) AS vec FROM units",
        "index_file_search": _search_sql("int16", self_too=True),
        "index_file_size": "WITH n AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), m AS (SELECT unnest(['fp32', 'int16', 'int8']) AS mode, unnest([4, 2, 1]) AS width) SELECT mode, (20 + 4 * n + n * d * width)::BIGINT AS bytes FROM n, m",
        "callback_sums": f"{units} SELECT id, list_sum({_codes('vec', 'int8')})::BIGINT AS total FROM units",
        "tokenizer_characters": _CHARACTERS,
        "tokenizer_round_trip": "SELECT doc_id, TRUE AS same, length(regexp_replace(text, '[^ -~\\n]', '', 'g'))::INTEGER AS length FROM documents",
        "embed_shapes": "SELECT conv_id * 1000 + turn AS id, 128 AS dim, TRUE AS is_unit, NULL::VARCHAR AS error FROM conversations",
        "embed_search": "SELECT item_id AS query_id, item_id AS id, 1 AS rank, 1.0::DOUBLE AS score FROM benchmark",
        "best_by_mode": f"WITH a AS ({_search_sql('fp32')}), b AS ({_search_sql('int16')}), c AS ({_search_sql('int8')}), found AS (SELECT 'int16' AS mode, * FROM b UNION ALL SELECT 'int8', * FROM c) SELECT mode, count(*) AS queries, count(*) FILTER (WHERE a.id = found.id) AS same FROM found JOIN a USING (query_id) WHERE a.rank = 1 AND found.rank = 1 GROUP BY mode",
        "argmax_pair": f"{_PAIRS} SELECT a, b, similarity FROM pairs WHERE similarity > 0 ORDER BY similarity DESC, a, b LIMIT 1",
        "durations": _DURATIONS,
    }
