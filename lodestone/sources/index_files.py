"""Binary files of exact indexes and forests (little-endian), and readers of both as DataFrames.

Exact index: ``BRUT``, u16 version, u16 dimension, u32 count, u8 mode (0 fp32, 1 int8, 2 int16), 7 bytes of zeros,
int32 ids, codes row by row. Forest: ``ANNG``, six u16 (version, metric, dimension, trees, leaf, zero), u32 count,
int32 ids, float32 vectors, trees in preorder (1 = leaf: u32 number, u32 positions; 0 = inner: plane, threshold,
left, right).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators.blocks import matrix, pack
from lodestone.operators.forest import Forest, Options, Tree
from lodestone.operators.shared import materialize, place, qualified, write_bytes

_MODES = ["fp32", "int8", "int16"]
_TYPES = {"fp32": "<f4", "int8": "i1", "int16": "<i2"}
_METRICS = ["cosine", "euclidean"]


class FormatError(ValueError):
    """A file that isn't what it should be."""


def _ids(ids: np.ndarray) -> bytes:
    if len(ids) and (ids.min() < -(1 << 31) or ids.max() >= 1 << 31):
        raise FormatError("ids don't fit in 32 bits")
    return ids.astype("<i4").tobytes()


def write_exact(ids: np.ndarray, codes: np.ndarray, mode: str) -> bytes:
    return _header(codes.shape[1], len(ids), mode) + _ids(ids) + codes.astype(_TYPES[mode]).tobytes()


def read_exact(raw: bytes) -> tuple[np.ndarray, np.ndarray, str]:
    """(ids, codes, mode)."""
    if len(raw) < 20 or raw[:4] != b"BRUT":
        raise FormatError("no exact index")
    _, version, dim, n, mode = struct.unpack_from("<4sHHIB", raw)
    if version != 1 or mode >= len(_MODES):
        raise FormatError(f"version {version}, mode {mode}")
    kind = np.dtype(_TYPES[_MODES[mode]])
    if len(raw) < 20 + 4 * n + n * dim * kind.itemsize:
        raise FormatError("file too short")
    return np.frombuffer(raw, "<i4", n, 20).astype(np.int64), np.frombuffer(raw, kind, n * dim, 20 + 4 * n).reshape(n, dim), _MODES[mode]


def _header(dim: int, n: int, mode: str) -> bytes:
    if dim >= 1 << 16:
        raise FormatError("dimension doesn't fit in 16 bits")
    return struct.pack("<4sHHIB7x", b"BRUT", 1, dim, n, _MODES.index(mode))


def export_exact(index: I.Index, path: str) -> int:
    """Write one file, by id; its size. Rows are sorted and packed once by the executors and come to the driver a block at a time."""
    spark, kind = index.table.sparkSession, np.dtype(_TYPES[index.mode])
    n = index.count()
    ordered = index.table.select("id", F.col("codes").alias("vec")).orderBy("id")
    place_of = F.split("block", "-")
    blocks = materialize(pack(ordered, 8192, kind.name).select(place_of[0].cast("int").alias("part"), place_of[1].cast("int").alias("nth"), "ids", "matrix"), "index-blocks").orderBy("part", "nth")
    system, name = place(qualified(spark, path))
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(_header(index.dim, n, index.mode))
        for r in blocks.select("ids").toLocalIterator():
            f.write(_ids(np.frombuffer(r.ids, np.int64)))
        for r in blocks.select("matrix").toLocalIterator():
            f.write(bytes(r.matrix))
        return f.tell()


def export_exact_files(index: I.Index, folder: str, rows: int = 1 << 20) -> DataFrame:
    """Write files of about ``rows`` vectors each, by ranges of ids; (file, first_id, rows, bytes). Files of lost attempts aren't listed."""
    spark = index.table.sparkSession
    folder, dim, mode = qualified(spark, folder), index.dim, index.mode
    kind = _TYPES[mode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, codes = [], []
        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                codes.append(matrix(b.column(1)).astype(kind))
        if ids:
            own = np.concatenate(ids)
            raw = _header(dim, len(own), mode) + _ids(own) + b"".join(c.tobytes() for c in codes)
            name = f"index-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.brut"
            write_bytes(f"{folder}/{name}", raw)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array(own[:1]), pa.array([len(own)]), pa.array([len(raw)])], names=["file", "first_id", "rows", "bytes"])

    parts = max(1, -(-index.count() // rows))
    ordered = index.table.select("id", "codes").repartitionByRange(parts, "id").sortWithinPartitions("id")
    return materialize(ordered.mapInArrow(run, "file string, first_id bigint, rows bigint, bytes bigint"), "index-files")


def _open_exact(uri: str) -> tuple[pafs.FileSystem, str, int, int, str]:
    """(file system, path, dimension, number, mode) of a file, from its header and size."""
    system, path = place("file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)
    with system.open_input_file(path) as f:
        head, size = f.read_at(20, 0), f.size()
    if len(head) < 20 or head[:4] != b"BRUT":
        raise FormatError("no exact index")
    _, version, dim, n, mode = struct.unpack_from("<4sHHIB", head)
    if version != 1 or mode >= len(_MODES):
        raise FormatError(f"version {version}, mode {mode}")
    if size < 20 + 4 * n + n * dim * np.dtype(_TYPES[_MODES[mode]]).itemsize:
        raise FormatError("file too short")
    return system, path, dim, n, _MODES[mode]


def _scan(files: DataFrame, codes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                system, path, dim, n, mode = _open_exact(name)
                kind = np.dtype(_TYPES[mode])
                with system.open_input_file(path) as f:
                    for low in range(0, n, 4096):
                        rows = min(4096, n - low)
                        ids = np.frombuffer(f.read_at(4 * rows, 20 + 4 * low), "<i4").astype(np.int64)
                        own = np.frombuffer(f.read_at(rows * dim * kind.itemsize, 20 + 4 * n + low * dim * kind.itemsize), kind)
                        vec = own.astype(np.float32) if codes else (own / {"fp32": 1, "int8": 127, "int16": 32767}[mode]).astype(np.float32)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(vec))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * rows), pa.array(ids), lists], names=["file", "id", "vec"])

    return files.mapInArrow(run, "file string, id bigint, vec array<float>")


def scan_exact(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, vec) of all exact-index files of a path, dequantised; read by ranges, so files can be of any size."""
    return _scan(spark.read.format("binaryFile").load(path).select("path"), False)


def load_exact(spark: SparkSession, path: str) -> I.Index:
    """One file as an index; a file without vectors gives one that finds nothing."""
    uri = qualified(spark, path)
    _, _, dim, _, mode = _open_exact(uri)
    kind = {"fp32": "float", "int8": "tinyint", "int16": "smallint"}[mode]
    table = _scan(spark.createDataFrame([(uri,)], "path string"), True)
    return I.Index(table.select("id", F.col("vec").cast(f"array<{kind}>").alias("codes")), dim, mode)


def write_forest(forest: Forest) -> bytes:
    o = forest.options
    n, dim = forest.vectors.shape
    out = [struct.pack("<4s6HI", b"ANNG", 1, _METRICS.index(o.metric), dim, len(forest.trees), min(o.leaf, 65535), 0, n), _ids(forest.ids), forest.vectors.astype("<f4").tobytes()]
    for tree in forest.trees:
        todo = [0]
        while todo:
            k = todo.pop()
            if tree.left[k] < 0:
                out += [struct.pack("<BI", 1, len(tree.items[k])), tree.items[k].astype("<u4").tobytes()]
            else:
                out += [b"\0", tree.normal[k].astype("<f4").tobytes(), struct.pack("<f", tree.threshold[k])]
                todo += [tree.right[k], tree.left[k]]
    return b"".join(out)


def forest_head(f) -> Forest:
    """Ids and vectors of an open file, without the trees behind them."""
    raw = f.read(20)
    if len(raw) < 20 or raw[:4] != b"ANNG":
        raise FormatError("no forest")
    _, version, metric, dim, trees, leaf, _, n = struct.unpack("<4s6HI", raw)
    if version != 1 or metric >= len(_METRICS):
        raise FormatError(f"version {version}, metric {metric}")
    ids, vectors = f.read(4 * n), f.read(4 * n * dim)
    if len(vectors) < 4 * n * dim:
        raise FormatError("broken forest: file too short")
    return Forest(Options(_METRICS[metric], trees, leaf), np.frombuffer(ids, "<i4").astype(np.int64), np.frombuffer(vectors, "<f4").reshape(n, dim), [])


def read_forest(raw: bytes) -> Forest:
    if len(raw) < 20 or raw[:4] != b"ANNG":
        raise FormatError("no forest")
    _, version, metric, dim, trees, leaf, _, n = struct.unpack_from("<4s6HI", raw)
    if version != 1 or metric >= len(_METRICS):
        raise FormatError(f"version {version}, metric {metric}")
    try:
        ids = np.frombuffer(raw, "<i4", n, 20).astype(np.int64)
        vectors = np.frombuffer(raw, "<f4", n * dim, 20 + 4 * n).reshape(n, dim)
        at, grown = 20 + 4 * n + 4 * n * dim, []
        for _ in range(trees):
            tree = Tree()
            todo: list[tuple[int, bool]] = [(-1, False)]
            while todo:
                parent, is_left = todo.pop()
                if raw[at] == 1:
                    many = struct.unpack_from("<I", raw, at + 1)[0]
                    node = tree.add(items=np.frombuffer(raw, "<u4", many, at + 5).astype(np.int32))
                    at += 5 + 4 * many
                else:
                    node = tree.add(np.frombuffer(raw, "<f4", dim, at + 1), struct.unpack_from("<f", raw, at + 1 + 4 * dim)[0])
                    at += 5 + 4 * dim
                    todo += [(node, False), (node, True)]
                if parent >= 0:
                    (tree.left if is_left else tree.right)[parent] = node
            grown.append(tree)
    except (struct.error, IndexError, ValueError) as e:
        raise FormatError(f"broken forest: {e}") from None
    return Forest(Options(_METRICS[metric], trees, leaf), ids, vectors, grown)
