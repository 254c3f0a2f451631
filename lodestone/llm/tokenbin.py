"""Token ids as flat binary files with 64-bit document offsets.

Each task writes the ids of its documents, each followed by the end id, to one file of unsigned integers (16 bits
where the vocabulary allows, else 32). A partition's base is the number of ids in all files before it, from prefix
sums over the files' totals; a document's offset is its base plus its place in its file. Every file has a companion
of int64 global offsets, and a manifest lists the files that count with their bases. Files are named by partition
and task attempt and a row names the file it lies in, so a repeated or lost task leaves nothing but an unlisted file.

The folder is resolved as Spark resolves paths, and tasks write to it through pyarrow. ``Tokens`` maps local files and
reads ranges of others.

Defined cases: a null or empty text is a document of the end id alone; rows are kept as they are, repeated ids
included; other columns aren't read, so they can have any name; an empty table gives a manifest without files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import bounded_batches, column, drop_folder, materialize, place, qualified, spans, text_parts, write_bytes
from lodestone.llm.sentencepiece_codec import codec


def write(docs: DataFrame, folder: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to ``folder``; (doc_id, file, offset, n_tokens), ``offset`` being global."""
    folder = qualified(docs.sparkSession, folder)
    kind = np.dtype(np.uint16 if codec(model).size <= 1 << 16 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        stream, at = None, 0
        for b in batches:
            _, offsets = text_parts(b.column(1))
            for low, high in spans(offsets):
                ids, ends = c.encode(b.column(1).slice(low, high - low))
                out = np.full(len(ids) + high - low, c.end, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(high - low), np.diff(ends))] = ids
                if stream is None:
                    stream = fs.open_output_stream(f"{root}/{name}")
                stream.write(out.tobytes())
                n = np.diff(ends) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array([name] * (high - low)), pa.array(at + np.cumsum(n) - n), pa.array(n)], names=["doc_id", "file", "first", "n_tokens"])
                at += int(n.sum())
        if stream is not None:
            stream.close()

    source = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    rows = materialize(source.mapInArrow(run, "doc_id bigint, file string, first bigint, n_tokens bigint"), "token-index")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # one row a partition of the input, in the order of partitions
    bases = materialize(totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "token-bases")
    listed = [{"file": r.file, "base": r.base, "tokens": r.total} for r in bases.orderBy("base", "file").toLocalIterator()]
    write_bytes(f"{folder}/manifest.json", json.dumps({"dtype": kind.name, "files": listed}).encode())
    indexed = rows.join(bases.select("file", "base"), "file").select("doc_id", "file", (F.col("base") + F.col("first")).alias("offset"), "n_tokens", "base")
    return _write_offsets(indexed, folder)


def _write_offsets(indexed: DataFrame, folder: str) -> DataFrame:
    """One companion file of int64 offsets for each token file; the last is where the file ends."""

    def save(file: str, base: int, offset: np.ndarray, n: np.ndarray) -> None:
        fs, root = place(folder)
        stamp = TaskContext.get().taskAttemptId()
        with fs.open_output_stream(f"{root}/.{file}-{stamp}.idx") as f:
            f.write(np.append(offset, offset[-1] + n[-1]).astype("<i8").tobytes())
        fs.move(f"{root}/.{file}-{stamp}.idx", f"{root}/{file[:-4]}.idx")  # whole or not at all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, base, offset, n = None, 0, [], []
        for b in batches:
            files = b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)] if len(files) else []
            for low, high in zip(edges, edges[1:]):
                if files[low] != name:
                    if name is not None:
                        save(name, base, np.concatenate(offset), np.concatenate(n))
                    name, base, offset, n = files[low], b.column(4)[low].as_py(), [], []
                offset.append(b.column(2).to_numpy()[low:high])
                n.append(b.column(3).to_numpy()[low:high])
            yield b.select(["doc_id", "file", "offset", "n_tokens"])
        if name is not None:
            save(name, base, np.concatenate(offset), np.concatenate(n))

    parts = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = indexed.repartition(parts, "file").sortWithinPartitions("file", "offset")
    return materialize(ordered.mapInArrow(run, "doc_id bigint, file string, offset bigint, n_tokens bigint"), "token-offsets")


class Tokens:
    """The written files as one sequence: local ones memory-mapped, others read by ranges. ``folder`` as ``qualified`` gives it, or a local path."""

    def __init__(self, folder: str):
        self.fs, self.root = place(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            m = json.loads(f.read())
        self.dtype = np.dtype(m["dtype"])
        self.files = m["files"]
        self.bases = np.array([x["base"] for x in self.files], np.int64)
        self.maps: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.files[-1]["base"] + self.files[-1]["tokens"] if self.files else 0

    def _part(self, k: int, first: int, n: int) -> np.ndarray:
        """Up to ``n`` ids of file ``k`` from its ``first`` on."""
        path = f"{self.root}/{self.files[k]['file']}"
        if isinstance(self.fs, pafs.LocalFileSystem):
            if k not in self.maps:
                self.maps[k] = np.memmap(path, self.dtype, "r")
            return self.maps[k][first : first + n]
        size = self.dtype.itemsize
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read_at(n * size, first * size), self.dtype)

    def read(self, offset: int, n: int) -> np.ndarray:
        """``n`` ids from a global offset on, across files if need be."""
        out = []
        while n > 0:
            k = int(np.searchsorted(self.bases, offset, side="right")) - 1
            got = self._part(k, int(offset - self.bases[k]), n)
            if not len(got):
                raise IndexError(offset)
            out.append(got)
            offset, n = offset + len(got), n - len(got)
        return np.concatenate(out) if len(out) != 1 else out[0]

    def offsets(self, k: int) -> np.ndarray:
        """Global offsets of the documents of file ``k``, and where it ends."""
        path = f"{self.root}/{self.files[k]['file'][:-4]}.idx"
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.memmap(path, "<i8", "r")
        with self.fs.open_input_stream(path) as f:
            return np.frombuffer(f.read(), "<i8")


def read_back(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` of ``write`` with ``checksum``: the sum of id times place (from 1), modulo 2^61, from the mapped files."""
    folder = qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(folder)
        for b in batches:
            sums = []
            for offset, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ids = tokens.read(offset, n).astype(np.int64)
                # a sum that wraps is right modulo 2^64, of which 2^61 is a divisor
                sums.append(int((ids * np.arange(1, n + 1)).sum()) % (1 << 61))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=["doc_id", "file", "offset", "n_tokens", "checksum"])

    return rows.select("doc_id", "file", "offset", "n_tokens").mapInArrow(run, "doc_id bigint, file string, offset bigint, n_tokens bigint, checksum bigint").drop("file")


def remove(spark: SparkSession, folder: str) -> None:
    drop_folder(spark, folder)
