"""GGUF model files: metadata, tensor directory and tensor data, as Python objects and as DataFrames."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.shared import place, write_bytes

VERSION = 3
ALIGN = 32
#: Name, bytes of a block and values in it (0: of variable size) of each tensor type.
TYPES = {
    0: ("F32", 4, 1), 1: ("F16", 2, 1), 2: ("Q4_0", 18, 16), 3: ("Q4_1", 20, 16), 6: ("Q5_0", 22, 16), 7: ("Q5_1", 24, 16), 8: ("Q8_0", 34, 32), 9: ("Q8_1", 36, 32),
    10: ("Q2_K", 0, 0), 11: ("Q3_K", 0, 0), 12: ("Q4_K", 0, 0), 13: ("Q5_K", 0, 0), 14: ("Q6_K", 0, 0), 15: ("Q8_K", 0, 0), 16: ("I8", 1, 1), 17: ("I16", 2, 1), 18: ("I32", 4, 1), 19: ("I64", 8, 1), 20: ("F64", 8, 1),
    21: ("IQ2_XXS", 0, 0), 22: ("IQ2_XS", 0, 0), 23: ("IQ3_XXS", 0, 0), 24: ("IQ1_S", 0, 0), 25: ("IQ4_NL", 0, 0), 26: ("IQ3_S", 0, 0), 27: ("IQ2_S", 0, 0), 28: ("IQ4_XS", 0, 0),
}
_VALUES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
_VALUE_NAMES = {0: "uint8", 1: "int8", 2: "uint16", 3: "int16", 4: "uint32", 5: "int32", 6: "float32", 7: "bool", 8: "string", 9: "array", 10: "uint64", 11: "int64", 12: "float64"}
Q8_BLOCK = np.dtype([("scale", "<f2"), ("codes", "i1", 32)])


class GGUFError(ValueError):
    """A file that can't be read."""


@dataclass(frozen=True)
class Tensor:
    name: str
    kind: int
    shape: tuple[int, ...]
    offset: int
    size: int

    @property
    def dtype(self) -> str:
        return TYPES[self.kind][0] if self.kind in TYPES else f"Unknown({self.kind})"

    @property
    def elements(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))


class Ranges:
    """A file that isn't local, read by ranges; what lies around a small one is kept for the next."""

    AHEAD = 1 << 20

    def __init__(self, uri: str):
        system, path = place(uri)
        self.file = system.open_input_file(path)
        self.size, self.first, self.kept = self.file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def read(self, at: int, n: int) -> bytes:
        if n > self.AHEAD:
            return self.file.read_at(n, at)
        if at < self.first or at + n > self.first + len(self.kept):
            self.first, self.kept = at, self.file.read_at(min(self.AHEAD, max(0, self.size - at)), at)
        return self.kept[at - self.first : at - self.first + n]


class Model:
    """A file's bytes, read as far as its tensor data; tensors are views, so a mapped file isn't copied."""

    def __init__(self, raw: bytes | np.memmap | Ranges):
        self.raw = raw
        self.metadata: dict[str, object] = {}
        self.types: dict[str, str] = {}
        self.tensors: dict[str, Tensor] = {}
        self._at = 0
        try:
            self._parse()
        except (struct.error, UnicodeDecodeError, OverflowError, MemoryError) as e:
            raise GGUFError(f"broken file: {e}") from None

    def _slice(self, at: int, n: int) -> bytes:
        return self.raw.read(at, n) if isinstance(self.raw, Ranges) else bytes(self.raw[at : at + n])

    def _take(self, form: str):
        size = struct.calcsize("<" + form)
        out = struct.unpack("<" + form, self._slice(self._at, size))
        self._at += size
        return out[0]

    def _string(self) -> str:
        n = self._take("Q")
        if self._at + n > len(self.raw):
            raise GGUFError("string beyond the end")
        out = self._slice(self._at, n).decode("utf-8", "replace")
        self._at += n
        return out

    def _value(self, kind: int):
        if kind in _VALUES:
            return self._take(_VALUES[kind])
        if kind == 8:
            return self._string()
        if kind == 9:
            inner, n = self._take("I"), self._take("Q")
            if n > len(self.raw):
                raise GGUFError("array beyond the end")
            if inner in _VALUES and inner != 7:
                dtype = np.dtype("<" + _VALUES[inner].replace("I", "u4").replace("i", "i4").replace("Q", "u8").replace("q", "i8").replace("H", "u2").replace("h", "i2").replace("f", "f4").replace("d", "f8").replace("B", "u1").replace("b", "i1"))
                if self._at + n * dtype.itemsize > len(self.raw):
                    raise GGUFError("array beyond the end")
                out = np.frombuffer(self._slice(self._at, n * dtype.itemsize), dtype).tolist()
                self._at += n * dtype.itemsize
                return out
            return [self._value(inner) for _ in range(n)]
        raise GGUFError(f"unknown value type {kind}")

    def _parse(self) -> None:
        if len(self.raw) < 24:
            raise GGUFError("too short for a header")
        if self._slice(0, 4) != b"GGUF":
            raise GGUFError("no GGUF file")
        self._at = 4
        if (version := self._take("I")) != VERSION:
            raise GGUFError(f"version {version}")
        tensors, entries = self._take("Q"), self._take("Q")
        for _ in range(entries):
            key, kind = self._string(), self._take("I")
            self.metadata[key] = self._value(kind)
            self.types[key] = _VALUE_NAMES[kind]
        for _ in range(tensors):
            name, dims = self._string(), self._take("I")
            shape = tuple(self._take("Q") for _ in range(dims))
            kind, offset = self._take("I"), self._take("Q")
            _, block, per = TYPES.get(kind, ("", 0, 0))
            n = int(np.prod(shape, dtype=np.float64))
            size = -(-n // per) * block if per else 0
            self.tensors[name] = Tensor(name, kind, shape, offset, size)
        self.start = -(-self._at // ALIGN) * ALIGN

    def data(self, name: str, first: int = 0, n: int | None = None) -> np.ndarray:
        """Bytes of a tensor, or ``n`` of them from the ``first`` on."""
        t = self.tensors.get(name)
        if t is None:
            raise GGUFError(f"no tensor {name}")
        if self.start + t.offset + t.size > len(self.raw):
            raise GGUFError(f"tensor {name} beyond the end")
        at, n = self.start + t.offset + first, t.size - first if n is None else min(n, t.size - first)
        return np.frombuffer(self.raw.read(at, n), np.uint8) if isinstance(self.raw, Ranges) else np.frombuffer(self.raw, np.uint8, n, at)

    def view(self, name: str, dtype: str) -> np.ndarray:
        """A tensor of type F32, I8 or I32 as an array; another type than it has is an error."""
        t = self.tensors.get(name)
        raw = self.data(name)
        if dtype not in ("F32", "I8", "I32") or t.dtype != dtype:
            raise GGUFError(f"tensor {name} is {t.dtype}, not {dtype}")
        return raw.view({"F32": "<f4", "I8": "i1", "I32": "<i4"}[dtype]).reshape(t.shape[::-1])

    def rows(self, name: str, first: int, n: int) -> np.ndarray:
        """``n`` rows from the ``first`` on of a tensor of type F32 or Q8_0 in single precision; only their bytes are read."""
        width, line = _line(self.tensors[name])
        raw = self.data(name, first * line, n * line)
        values = raw.view("<f4") if self.tensors[name].dtype == "F32" else dequantize_q8(raw, len(raw) // Q8_BLOCK.itemsize * 32)
        return values.reshape(-1, width)

    def take(self, name: str, at: np.ndarray) -> np.ndarray:
        """The rows ``at`` of a tensor, as ``rows``."""
        width, line = _line(self.tensors[name])
        raw = self.data(name)
        own = raw[: len(raw) // line * line].reshape(-1, line)[at]
        return own.view("<f4") if self.tensors[name].dtype == "F32" else dequantize_q8(np.ascontiguousarray(own).reshape(-1), len(at) * width).reshape(-1, width)

    def floats(self, name: str) -> np.ndarray:
        """A tensor of type F32 or Q8_0 in single precision, its last dimension first as in memory."""
        t = self.tensors.get(name)
        if t is not None and t.dtype == "Q8_0":
            return dequantize_q8(self.data(name), t.elements).reshape(t.shape[::-1])
        return self.view(name, "F32")


def q8_blocks(raw: bytes | np.ndarray) -> np.ndarray:
    """Blocks of 32 codes with their half-precision scale."""
    return np.frombuffer(raw, Q8_BLOCK)


def dequantize_q8(raw: bytes | np.ndarray, n: int) -> np.ndarray:
    blocks = q8_blocks(raw)
    return (blocks["codes"] * blocks["scale"].astype(np.float32)[:, None]).reshape(-1)[:n]


def quantize_q8(values: np.ndarray) -> bytes:
    """Blocks of 32 values; for making files."""
    flat = np.asarray(values, np.float32).reshape(-1)
    flat = np.pad(flat, (0, -len(flat) % 32)).reshape(-1, 32)
    scale = (np.abs(flat).max(axis=1) / 127).astype(np.float16)
    safe = np.where(scale > 0, scale.astype(np.float32), 1)[:, None]
    out = np.zeros(len(flat), Q8_BLOCK)
    out["scale"] = scale
    out["codes"] = np.clip(np.trunc(flat / safe + np.copysign(0.5, flat)), -127, 127)
    return out.tobytes()


def _line(t: Tensor) -> tuple[int, int]:
    """Values and bytes of a row of a tensor that ``Model.rows`` can cut."""
    width = t.shape[0] if t.shape else 1
    if t.dtype == "F32":
        return width, 4 * width
    if t.dtype == "Q8_0" and width % 32 == 0:
        return width, width // 32 * Q8_BLOCK.itemsize
    raise GGUFError(f"tensor {t.name} of type {t.dtype} and shape {t.shape} has no rows of its own")


def open_bytes(raw: bytes) -> Model:
    return Model(raw)


def open_file(path: str) -> Model:
    """A local file is mapped, so executors on one machine share the pages; another is read by ranges."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return Model(Ranges(path))
    with open(path, "rb") as f:
        if not f.read(1):
            raise GGUFError("empty file")
    return Model(np.memmap(path, np.uint8, "r"))


def write(path: str, metadata: dict[str, tuple[int, object]], tensors: dict[str, tuple[int, tuple[int, ...], bytes]]) -> None:
    """Write ``encode`` to a local path or a qualified one."""
    raw = encode(metadata, tensors)
    if "://" in path:
        write_bytes(path, raw)
        return
    with open(path, "wb") as f:
        f.write(raw)


def encode(metadata: dict[str, tuple[int, object]], tensors: dict[str, tuple[int, tuple[int, ...], bytes]]) -> bytes:
    """The bytes of a file of metadata (type, value) and tensors (type, shape, bytes); an array's value is (type of its values, list)."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack("<Q", len(raw)) + raw

    def value(kind: int, v) -> bytes:
        if kind == 8:
            return text(v)
        if kind == 9:
            return struct.pack("<IQ", v[0], len(v[1])) + b"".join(value(v[0], x) for x in v[1])
        return struct.pack("<" + _VALUES[kind], v)

    out = b"GGUF" + struct.pack("<IQQ", VERSION, len(tensors), len(metadata))
    for key, (kind, v) in metadata.items():
        out += text(key) + struct.pack("<I", kind) + value(kind, v)
    body, at = [], 0
    for name, (kind, shape, raw) in tensors.items():
        body.append(b"\0" * (-at % ALIGN))
        at += len(body[-1])
        out += text(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, kind, at)
        body.append(raw)
        at += len(raw)
    return out + b"\0" * (-len(out) % ALIGN) + b"".join(body)


def _each_file(spark: SparkSession, path: str, rows, schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    """A task opens each file by itself and reads what it needs, so files can be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                got = [(name, *r) for r in rows(open_file(name))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files of a path; what they hold isn't read."""
    return spark.read.format("binaryFile").load(path).select("path")


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, type, value) of all files of a path; values as JSON."""

    def rows(m: Model):
        return [(k, m.types[k], json.dumps(v, ensure_ascii=False)) for k, v in sorted(m.metadata.items())]

    return _each_file(spark, path, rows, "file string, key string, type string, value string", [pa.string()] * 4, ["file", "key", "type", "value"])


def scan_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, dtype, shape, offset, size) of all files of a path."""

    def rows(m: Model):
        return [(t.name, t.dtype, list(t.shape), t.offset, t.size) for t in sorted(m.tensors.values(), key=lambda t: t.name)]

    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    return _each_file(spark, path, rows, "file string, name string, dtype string, shape array<bigint>, offset bigint, size bigint", kinds, ["file", "name", "dtype", "shape", "offset", "size"])


PIECE = 64 << 20


def scan_data(spark: SparkSession, path: str, tensor: str) -> DataFrame:
    """(file, name, at, data) of one tensor of all files of a path that have it, in pieces of ``PIECE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                m = open_file(file)
                t = m.tensors.get(tensor)
                for at in range(0, max(1, t.size), PIECE) if t is not None else ():
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([tensor]), pa.array([at], pa.int64()), pa.array([m.data(tensor, at, PIECE).tobytes()], pa.binary())], names=["file", "name", "at", "data"])

    return _files(spark, path).mapInArrow(run, "file string, name string, at bigint, data binary")


def scan_rows(spark: SparkSession, path: str, tensor: str) -> DataFrame:
    """(file, row, values) of one tensor (F32 or Q8_0) of all files of a path that have it, in single precision, some thousand rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                m = open_file(file)
                t = m.tensors.get(tensor)
                n = t.elements // _line(t)[0] if t is not None and t.elements else 0
                for low in range(0, n, 4096):
                    part = m.rows(tensor, low, min(4096, n - low))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(low, low + len(part))), lists], names=["file", "row", "values"])

    return _files(spark, path).mapInArrow(run, "file string, row bigint, values array<float>")
