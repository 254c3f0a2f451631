"""Transformer encoder of quantised weights in numpy, and text-to-vector as a DataFrame operation.

A model file is opened once in each Python worker and mapped, so the workers of a machine share its 8-bit weights. A
batch of texts goes through a layer together, whose weights are expanded to single precision for it and given up again:
a worker holds one matrix, whatever the model's size. Activations are rounded to 8 bits with one scale a text's tensor
before every product, as the quantised arithmetic prescribes, so a text's vector doesn't depend on its batch. Texts of
equal length share the products of attention. The exponential is exact.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import prompts as P
from lodestone.operators.tokenizer import Tokenizer
from lodestone.sources.gguf import GGUFError, Model, open_file


@dataclass(frozen=True)
class Config:
    dim: int
    layers: int
    heads: int
    kv_heads: int
    inner: int
    longest: int = 2048
    eps: float = 1e-6
    base: float = 10000.0
    vocab: int = 0

    @property
    def head_dim(self) -> int:
        return self.dim // self.heads


def read_config(model: Model) -> Config:
    meta = model.metadata
    prefix = f"{meta['general.architecture']}." if meta.get("general.architecture") else ""
    missing = [k for k in ("embedding_length", "block_count", "attention.head_count") if prefix + k not in meta]
    if missing:
        raise GGUFError(f"metadata has no {prefix}{missing[0]}")
    dim, heads = int(meta[prefix + "embedding_length"]), int(meta[prefix + "attention.head_count"])
    up = model.tensors.get("blk.0.ffn_up.weight")
    inner = meta.get(prefix + "feed_forward_length", up.shape[1] if up else dim * 3)
    tokens = meta.get("tokenizer.ggml.tokens")
    return Config(
        dim, int(meta[prefix + "block_count"]), heads, int(meta.get(prefix + "attention.head_count_kv", heads)), int(inner),
        int(meta.get(prefix + "context_length", 2048)), float(meta.get(prefix + "attention.layer_norm_rms_epsilon", 1e-6)), float(meta.get(prefix + "rope.freq_base", 10000.0)),
        len(tokens) if isinstance(tokens, list) else len(model.tensors),
    )


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x**2).mean(axis=-1, keepdims=True) + np.float32(eps)) * weight


def rms_norm_shifted(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    """Scaled by ``1 + weight`` first, then normalised."""
    y = x * (1 + weight)
    return y / np.sqrt((y**2).mean(axis=-1, keepdims=True) + np.float32(eps))


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + np.float32(eps)) * gamma + beta


def quantize_tensor(x: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """Codes and the one scale of a tensor; halves away from zero. A zero tensor has scale 1."""
    most = np.abs(x).max(initial=0)
    if most == 0:
        return np.zeros(x.shape, np.int8), np.float32(1)
    scale = np.float32(most) / np.float32(127)
    y = x * (np.float32(1) / scale)
    return np.clip(np.trunc(y + np.copysign(np.float32(0.5), y)), -127, 127).astype(np.int8), scale


def dequantize_tensor(codes: np.ndarray, scale: np.float32) -> np.ndarray:
    return codes.astype(np.float32) * scale


def product(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``x @ weight.T`` with ``x`` rounded to 8 bits."""
    codes, scale = quantize_tensor(x)
    return (codes.astype(np.float32) @ weight.T) * scale


def quantize_texts(x: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``quantize_tensor`` of several texts at once, codes in single precision: rows from ``begin`` on have one scale, ``owner`` is the text of each row; also the scale of each row."""
    most = np.maximum.reduceat(np.maximum(x.max(axis=1), -x.min(axis=1)), begin)
    scale = np.where(most > 0, most / np.float32(127), np.float32(1)).astype(np.float32)
    y = x * (np.float32(1) / scale)[owner][:, None]
    y += np.copysign(np.float32(0.5), y)
    return np.trunc(y, out=y), scale[owner][:, None]  # none is beyond 127, as the largest is 127 but for its last bits


def product_codes(codes: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = codes @ weight.T
    out *= scale
    return out


def product_rows(x: np.ndarray, weight: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``product`` of several texts at once."""
    return product_codes(*quantize_texts(x, begin, owner), weight)


def product_q8(codes: np.ndarray, scale: np.float32, blocks: np.ndarray) -> np.ndarray:
    """``codes @ weight.T`` for a weight of rows of 8-bit blocks: sums of a block in 32-bit integers, then scaled and added."""
    a = codes.reshape(len(codes), 1, -1, 32).astype(np.int32)
    sums = (a * blocks["codes"].astype(np.int32)[None]).sum(axis=-1, dtype=np.int32)
    return (sums.astype(np.float32) * blocks["scale"].astype(np.float32)[None]).sum(axis=-1, dtype=np.float32) * scale


def product_int8(a: np.ndarray, a_scale: np.float32, b: np.ndarray, b_scale: np.float32) -> np.ndarray:
    """``a @ b.T`` of codes, summed in 32-bit integers."""
    return (a.astype(np.int32) @ b.astype(np.int32).T).astype(np.float32) * (a_scale * b_scale)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def gelu_quick(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-1.702 * x))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def rope(x: np.ndarray, positions: np.ndarray, base: float) -> np.ndarray:
    """Rotate the pairs (i, i + half) of each head; ``x`` is (tokens, heads, head_dim)."""
    half = x.shape[-1] // 2
    freq = (1.0 / base ** (2 * np.arange(half) / x.shape[-1])).astype(np.float32)
    angle = positions.astype(np.float32)[:, None, None] * freq
    cos, sin = np.cos(angle), np.sin(angle)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * cos - b * sin, a * sin + b * cos], axis=-1).astype(np.float32)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, scale: float, mask: np.ndarray | None = None) -> np.ndarray:
    """(tokens, heads, head_dim) each; fewer heads of keys and values serve groups of queries."""
    group = q.shape[1] // k.shape[1]
    k, v = np.repeat(k, group, axis=1), np.repeat(v, group, axis=1)
    logits = np.einsum("shd,thd->hst", q, k) * np.float32(scale)
    if mask is not None:
        logits = logits + mask
    return np.einsum("hst,thd->shd", softmax(logits), v)


#: Logits that ``attention_many`` holds at once: they stay in a core's cache through all steps of the softmax.
LOGITS = 1 << 17
#: Logits up to this size have exponentials and sums within single precision without taking off their largest.
SAFE_LOGIT = 40


def attention_many(q: np.ndarray, k: np.ndarray, v: np.ndarray, scale: float) -> np.ndarray:
    """``attention`` of texts of equal length, (texts, tokens, heads, head_dim) each, by matrix products of about ``LOGITS`` logits; sums divide what is mixed, which is less than the logits."""
    texts, tokens, heads, size = q.shape
    group = heads // k.shape[2]
    q = (q * np.float32(scale)).transpose(0, 2, 1, 3)
    k, v = k.transpose(0, 2, 3, 1), v.transpose(0, 2, 1, 3)
    out = np.empty((texts, tokens, heads, size), np.float32)
    longest = lambda t, axis: float(np.sqrt((t * t).sum(axis=axis).max(initial=0)))
    safe = longest(q, -1) * longest(k, -2) < SAFE_LOGIT
    many, rows = max(1, LOGITS // (tokens * tokens)), max(1, min(tokens, LOGITS // tokens))
    for head in range(heads):
        for low in range(0, texts, many):
            for row in range(0, tokens, rows):
                logits = q[low : low + many, head, row : row + rows] @ k[low : low + many, head // group]
                if not safe:
                    logits -= logits.max(axis=-1, keepdims=True)
                np.exp(logits, out=logits)
                mixed = logits @ v[low : low + many, head // group]
                mixed /= logits.sum(axis=-1, keepdims=True)
                out[low : low + many, row : row + rows, head] = mixed
    return out


def pool(x: np.ndarray, how: str = "mean", dim: int | None = None) -> np.ndarray:
    """One vector of the first ``dim`` components of all tokens."""
    x = x[:, : dim or x.shape[1]]
    return {"cls": lambda: x[0], "mean": lambda: x.mean(axis=0), "max": lambda: x.max(axis=0)}[how]()


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v**2).sum(dtype=np.float32))
    return v / norm if norm > 0 else v


class Encoder:
    """Tokenizer and mapped weights of one model file. ``keep`` holds expanded weights, for many calls with few texts."""

    _MATRICES = ("attn_q", "attn_k", "attn_v", "attn_output", "ffn_gate", "ffn_up", "ffn_down")
    _NORMS = ("attn_q_norm", "attn_k_norm", "post_attention_norm", "post_ffw_norm")

    def __init__(self, model: Model, keep: bool = False):
        self.config, self.model = read_config(model), model
        name = next((n for n in ("token_embd.weight", "model.embed_tokens.weight") if n in model.tensors), None)
        if name is None:
            raise GGUFError("no token embeddings")
        self.embed_name, self.kept = self._quantised(name), {} if keep else None
        self.norms = []
        for i in range(self.config.layers):
            for n in self._MATRICES:
                self._quantised(f"blk.{i}.{n}.weight")
            layer = {n: model.floats(f"blk.{i}.{n}.weight") for n in ("attn_norm", "ffn_norm")}
            layer |= {n: model.floats(f"blk.{i}.{n}.weight") for n in self._NORMS if f"blk.{i}.{n}.weight" in model.tensors}
            self.norms.append(layer)
        self.last_norm = model.floats("output_norm.weight") if "output_norm.weight" in model.tensors else None
        self.tokenizer = Tokenizer.from_metadata(model.metadata)

    def _quantised(self, name: str) -> str:
        t = self.model.tensors.get(name)
        if t is None:
            raise GGUFError(f"no tensor {name}")
        if t.dtype != "Q8_0":
            raise GGUFError(f"tensor {name} is {t.dtype}, not Q8_0")
        return name

    def _weight(self, name: str) -> np.ndarray:
        if self.kept is None:
            return self.model.floats(name)
        if name not in self.kept:
            self.kept[name] = self.model.floats(name)
        return self.kept[name]

    def _embedded(self, ids: np.ndarray) -> np.ndarray:
        if self.config.dim % 32:
            return self._weight(self.embed_name)[ids]
        return self.model.take(self.embed_name, ids)

    def check(self, ids: list[int]) -> None:
        c = self.config
        if not ids:
            raise ValueError("no tokens")
        if len(ids) > c.longest:
            raise ValueError(f"{len(ids)} tokens are more than {c.longest}")
        if min(ids) < 0 or max(ids) >= c.vocab:
            raise ValueError("token out of range")

    def forward(self, ids: list[int], dim: int | None = None) -> np.ndarray:
        """Unit vector of the first ``dim`` components of the mean over tokens."""
        return self.forward_many([ids], [dim])[0]

    def forward_many(self, texts: list[list[int]], dims: list[int | None]) -> list[np.ndarray]:
        """``forward`` of several texts, layer by layer together."""
        c = self.config
        for ids in texts:
            self.check(ids)
        order = sorted(range(len(texts)), key=lambda n: len(texts[n]))  # texts of equal length beside each other
        length = np.array([len(texts[n]) for n in order])
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(order)), length)
        places = np.arange(int(length.sum())) - begin[owner]
        edge = np.flatnonzero(np.diff(length, prepend=-1))
        runs = [(int(begin[a]), int(z - a), int(length[a])) for a, z in zip(edge, np.append(edge[1:], len(length)))]  # (first row, texts, tokens each)
        x = self._embedded(np.concatenate([texts[n] for n in order])).astype(np.float32) * np.float32(np.sqrt(c.dim))
        for i, norms in enumerate(self.norms):
            weight = lambda n: self._weight(f"blk.{i}.{n}.weight")  # noqa: B023, E731
            y = rms_norm(x, norms["attn_norm"], c.eps)
            codes = quantize_texts(y, begin, owner)
            q, k, v = (product_codes(*codes, weight(n)).reshape(len(x), -1, c.head_dim) for n in ("attn_q", "attn_k", "attn_v"))
            if "attn_q_norm" in norms:
                q = rms_norm(q, norms["attn_q_norm"], c.eps)
            if "attn_k_norm" in norms:
                k = rms_norm(k, norms["attn_k_norm"], c.eps)
            q, k = rope(q, places, c.base), rope(k, places, c.base)
            mixed = np.empty_like(q)
            for first, many, tokens in runs:
                rows = slice(first, first + many * tokens)
                mixed[rows] = attention_many(*(t[rows].reshape(many, tokens, -1, c.head_dim) for t in (q, k, v)), c.head_dim**-0.5).reshape(many * tokens, -1, c.head_dim)
            y = product_rows(mixed.reshape(len(x), -1), weight("attn_output"), begin, owner)
            if "post_attention_norm" in norms:
                y = rms_norm(y, norms["post_attention_norm"], c.eps)
            x = x + y
            y = rms_norm(x, norms["ffn_norm"], c.eps)
            codes = quantize_texts(y, begin, owner)
            y = gelu_quick(product_codes(*codes, weight("ffn_gate"))) * product_codes(*codes, weight("ffn_up"))
            y = product_rows(y, weight("ffn_down"), begin, owner)
            if "post_ffw_norm" in norms:
                y = rms_norm(y, norms["post_ffw_norm"], c.eps)
            x = x + y
        if self.last_norm is not None:
            x = rms_norm(x, self.last_norm, c.eps)
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        for n, first, tokens in zip(order, begin, length):
            dim = dims[n]
            out[n] = unit(pool(x[first : first + tokens], "mean", dim if dim and 0 < dim <= c.dim else None)).astype(np.float32)
        return out

    def embed_text(self, text: str, dim: int | None = None) -> np.ndarray:
        """A text with more tokens than the model takes is an error; nothing is cut off."""
        return self.forward(self.tokenizer.encode(text), dim)

    def embed_many(self, texts: list[str], dims: list[int | None], tokens: int = 4096) -> list[np.ndarray | ValueError]:
        """Vectors of texts, or the error of one that can't be encoded; about ``tokens`` tokens go through the layers at once."""
        out: list[np.ndarray | ValueError] = []
        for text in texts:
            try:
                ids = self.tokenizer.encode(text)
                self.check(ids)
                out.append(ids)
            except ValueError as e:
                out.append(e)
        order = sorted((n for n, ids in enumerate(out) if not isinstance(ids, ValueError)), key=lambda n: len(out[n]))
        low = 0
        while low < len(order):
            high, total = low, 0
            while high < len(order) and (high == low or total + len(out[order[high]]) <= tokens):
                total += len(out[order[high]])
                high += 1
            own = order[low:high]
            for n, vec in zip(own, self.forward_many([out[n] for n in own], [dims[n] for n in own])):
                out[n] = vec
            low = high
        return out


#: Least tasks a core of ``embed``.
TASKS = 4

_encoders: dict[str, Encoder] = {}


def encoder(path: str, keep: bool = False) -> Encoder:
    """Opened once in each process, expanded weights kept if the first call says so. ``path`` is a file, or the name of one given to ``SparkContext.addFile``."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(open_file(path if "/" in path else SparkFiles.get(path)), keep)
    return _encoders[path]


def embed(requests: DataFrame, path: str, id_col: str = "id", strict: bool = True, batch: int = 512) -> DataFrame:
    """(id, vec, error) of requests (task, content, title, description, dim; all but content may be absent).

    ``strict``: requests without a prompt or with an unsupported dimension fail the call before any text is encoded,
    and so does a text that can't be encoded. Otherwise such rows have a null vector and their error.
    """
    have = {c.lower() for c in requests.columns}
    col = lambda n, kind="string": F.col(n).cast(kind) if n in have else F.lit(None).cast(kind)
    text, error = P.prompt_parts(F.coalesce(col("task"), F.lit("SearchQuery")), F.col("content").cast("string"), col("title"), col("description"))
    dim = P.dim_column(col("dim", "int"), strict=False)
    error = F.coalesce(error, F.when(dim.isNull(), F.concat(F.lit("unsupported dimension "), col("dim"))))
    rows = requests.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), dim.alias("dim"), error.alias("error"))
    if strict:
        bad = rows.where("error is not null").select("id", "error").first()
        if bad:
            raise P.PromptError(f"request {bad['id']}: {bad['error']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for b in batches:
            for low in range(0, b.num_rows, batch):
                part = b.slice(low, batch)
                errors, prompts, sizes = (part.column(n).to_pylist() for n in (3, 1, 2))
                vecs: list[np.ndarray | None] = [None] * part.num_rows
                good = [n for n, e in enumerate(errors) if e is None]
                for n, got in zip(good, model.embed_many([prompts[n] for n in good], [sizes[n] for n in good])):
                    if isinstance(got, ValueError):
                        if strict:
                            raise got
                        errors[n] = str(got)
                    else:
                        vecs[n] = got
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vecs, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["id", "vec", "error"])

    # encoding costs far more than sending a text elsewhere, and tasks that are many and alike end together
    parts = max(TASKS * rows.sparkSession.sparkContext.defaultParallelism, 2 * rows.rdd.getNumPartitions())
    rows = rows.repartition(parts, F.xxhash64("id", "text"))
    return rows.mapInArrow(run, "id bigint, vec array<float>, error string")


def embed_texts(texts: DataFrame, path: str, task: str = "SearchQuery", dim: int = P.DEFAULT_DIM, id_col: str = "id", text_col: str = "text", strict: bool = True) -> DataFrame:
    """As ``embed`` with one task and dimension for all."""
    P.resolve_dim(dim)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"), F.lit(task).alias("task"), F.lit(dim).alias("dim"))
    return embed(rows, path, strict=strict)


def embed_one(path: str, content: str, task: str = "SearchQuery", dim: int = 0, title: str | None = None, description: str | None = None) -> np.ndarray:
    """One request, in this process."""
    prompt, size = P.build_prompt(task, content, title, description), P.resolve_dim(dim)
    return encoder(path, keep=True).embed_text(prompt, size)


def throughput(requests: DataFrame, path: str, **options) -> dict[str, float]:
    """Embed all requests and tell how many there were, the seconds that took, milliseconds a text and texts a second."""
    began = time.perf_counter()
    n = embed(requests, path, **options).agg(F.count("vec")).first()[0]
    took = time.perf_counter() - began
    return {"texts": n, "seconds": took, "ms_each": 1000 * took / n if n else 0.0, "texts_a_second": n / took}
