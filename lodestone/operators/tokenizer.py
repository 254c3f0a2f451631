"""Tokenizer of scored vocabularies: normalising, space marks, merges by score, byte pieces."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.shared import bounded_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FIRST_BYTE = 238
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that are kept with their pieces, and characters of one that is.
_KEPT = 50_000
_KEPT_LENGTH = 48
_ONE_SPACE = re.compile(r"(?<! ) (?! )")


def normalize(text: str, nfkc: bool = True, strip_accents: bool = False, lower: bool = False) -> str:
    """NFKC, then without combining marks, then lower case."""
    if nfkc:
        text = unicodedata.normalize("NFKC", text)
    if strip_accents:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return text.lower() if lower else text


def mark_spaces(text: str) -> str:
    """Single spaces become marks; runs of two and more stay."""
    return _ONE_SPACE.sub(MARK, text)


def mark_spaces_column(text: Column) -> Column:
    return F.regexp_replace(text, "(?<! ) (?! )", MARK)


@dataclass
class Tokenizer:
    vocab: list[str]
    scores: list[float]
    types: list[int] = field(default_factory=list)
    add_bos: bool = False
    add_eos: bool = False
    nfkc: bool = True
    strip_accents: bool = False
    lower: bool = False
    bos: int = -1
    eos: int = -1
    unknown: int = -1
    pad: int = -1

    def __post_init__(self) -> None:
        if len(self.vocab) != len(self.scores):
            raise ValueError(f"{len(self.vocab)} tokens but {len(self.scores)} scores")
        if self.types and len(self.types) != len(self.vocab):
            raise ValueError(f"{len(self.vocab)} tokens but {len(self.types)} types")
        self.types = self.types or [NORMAL] * len(self.vocab)
        self.ids = {t: i for i, t in enumerate(self.vocab)}
        # merges of equal scores go from the right
        self.gain = {t: -self.scores[i] for t, i in self.ids.items()}
        # no merge joins a mark to what is before it, so a text falls into words that are merged by themselves
        self.by_word = not any(MARK in t.lstrip(MARK) for t in self.vocab)
        self.known: dict[str, list[str]] = {}

    @classmethod
    def from_metadata(cls, metadata: dict[str, object]) -> Tokenizer:
        prefix = "tokenizer.ggml."
        for key in ("tokens", "scores"):
            if not isinstance(metadata.get(prefix + key), list):
                raise ValueError(f"metadata has no {prefix}{key}")
        special = {n: metadata.get(f"{prefix}{k}_token_id", -1) for n, k in (("bos", "bos"), ("eos", "eos"), ("unknown", "unknown"), ("pad", "padding"))}
        flags = {n: v if isinstance(v := metadata.get(f"{prefix}add_{k}_token", d), bool) else d for n, k, d in (("add_bos", "bos", True), ("add_eos", "eos", False))}
        types = metadata.get(prefix + "token_type") or []
        return cls(list(metadata[prefix + "tokens"]), [float(x) for x in metadata[prefix + "scores"]], list(types), **flags, **special)

    def pieces(self, text: str) -> list[str]:
        """Symbols after all merges, best score first and rightmost of equals. Words are merged once and kept, but for long ones."""
        if not self.by_word:
            return self.merged(text)
        out: list[str] = []
        for word in _CHUNK.findall(text):
            got = self.known.get(word)
            if got is None:
                got = self.merged(word)
                if len(word) <= _KEPT_LENGTH:
                    if len(self.known) >= _KEPT:
                        self.known.clear()
                    self.known[word] = got
            out += got
        return out

    def merged(self, text: str) -> list[str]:
        """``pieces`` of a text as one, by a heap instead of a scan for each merge."""
        gain = self.gain
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(gain[p], -i, p) for i in range(n - 1) if (p := text[i : i + 2]) in gain]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            i = -i
            left = part[i]
            j = after[i]
            if left is None or j >= n or left + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + part[k]) in gain:
                    heapq.heappush(queue, (gain[new], -i, new))
            h = before[i]
            if h >= 0 and (new := part[h] + pair) in gain:
                heapq.heappush(queue, (gain[new], -h, new))
        return [p for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        text = mark_spaces(normalize(text, self.nfkc, self.strip_accents, self.lower))
        out = [self.bos] if self.add_bos and self.bos >= 0 else []
        has_bytes = len(self.vocab) > FIRST_BYTE + 255
        for piece in self.pieces(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif has_bytes:  # through the token's text, as two ids can share one
                out += [self.ids[self.vocab[FIRST_BYTE + b]] for b in piece.encode()]
            elif 0 <= self.unknown < len(self.vocab):
                out.append(self.ids[self.vocab[self.unknown]])
        if self.add_eos and self.eos >= 0:
            out.append(self.eos)
        return out

    def special(self, i: int) -> bool:
        return i in (self.bos, self.eos, self.unknown, self.pad) or self.types[i] in (CONTROL, UNUSED)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; those that are special or out of range are left out."""
        return "".join(self.vocab[i].replace(MARK, " ") for i in ids if 0 <= i < len(self.vocab) and not self.special(i))


#: Bytes of texts or ids that are turned into Python's objects at once, which take some tens of times as many; a longer row is alone.
SLICE_BYTES = 256 << 10


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of a column of texts or lists of about ``SLICE_BYTES``, in order."""
    size = pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.multiply(pc.list_value_length(column), 4), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield column.slice(low, high - low)
        low = high


def _mapped(df: DataFrame, id_col: str, value_col: str, kind: str, answer, out: pa.DataType, name: str) -> DataFrame:
    """``answer`` of every value. Values become Python's objects a slice at a time, and results go on as they are ready, so memory follows from the longest value, not from a batch's."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = 0
            for part in _slices(b.column(1)):
                found = pa.array([None if not x.is_valid else answer(x.as_py()) for x in part], out)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, len(part)), found], names=["id", name])
                low += len(part)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(value_col).cast(kind).alias("value"))
    return rows.mapInArrow(run, f"id bigint, {name} {'array<int>' if name == 'token_ids' else 'string'}")


def encode(df: DataFrame, tokenizer: Tokenizer, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, token_ids); a null text gives null."""
    return _mapped(df, id_col, text_col, "string", lambda x: np.array(tokenizer.encode(x), np.int32), pa.list_(pa.int32()), "token_ids")


def decode(df: DataFrame, tokenizer: Tokenizer, id_col: str = "id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text); null ids give null."""
    return _mapped(df, id_col, ids_col, "array<int>", tokenizer.decode, pa.string(), "text")


def normalized(df: DataFrame, id_col: str = "id", text_col: str = "text", **flags: bool) -> DataFrame:
    """(id, text) normalised."""
    return _mapped(df, id_col, text_col, "string", lambda x: normalize(x, **flags), pa.string(), "text")
