"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's spaces become the space mark and one mark is put before it. Symbols start as characters; an agenda holds
the adjacent pairs that are pieces, highest score first and leftmost of equals; the top pair is merged and the
pairs with its new neighbours are added, until none is left. Characters that are no piece become byte pieces,
or the unknown id if the vocabulary hasn't those.

Merges never join characters that no piece has side by side, so a text falls into chunks that are encoded by
themselves. Each Arrow batch is cut into chunks with array operations, its distinct chunks are encoded once
(kept from batch to batch in bounded caches) and the ids are gathered for all occurrences. Chunks of up to 15 bytes, nearly
all of them, are found by their bytes in a table of arrays and never become Python's objects; longer ones are. Chunks of up to 32
known characters are merged side by side, each with its agenda as a row of a matrix; the others one by one with a heap.

A model that isn't of the merge type, or that changes texts otherwise (a normaliser, white space taken out, no mark before
a text), is refused, as it would be encoded wrongly.

Defined cases: a null text has null ids; the empty text has none. The mark itself in a text reads as a space.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.common import bounded_batches, column, spans, text_parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks of more than ``SHORT`` bytes that are kept.
CACHE = 300_000
#: Bytes of a chunk that its key holds beside their number.
SHORT = 15
#: Places of the table of short chunks, which is emptied when it might be filled by more than half and ``AT_ONCE``, and chunks that are sought at once.
SLOTS, AT_ONCE = 1 << 20, 1 << 17


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


def check_model(model: bytes) -> None:
    """An error for a model that ``Codec`` doesn't encode as the library does."""
    top = {n: dict(_fields(v)) for n, v in _fields(model) if n in (2, 3)}
    trainer, normalizer = top.get(2, {}), top.get(3, {})
    if trainer.get(3, 1) != 2:
        raise ValueError("the model isn't of the merge type (BPE)")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model normalises texts: only a mark before the text and marks for spaces are supported")


SPREAD = 0x9E3779B97F4A7C15
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _home(low: np.ndarray, high: np.ndarray, slots: int) -> np.ndarray:
    """Where a key is first sought among ``slots``, a power of two."""
    h = (low ^ high * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(SPREAD)
    return (((h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


class Places:
    """Keys of two numbers, the second not 0, each in a place of its own (open addressing, all keys of a call side by side)."""

    def __init__(self, slots: int):
        self.slots, self.used = slots, 0
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.value = np.zeros(slots, np.int64)

    def claim(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them (one of equals) got theirs now. There must be room for all."""
        at = _home(low, high, self.slots)
        fresh, rest, spot = [np.zeros(0, np.int64)], np.arange(len(at)), at
        while len(rest):
            empty = np.flatnonzero(self.high[spot] == 0)
            if len(empty):
                own, free = rest[empty], spot[empty]
                self.value[free] = own  # of several one stays, and it is the one that gets the place
                first = self.value[free] == own
                own, free = own[first], free[first]
                self.low[free], self.high[free] = low[own], high[own]
                fresh.append(own)
            other = np.flatnonzero((self.low[spot] != low[rest]) | (self.high[spot] != high[rest]))
            rest = rest[other]
            spot = (spot[other] + 1) & (self.slots - 1)
            at[rest] = spot
        new = np.concatenate(fresh)
        self.used += len(new)
        return at, new


class Codec:
    """A vocabulary read from the bytes of a model file, with its agenda encoder and its decoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        check_model(model)
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.library = p
        self.size = p.get_piece_size()
        self.unknown = p.unk_id()
        self.end = p.eos_id()
        self.cost: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        spelled = []
        touching = np.zeros((256, 256), bool)
        for i in range(self.size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unused(i):
                spelled.append(b"")
            elif p.is_unknown(i):
                spelled.append(" ⁇ ".encode())
            else:
                piece = piece.replace(MARK, " ")
                self.cost[piece] = -p.get_score(i)
                self.ids[piece] = i
                raw = piece.encode()
                spelled.append(raw)
                for a, b in zip(piece, piece[1:]):
                    if a.isascii() and b.isascii():
                        touching[ord(a), ord(b)] = True
        # beside other bytes nothing is known, except that a space only follows spaces
        touching[128:, :] = touching[:, 128:] = True
        if not any(" " in x.lstrip(" ") for x in self.cost):
            touching[128:, 32] = False
        self.touching = touching.reshape(-1)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.widths = np.array([len(x) for x in spelled])
        self.begins = np.cumsum(self.widths) - self.widths
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._empty()
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        # pairs of ids and the piece that they make, one number each, in open addressing; -1 is an empty place
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.piece_bits = np.uint64(64 - bits), self.size.bit_length()
        table = [-1] * (1 << bits)
        for key, i in pairs.items():
            at = (key * SPREAD & (1 << 64) - 1) >> 64 - bits
            while table[at] >= 0:
                at = (at + 1) & (1 << bits) - 1
            table[at] = key << self.piece_bits | i
        self.pairs = np.array(table, np.int64)
        cost = np.full(self.size + 1, np.inf, np.float32)  # the last is that of no piece, -1
        for piece, i in self.ids.items():
            cost[i] = self.cost[piece]
        self.piece_cost = cost
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text``, whose spaces stand for marks, by the agenda."""
        cost = self.cost
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            if pair in cost:
                agenda.append((cost[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = part[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(part[j]) != len(pair) or not pair.startswith(left):
                continue  # one of them was merged meanwhile
            part[i], part[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + part[k]
                if new in cost:
                    heapq.heappush(agenda, (cost[new], i, new))
            h = before[i]
            if h >= 0:
                new = part[h] + pair
                if new in cost:
                    heapq.heappush(agenda, (cost[new], h, new))
        return [x for x in part if x is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for piece in self.merge(chunk):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
                continue
            raw = [self.byte_ids[b] for b in (MARK if piece == " " else piece).encode()]
            if min(raw) >= 0:
                out.extend(raw)
            elif not out or out[-1] != self.unknown:  # unknown characters in a row are one
                out.append(self.unknown)
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of ids makes, -1 where it is none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -2)
        at = (key.view(np.uint64) * np.uint64(SPREAD) >> self.shift).view(np.int64)
        got = self.pairs[at]
        same = got >> self.piece_bits == key
        piece = np.where(same, got & (1 << self.piece_bits) - 1, -1).astype(np.int32)
        rest = np.flatnonzero(~same & (got >= 0) & (key >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.pairs) - 1)
            got = self.pairs[at[rest]]
            same = got >> self.piece_bits == key[rest]
            piece[rest[same]] = got[same] & (1 << self.piece_bits) - 1
            rest = rest[~same & (got >= 0)]
        return piece

    def _merge_many(self, chars: np.ndarray) -> np.ndarray:
        """Ids of chunks of up to equal length (rows of character ids, -1 behind): their agendas side by side.

        A row of ``cost`` is a chunk's agenda; its least entry, the leftmost of equals, is merged in every round. A merged
        pair stays in the left one's place, and ``after`` and ``before`` lead past the other's. Each end of a row has a place for nothing.
        """
        rows, width = len(chars), chars.shape[1] + 2
        done = np.full((rows, width), -1, np.int32)
        done[:, 1:-1] = chars
        part, row, first = done.copy().reshape(-1), np.arange(rows), np.arange(rows) * width
        after, before = np.arange(1, len(part) + 1), np.arange(-1, len(part) - 1)
        made = np.full(len(part), -1, np.int32)
        made[:-1] = self._joined(part[:-1], part[1:])
        cost = self.piece_cost[made]
        while True:
            at = first + cost.reshape(-1, width).argmin(axis=1)
            live = np.flatnonzero(cost[at] < np.inf)
            if 2 * len(live) < len(row):
                done[row] = part.reshape(-1, width)
                if not len(live):
                    return done[:, 1:-1]
                back = ((live - np.arange(len(live))) * width)[:, None]
                part, made, cost = (x.reshape(-1, width)[live].reshape(-1) for x in (part, made, cost))
                after, before = ((x.reshape(-1, width)[live] - back).reshape(-1) for x in (after, before))
                row, at, first = row[live], at[live] - back[:, 0], first[: len(live)]
            else:
                at = at[live]
            gone, last, piece = after[at], before[at], made[at]
            then = after[gone]
            part[at], part[gone] = piece, -1
            cost[gone] = np.inf
            after[at], before[then] = then, at
            new = self._joined(np.concatenate([piece, part[last]]), np.concatenate([part[then], piece]))
            fresh, n = self.piece_cost[new], len(at)
            made[at], cost[at] = new[:n], fresh[:n]
            made[last], cost[last] = new[n:], fresh[n:]

    def _many(self, text: str, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks of ``length`` characters that make up ``text``: all ids, where a chunk's begin and how many they are."""
        code = self.char_ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(length) - length
        plain = (np.minimum.reduceat(code, begin) >= 0) & (length <= 32)
        order = np.argsort(length, kind="stable")
        order = order[plain[order]]
        flat, which, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.zeros(len(length), np.int64)
        for low in range(0, len(order), 4096):
            own = order[low : low + 4096]
            width = max(2, int(length[own].max()))
            at = begin[own][:, None] + np.arange(width)
            ids = self._merge_many(np.where(np.arange(width) < length[own][:, None], code[np.minimum(at, len(code) - 1)], -1))
            count[own] = (ids >= 0).sum(axis=1)
            flat.append(ids[ids >= 0])
            which.append(own)
        odd = np.flatnonzero(~plain)
        for i in odd.tolist():
            flat.append(np.array(self.chunk_ids(text[begin[i] : begin[i] + length[i]]), np.int32))
            count[i] = len(flat[-1])
        along = np.concatenate([*which, odd])
        start = np.empty(len(length), np.int64)
        start[along] = np.cumsum(count[along]) - count[along]
        return np.concatenate(flat), start, count

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of long chunks."""
        young, old = self.young, self.old
        out = [young.get(c) for c in chunks]
        missing = [k for k, x in enumerate(out) if x is None]
        fresh = []
        for k in missing:
            got = old.get(chunks[k])
            if got is None:
                fresh.append(k)
            else:
                out[k] = got
        if fresh:
            flat, start, count = self._many("".join(chunks[k] for k in fresh), np.array([len(chunks[k]) for k in fresh]))
            for k, low, n in zip(fresh, start.tolist(), count.tolist()):
                out[k] = flat[low : low + n].tobytes()
        for k in missing:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[chunks[k]] = out[k]
        return out

    def _empty(self) -> None:
        """Forget the short chunks. A value is where the ids begin, times 256, and how many they are."""
        self.short, self.pool, self.pooled = Places(SLOTS), np.empty(1 << 16, np.int32), 0

    def _learn(self, laid: np.ndarray, begin: np.ndarray, length: np.ndarray, at: np.ndarray) -> None:
        """Encode short chunks, whose places are ``at``."""
        start = np.cumsum(length) - length
        raw = laid[np.repeat(begin - start, length) + np.arange(int(length.sum()))]
        flat, first, count = self._many(raw.tobytes().decode(), np.add.reduceat((raw & 0xC0 != 0x80).astype(np.int64), start))
        if self.pooled + len(flat) > len(self.pool):
            grown = np.empty(2 * (self.pooled + len(flat)), np.int32)
            grown[: self.pooled] = self.pool[: self.pooled]
            self.pool = grown
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self.short.value[at] = (self.pooled + first) * 256 + count
        self.pooled += len(flat)

    def _ids(self, laid: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has. ``laid`` has 16 bytes more than the chunks."""
        each, start = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        if self.short.used + len(begin) > self.short.slots // 2 + AT_ONCE:
            self._empty()
        fits = length <= SHORT
        short, long = (slice(None), np.zeros(0, np.int64)) if fits.all() else (np.flatnonzero(fits), np.flatnonzero(~fits))
        b, n = begin[short], length[short]
        if len(b):
            word = np.ndarray(len(laid) - 7, "<u8", laid, strides=(1,))  # the eight bytes from each one on
            low = word[b] & _MASK[np.minimum(n, 8)]
            high = word[b + 8] & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
            at, new = self.short.claim(low, high)
            if len(new):
                self._learn(laid, b[new], n[new], at[new])
            value = self.short.value[at]
            each[short], start[short] = value & 255, value >> 8
        known: list[bytes] = []
        if len(long):
            chunks = pa.array([laid[x : x + y].tobytes().decode() for x, y in zip(begin[long].tolist(), length[long].tolist())], pa.large_string()).dictionary_encode()
            found = self._known(chunks.dictionary.to_pylist())
            known = [found[k] for k in chunks.indices.to_pylist()]
            each[long] = [len(k) // 4 for k in known]
        end = np.cumsum(each)
        ids = self.pool[np.repeat(np.where(fits, start - (end - each), -(end - each)), each) + np.arange(end[-1])]
        if len(long):
            here = each[long]
            ids[np.repeat(end[long] - np.cumsum(here), here) + np.arange(int(here.sum()))] = np.frombuffer(b"".join(known), np.int32)
        return ids, each

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and 64-bit offsets; nulls have none."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        data, offsets = text_parts(texts)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for low, high in spans(offsets):
            part = offsets[low : high + 1]
            a, b = self._encode(data[part[0] : part[-1]], part - part[0])
            ids.append(a)
            counts.append(b)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(offsets)
        filled = n > 0
        if not filled.any():
            return np.zeros(0, np.int32), np.zeros(len(n), np.int64)
        first = (offsets[:-1] + np.cumsum(filled) - filled)[filled]  # with a mark put before each text
        total = len(data) + len(first)
        laid = np.full(total + 16, 32, np.uint8)
        laid[np.arange(len(data)) + np.repeat(np.cumsum(filled), n)] = data
        cut = np.empty(total, bool)
        cut[0] = True
        cut[1:] = ~self.touching[(laid[: total - 1].astype(np.uint16) << 8) | laid[1:total]]
        cut[first] = True
        begin = np.flatnonzero(cut)
        length = np.diff(begin, append=total)
        found = [self._ids(laid, begin[low : low + AT_ONCE], length[low : low + AT_ONCE]) for low in range(0, len(begin), AT_ONCE)]
        ids, each = (np.concatenate(x) for x in zip(*found))
        upto = np.concatenate([[0], np.cumsum(each)])
        place = np.searchsorted(begin, np.append(first, total))
        counts = np.zeros(len(n), np.int64)
        counts[filled] = np.diff(upto[place])
        return ids, counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts and their offsets: spellings in a row, without the first text's mark."""
        width = self.widths[ids]
        end = np.cumsum(width)
        total = int(end[-1]) if len(end) else 0
        out = self.spelled[np.repeat(self.begins[ids] - (end - width), width) + np.arange(total)]
        at = np.concatenate([[0], end])[offsets]
        keep = np.ones(total, bool)
        first = at[:-1][np.diff(at) > 0]
        keep[first] = out[first] != 32
        upto = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], upto[at]


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """Built once in each Python worker."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, offsets: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(nulls))


def _pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Runs of rows of ``most`` bytes, so that a batch of long texts is answered in several."""
    _, offsets = text_parts(column)
    for low, high in spans(offsets, most):
        yield low, high


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): ``round_trip`` says whether decoding the ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for low, high in _pieces(b.column(1)):
                texts = b.column(1).slice(low, high - low)
                ids, offsets = c.encode(texts)
                data, at = text_parts(texts)
                back, back_at = c.decode(ids, offsets)
                nulls = texts.is_null().to_numpy(zero_copy_only=False)
                same = np.diff(back_at) == np.diff(at)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same &= np.diff(wrong[at]) == 0
                else:
                    same &= np.array([back[x:y].tobytes() == data[u:v].tobytes() for x, y, u, v in zip(back_at, back_at[1:], at, at[1:])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), _lists(ids, offsets, nulls), pa.array(np.diff(offsets), mask=nulls), pa.array(same, mask=nulls)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    bounded_batches(docs.sparkSession)
    source = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean")


def counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): how many ids ``encode`` gives each row; 0 for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            _, offsets = c.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets))], names=["doc_id", "n_tokens"])

    bounded_batches(docs.sparkSession)
    source = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids. Null ids give null; ids outside the vocabulary are left out; broken UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            column = b.column(1)
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(column.flatten(), -1).to_numpy()
            good = (flat >= 0) & (flat < c.size)
            upto = np.concatenate([[0], np.cumsum(good)])
            data, at = c.decode(flat[good], upto[np.concatenate([[0], np.cumsum(counts)])])
            raw = data.tobytes()
            texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string(), mask=nulls)], names=["doc_id", "text"])

    source = rows.select(column(id_col).cast("bigint").alias("doc_id"), column(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "doc_id bigint, text string")


def library_check(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, agrees): whether ids and decoded text are those of the sentencepiece library, batch by batch. Null texts agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids, offsets = c.encode(b.column(1))
            data, at = c.decode(ids, offsets)
            theirs = c.library.encode([x or "" for x in b.column(1).to_pylist()], num_threads=1)
            spelled = c.library.decode(theirs, num_threads=1)
            ok = [
                t == ids[x:y].tolist() and s.encode() == data[u:v].tobytes()
                for t, s, x, y, u, v in zip(theirs, spelled, offsets, offsets[1:], at, at[1:])
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], names=["doc_id", "agrees"])

    bounded_batches(docs.sparkSession)
    source = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, agrees boolean")
