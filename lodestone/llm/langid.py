"""Language of a text by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed against each automaton: a phrase
is the longest run of symbols that occurs in the labelled text (one symbol at least). The estimate of the
cross-entropy is ``phrases * log2(length of the labelled text) / length of the text``; the language with the
least wins, and the first by name of equals.

Symbols are the UTF-8 bytes of the text in lower case (ASCII and Latin-1 letters), with every run of other ASCII
bytes as one space. A phrase ends with its block of ``BLOCK`` symbols, so that all blocks of a batch can be parsed
side by side: a parse never goes back, so walking the automaton is one table lookup a symbol, done for all blocks
at once. The labelled text is a bounded sample: ``SAMPLE`` symbols a language, from at least ``SOURCES`` documents
where there are so many; texts shorter than ``SAMPLE / SOURCES`` bytes are taken where the longer ones don't fill it.
As samples can differ in length, all are held to the length of the longest.

Defined cases: a null text or one without letters has the language null; without labelled text all do; rows
with a null label aren't learned from; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import bounded_batches, column, fresh, spans, text_parts

SAMPLE = 12288
SOURCES = 48
BLOCK = 1024
TOLERANCE = 0.03
#: Ids of documents to learn from that are broadcast, some 4 MB; those of more languages are joined by a shuffle.
LISTED = 1 << 17

_LOW = np.full(256, 32, np.uint8)
for _b in range(128, 256):
    _LOW[_b] = _b
for _b in range(26):
    _LOW[65 + _b] = _LOW[97 + _b] = 97 + _b
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0x9F] = True
_LATIN[0x97] = False


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised symbols of each row and their offsets."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros_like(offsets)
    s = _LOW[data]
    upper = _LATIN[s[1:]] & (s[:-1] == 0xC3)
    s[1:][upper] |= 0x20
    keep = s != 32
    keep[1:] |= s[:-1] != 32
    keep[0] = s[0] != 32
    begins = offsets[:-1][np.diff(offsets) > 0]
    keep[begins] = s[begins] != 32  # no space at the start of a row
    count = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], count[offsets]


def normalise(text: str) -> bytes:
    data = np.frombuffer(text.encode(), np.uint8)
    return symbols(data, np.array([0, len(data)]))[0].tobytes()


class Automaton:
    """Transition table of the suffix automaton of ``text``.

    ``table[state + code]`` is ``next state << 2 | phrases that end``, states being multiples of the alphabet's size.
    A phrase that can't be continued ends and the symbol starts the next one; a symbol that the text hasn't is a
    phrase by itself. The last code is padding, which changes nothing.
    """

    def __init__(self, text: bytes):
        known = sorted(set(text))
        self.code = np.full(256, len(known), np.uint8)
        self.code[known] = np.arange(len(known))
        self.length = len(text)
        self.size = size = len(known) + 2
        nexts: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for c in self.code[np.frombuffer(text, np.uint8)].tolist():
            new = len(nexts)
            nexts.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        root = np.full(size, 1, np.int32)  # unknown: one phrase, back at the root
        for c, q in nexts[0].items():
            root[c] = (q * size) << 2
        table = np.tile(root + 1, (len(nexts), 1))
        table[0] = root
        for s, step in enumerate(nexts):
            for c, q in step.items():
                table[s, c] = (q * size) << 2
        table[:, -1] = (np.arange(len(nexts)) * size) << 2
        self.table = table.reshape(-1).astype(np.int32)


_automata: dict[bytes, Automaton] = {}


def automaton(text: bytes) -> Automaton:
    """Built once in each Python worker."""
    if text not in _automata:
        if len(_automata) >= 64:
            _automata.clear()
        _automata[text] = Automaton(text)
    return _automata[text]


def phrases(auto: Automaton, lanes: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Phrases of each column of ``lanes`` (symbols by row; ``live``: how many columns still have symbols in each row)."""
    width = lanes.shape[1]
    state = np.zeros(width, np.int32)
    found = np.zeros(width, np.int32)
    codes = auto.code[lanes]
    for t, n in enumerate(live.tolist()):
        e = auto.table[state[:n] + codes[t, :n]]
        found[:n] += e & 3
        state[:n] = e >> 2
    return found + (state != 0)


def cross_entropies(samples: list[bytes], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) estimates in bits a symbol, and the number of symbols of each text."""
    data, offsets = text_parts(texts)
    rows = len(offsets) - 1
    out, length = np.zeros((rows, len(samples))), np.zeros(rows, np.int64)
    for low, high in spans(offsets):
        part = offsets[low : high + 1]
        s, at = symbols(data[part[0] : part[-1]], part - part[0])
        n = np.diff(at)
        length[low:high] = n
        blocks = -(-n // BLOCK)
        if not blocks.sum():
            continue
        row = np.repeat(np.arange(high - low), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[row] + nth * BLOCK
        size = np.minimum(BLOCK, at[row + 1] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        padded = np.concatenate([s, np.zeros(BLOCK, np.uint8)])
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, int(size[0]))[begin].T)
        for k, sample in enumerate(samples):
            out[low:high, k] = np.bincount(row, phrases(automaton(sample), lanes, live), high - low) * np.log2(max([2, *map(len, samples)]))
    return out / np.maximum(length, 1)[:, None], length


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sources: int = SOURCES) -> dict[str, bytes]:
    """Normalised labelled text of each language: ``sample`` symbols from the first documents by a hash of their ids, long enough ones first."""
    quota = sample // sources
    key = F.coalesce(column(id_col).cast("bigint"), F.xxhash64(column(text_col)))
    letters_of = lambda n: F.octet_length(F.regexp_replace(F.substring(column(text_col), 1, n), r"[\x00-@\[-`{-\x7f]+", ""))
    # no more than the quota is asked for, which the beginning of most texts has
    letters = F.when(letters_of(4 * quota) >= quota, quota).otherwise(letters_of(sample))
    rows = docs.select(key.alias("id"), column(lang_col).cast("string").alias("lang"), (F.octet_length(column(text_col)) < quota).alias("short"), letters.alias("letters"))
    rows = rows.where("lang is not null and letters > 0").select("id", "lang", "short", F.least("letters", F.lit(quota)).alias("letters"))
    w = Window.partitionBy("lang").orderBy("short", F.xxhash64("id"), "id")
    # a row has a letter at least; of the first rows those that fill twice the sample
    first = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 2 * sample)
    before = F.sum("letters").over(Window.partitionBy("lang").orderBy("nth")) - F.col("letters")
    chosen = first.withColumn("before", before).where(F.col("before") < 2 * sample).select("id", "lang").distinct().collect()
    if not chosen:
        return {}
    # bounded: 2 * sample ids a language
    ids = docs.sparkSession.createDataFrame([(r.id, r.lang) for r in chosen], "id bigint, lang string")
    text = docs.select(key.alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"), (F.octet_length(column(text_col)) < quota).alias("short")).where("text is not null")
    # of a document that occurs in several rows one text, so what is collected is bounded too
    head = F.substring("text", 1, sample)
    ids = F.broadcast(ids) if len(chosen) <= LISTED else ids
    got = text.join(ids, ["id", "lang"]).groupBy("lang", "id").agg(F.min("short").alias("short"), F.min_by(head, F.struct("short", head)).alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.short, r.id, r.text)):
        have = out.get(r.lang, b"")
        out[r.lang] = have + normalise(r.text)[: min(quota, sample - len(have))]
    return {k: v for k, v in sorted(out.items()) if v}


def _udf(samples: dict[str, bytes]):
    names, kept = list(samples), list(samples.values())

    def run(texts: pa.Array) -> pa.Array:
        bits, length = cross_entropies(kept, texts) if kept else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
        known = (length > 0) & bool(kept)
        best = bits.argmin(axis=1)
        lang = pa.array(np.array(names or [""], object)[best], pa.string(), mask=~known)
        # bits of every language, so that a caller can hold a declared one against the best
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1)))
        return pa.StructArray.from_arrays([lang, pa.array(bits.min(axis=1), mask=~known), flat], names=["lang", "bits", "each"])

    return F.arrow_udf(run, "lang string, bits double, each array<double>").asNondeterministic()


def _add(docs: DataFrame, samples: dict[str, bytes], name: str, text_col: str, lang_col: str | None, tolerance: float) -> DataFrame:
    """Add struct column ``name``: (lang, bits, accepted)."""
    bounded_batches(docs.sparkSession)
    raw = fresh([*docs.columns, name], "language_raw")
    out = docs.withColumn(raw, _udf(samples)(column(text_col)))
    ok = F.col(f"{raw}.lang").isNotNull()
    if lang_col is not None and samples:
        said = F.lit(None).cast("double")
        for k, lang in enumerate(samples):
            said = F.when(column(lang_col) == lang, F.element_at(F.col(f"{raw}.each"), k + 1)).otherwise(said)
        # a declared language that wasn't learned can't be contradicted by bits; it is by its name
        ok = ok & (column(lang_col).isNull() | F.coalesce(said <= F.col(f"{raw}.bits") * (1 + tolerance), F.lit(False)))
    return out.withColumn(name, F.struct(F.col(f"{raw}.lang").alias("lang"), F.col(f"{raw}.bits").alias("bits"), ok.alias("accepted"))).drop(raw)


def identify(docs: DataFrame, samples: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, lang, bits, accepted): accepted unless no language was found or the declared one needs over ``1 + tolerance`` times the phrases of the best."""
    name = fresh(docs.columns, "language")
    return _add(docs, samples, name, text_col, lang_col, tolerance).select(column(id_col).alias("doc_id"), f"{name}.lang", f"{name}.bits", f"{name}.accepted")


def accept(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", lang_col: str | None = "lang", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts."""
    name = fresh(docs.columns, "language")
    return _add(docs, samples, name, text_col, lang_col, tolerance).where(F.col(f"{name}.accepted")).drop(name)
