"""Information-theoretic removal of personal data.

Protected entities (addresses, phone, card and account numbers, keys and passwords) are found by their form and
generalised to their kind: ``[EMAIL]``. What else gives an entity away is estimated from the corpus. With ``n(t)``
documents that hold term ``t`` of ``N``, ``n(e)`` that hold entity ``e`` and ``n(e, t)`` that hold both:

    information of e      IC(e)    = log2(N / n(e))
    what t reveals of e   PMI(e;t) = log2(n(e, t) * N / (n(e) * n(t)))

The bits of ``e`` that stay hidden from who knows ``t`` are ``IC(e) - PMI(e;t) = -log2(n(e, t) / n(t))``. In documents
that hold ``e``, terms that leave at most ``REMOVE`` bits are taken out, terms that leave at most ``GENERALISE`` bits
become the kind of term they are: ``[NUMBER]``, ``[CODE]`` (digits and letters), ``[NAME]`` (with a capital) or ``[WORD]``. Small counts may be chance: of a pair with fewer than ``SUPPORT`` different surroundings (the words
within ``WINDOW`` of ``e``, a document), the PMI less ``SURE`` standard errors, ``1 / (sqrt(n(e, t)) * ln 2)`` each,
must be above 0. Counts are over all documents, copies included.

Entities that the same documents hold have the same counts with every term, so they are scored as one.

Defined cases: a null text stays null; an empty text stays empty; a text without entities is returned byte for byte;
an entity that every document holds has no information, so nothing is taken out for it; rows are told apart by their
text alone, so null or repeated ids are no matter; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, column, fresh, materialize, mix64, spans, text_parts
from lodestone.llm.neardup import word_table

WINDOW = 10
SUPPORT = 3
SURE = 1.645
GENERALISE = 1.0
REMOVE = 0.15

#: Forms are looked for around digits, ``@``, ``=`` and the beginnings of keys, of which every form has one: in the run of
#: non-blank bytes that it stands in, however long, and so many bytes on either side, more than the parts of a form before and behind it take.
AROUND = 96

_GAP = rb"[^0-9A-Za-z\n]{0,5}"
_BYTE = rb"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_VALUE = rb"[A-Za-z0-9_./+!#$%^&*~?@\x80-\xff-]"
_FORMS = [
    ("EMAIL", rb"(?<![A-Za-z0-9._%+\x80-\xff-])[A-Za-z0-9_\x80-\xff][A-Za-z0-9._%+\x80-\xff-]*@(?:[A-Za-z0-9\x80-\xff][A-Za-z0-9\x80-\xff-]*\.)+[A-Za-z]{2,}"),
    ("SECRET", rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("SECRET", rb"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,})"),
    ("SECRET", rb"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?" + _GAP.replace(b"5", b"2") + rb"[:=]" + _GAP + rb"(?=" + _VALUE.replace(b"0-9", b"") + rb"*[0-9])" + _VALUE + rb"{6,}[\"']?"),
    ("SECRET", rb"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"),
    ("IP", rb"(?<![0-9.])(?:" + _BYTE + rb"\.){3}" + _BYTE + rb"(?![0-9])(?!\.[0-9])"),
    ("IP", rb"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ACCOUNT", rb"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("PHONE", rb"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}" + _GAP + rb")?\([0-9]{2,4}\)" + _GAP + rb"[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("PHONE", rb"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("PHONE", rb"(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])(?![.-][0-9])"),
    ("ID", rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("CARD", rb"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9A-Za-z])"),
]


def _compile() -> tuple[re.Pattern, list[str]]:
    parts, kinds, group = [], {}, 0
    for kind, form in _FORMS:
        group += 1
        own = re.sub(rb"\\1", rb"\\" + str(group + 1).encode(), form)
        parts.append(b"(" + own + b")")
        kinds[group] = kind
        group += re.compile(form).groups
    return re.compile(b"|".join(parts)), [kinds.get(k, "") for k in range(group + 1)]


_FORM, _KINDS = _compile()
_HOT = np.zeros(256, np.uint8)
_HOT[48:58] = 1
_HOT[[ord("@"), ord("=")]] = 1
_KEYS = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"sk-", b"xoxa-", b"xoxb-", b"xoxp-", b"xoxr-", b"xoxs-", b"eyJ")
for _key in _KEYS:
    _HOT[_key[-1]] = 2  # hot only behind the rest of its key
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _hot(data: np.ndarray) -> np.ndarray:
    """Places of bytes that a form can be around."""
    kind = _HOT[data]
    hot = np.flatnonzero(kind)
    maybe = kind[hot] == 2
    at = hot[maybe]
    real = np.zeros(len(at), bool)
    for key in _KEYS:
        own = np.flatnonzero((data[at] == key[-1]) & (at >= len(key) - 1))
        for back, byte in enumerate(reversed(key[:-1]), 1):
            own = own[data[at[own] - back] == byte]
        real[own] = True
    keep = np.ones(len(hot), bool)
    keep[maybe] = real
    return hot[keep]


def entities(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) of every protected entity, in order; places are in ``data``."""
    hot = _hot(data)
    if not len(hot):
        return []
    row = np.searchsorted(offsets, hot, side="right") - 1
    # the run of non-blank bytes around each, and AROUND on either side, within the row
    blank = np.flatnonzero(_SPACES[data])
    after = np.searchsorted(blank, hot)
    edge = np.concatenate([[-1], blank, [len(data)]])
    low = np.maximum(edge[after] + 1 - AROUND, offsets[row])
    high = np.minimum(edge[after + 1] + AROUND, offsets[row + 1])
    new = np.ones(len(hot), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] > high[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hot)) - 1
    out, at, text = [], -1, b""
    for r, a, z in zip(row[first].tolist(), low[first].tolist(), high[last].tolist()):
        if r != at:
            at, begin = r, int(offsets[r])
            text = data[begin : offsets[r + 1]].tobytes()
        for m in _FORM.finditer(text, a - begin, z - begin):
            out.append((r, begin + m.start(), begin + m.end(), _KINDS[m.lastindex]))
    return out


def _entity(kind: str, raw: bytes) -> int:
    return xxhash.xxh64_intdigest(kind.encode() + b"\0" + raw.lower()) - (1 << 63)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_parts(column)
    for low, high in spans(offsets):
        part = offsets[low : high + 1]
        yield low, high, data[part[0] : part[-1]], part - part[0]


def _surroundings(window: int):
    """Of each text with entities (key, size, entities, arounds, terms): its entities, a hash of the words near each, and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for low, _, data, offsets in _parts(b.column(2)):
                found = entities(data, offsets)
                if not found:
                    continue
                rows = sorted({r for r, *_ in found})
                pieces = [data[offsets[r] : offsets[r + 1]] for r in rows]
                own, at = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
                place = {r: k for k, r in enumerate(rows)}
                hashes, start, end, counts = word_table(own, at)
                edge = np.concatenate([[0], np.cumsum(counts)])
                moved = [(place[r], s - int(offsets[r]) + int(at[place[r]]), e - int(offsets[r]) + int(at[place[r]]), kind) for r, s, e, kind in found]
                free = np.ones(len(hashes), bool)
                reach = []
                for k, s, e, kind in moved:
                    a, z = int(np.searchsorted(end, s, side="right")), int(np.searchsorted(start, e))
                    free[a:z] = False
                    reach.append((a, z))
                seen: dict[tuple[int, int], list[np.ndarray]] = {}
                for (k, s, e, kind), (a, z) in zip(moved, reach):
                    name = _entity(kind, own[s:e].tobytes())
                    before, after = np.arange(max(int(edge[k]), a - window), a), np.arange(z, min(int(edge[k + 1]), z + window))
                    near = np.concatenate([before, after])
                    seen.setdefault((k, name), []).append(hashes[near[free[near]]])
                names: list[list[int]] = [[] for _ in rows]
                arounds: list[list[int]] = [[] for _ in rows]
                for (k, name), near in seen.items():
                    words = np.concatenate(near)
                    with np.errstate(over="ignore"):
                        around = int(mix64(words + np.arange(len(words), dtype=np.uint64)).sum(dtype=np.uint64))
                    names[k].append(name)
                    arounds[k].append(around - (1 << 63))
                terms = [np.unique(hashes[x:y][free[x:y]]).view(np.int64) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
                line = np.array(rows) + low
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[line]), pa.array(sizes[line]), pa.array(names, longs), pa.array(arounds, longs), pa.array(terms, longs)], names=["key", "size", "entities", "arounds", "terms"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents that hold each term; term 0 counts all documents."""
    for b in batches:
        for low, high, data, offsets in _parts(b.column(0)):
            hashes, _, _, counts = word_table(data, offsets)
            row = np.repeat(np.arange(high - low), counts)
            order = np.argsort(hashes, kind="stable")
            h, r = hashes[order], row[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h = h[once]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            there = high - low - b.column(0).slice(low, high - low).null_count
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[first].view(np.int64), 0)), pa.array(np.append(n, there).astype(np.int64))], names=["term", "n"])


def disclosures(docs: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, hidden, removed) of terms that reveal an entity, ``hidden`` being the bits that stay; and (key, size, entity, term) of the texts that hold both.

    ``entity`` stands for all entities that the same documents hold. The second table has the terms that are rare enough to reveal."""
    bounded_batches(docs.sparkSession)
    text = column(text_col).cast("string")
    keyed = docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"), text.alias("text")).where("text is not null")
    found = materialize(keyed.mapInArrow(_surroundings(window), "key bigint, size int, entities array<bigint>, arounds array<bigint>, terms array<bigint>"), "surroundings")
    each = found.select("key", "size", F.explode(F.arrays_zip("entities", "arounds")).alias("at")).select("key", "size", F.col("at.entities").alias("name"), F.col("at.arounds").alias("around"))
    # a class is the entities of the same documents: as many, and of the same texts
    classes = each.groupBy("name").agg(F.count("*").alias("n_entity"), F.sum(F.xxhash64("key", "size").cast("decimal(38,0)")).alias("texts")).select("name", "n_entity", F.xxhash64("n_entity", "texts").alias("entity"))
    held = each.distinct().join(classes, "name").groupBy("key", "size", "entity").agg(F.max("n_entity").alias("n_entity"), F.sum(F.xxhash64("name", "around").cast("decimal(38,0)")).alias("around"))
    held = materialize(held.withColumn("around", F.xxhash64("around")), "entities-of-texts")
    most = held.groupBy("key", "size").agg(F.max("n_entity").alias("most"))
    counts = docs.select(text.alias("text")).mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = materialize(counts, "document-frequency")
    total = counts.where("term = 0").select(F.col("n_term").alias("n_all"))
    # a term of more than 2^generalise documents for each of the entity's can't leave so few bits
    ratio = 2.0**generalise * (1 + 1e-9)
    terms = found.groupBy("key", "size").agg(F.first("terms").alias("terms"), F.count("*").alias("copies")).join(most, ["key", "size"])
    rare = terms.select("key", "size", "copies", "most", F.explode("terms").alias("term")).join(counts.where("term <> 0"), "term").where(F.col("n_term") <= F.col("most") * ratio)
    pairs = materialize(rare.join(held, ["key", "size"]).where(F.col("n_term") <= F.col("n_entity") * ratio).select("key", "size", "copies", "entity", "term", "around", "n_term", "n_entity"), "co-occurrence")
    both = pairs.groupBy("entity", "term", "n_term", "n_entity", "around").agg(F.sum("copies").alias("n")).groupBy("entity", "term", "n_term", "n_entity").agg(F.sum("n").alias("together"), F.count("*").alias("arounds"))
    joined = both.crossJoin(F.broadcast(total))  # one row
    known = F.log2(F.col("n_all") / F.col("n_entity"))
    pointwise = F.log2(F.col("together") * F.col("n_all").cast("double") / F.col("n_entity") / F.col("n_term"))
    sure = (F.col("arounds") >= support) | (pointwise > SURE / np.log(2) / F.sqrt("together"))
    scored = joined.where(sure).select("entity", "term", known.alias("ic"), (known - pointwise).alias("hidden")).where(f"ic > 0 and hidden <= {generalise}")
    return scored.select("entity", "term", "hidden", (F.col("hidden") <= remove).alias("removed")), pairs.select("key", "size", "entity", "term")


def _general(word: np.ndarray) -> bytes:
    """What kind of term a word is: the more general term that takes its place."""
    digit = (word >= 48) & (word <= 57)
    if digit.any():
        return b"[NUMBER]" if digit.all() else b"[CODE]"
    capital = 65 <= word[0] <= 90 or len(word) > 1 and word[0] == 0xC3 and 0x80 <= word[1] <= 0x9E
    return b"[NAME]" if capital else b"[WORD]"


def rewrite(texts: pa.Array, terms: pa.Array | None = None, removed: pa.Array | None = None) -> tuple[list[bytes | None], np.ndarray]:
    """Each text without its entities and revealing terms (None: as it was), and counts of (entities, generalised, removed)."""
    out: list[bytes | None] = [None] * len(texts)
    counts = np.zeros((len(texts), 3), np.int64)
    for low, high, data, offsets in _parts(texts):
        found: dict[int, list[tuple[int, int, bytes]]] = {}
        for r, s, e, kind in entities(data, offsets):
            found.setdefault(r, []).append((s, e, f"[{kind}]".encode()))
            counts[low + r, 0] += 1
        for r, cuts in found.items():
            reveal = terms[low + r].as_py() if terms is not None else None
            begin, end = int(offsets[r]), int(offsets[r + 1])
            if reveal:
                own = data[begin:end]
                hashes, start, stop, _ = word_table(own, np.array([0, len(own)]))
                gone = dict(zip(reveal, removed[low + r].as_py()))
                hit = np.flatnonzero(np.isin(hashes.view(np.int64), np.array(list(gone), np.int64)))
                taken = [(s, e) for s, e, _ in cuts]
                for k in hit.tolist():
                    s, e = begin + int(start[k]), begin + int(stop[k])
                    if any(s < z and a < e for a, z in taken):
                        continue
                    gone_now = gone[int(hashes[k].view(np.int64))]
                    counts[low + r, 2 if gone_now else 1] += 1
                    cuts.append((s, e, b"" if gone_now else _general(data[s:e])))
                cuts.sort()
            made, at = [], begin
            for s, e, put in cuts:
                made += [data[at:s].tobytes(), put]
                at = e
            out[low + r] = b"".join([*made, data[at:end].tobytes()])
    return out, counts


def _rewritten(texts: pa.Array, terms: pa.Array, removed: pa.Array) -> pa.Array:
    made, counts = rewrite(texts, terms, removed)
    if any(x is not None for x in made):
        old = texts.to_pylist()
        texts = pa.array([o if x is None else x.decode("utf-8", "replace") for x, o in zip(made, old)], pa.string())
    elif texts.type != pa.string():
        texts = texts.cast(pa.string())
    return pa.StructArray.from_arrays([texts, *(pa.array(counts[:, k]) for k in range(3))], names=["text", "n_entities", "n_generalised", "n_removed"])


def _holds(texts: pa.Array) -> pa.Array:
    """Whether each text has an entity."""
    out = np.zeros(len(texts), bool)
    for low, _, data, offsets in _parts(texts):
        out[[low + r for r in {r for r, *_ in entities(data, offsets)}]] = True
    return pa.array(out)


def _added(docs: DataFrame, name: str, text_col: str, **thresholds) -> DataFrame:
    """Add struct column ``name``: (text, n_entities, n_generalised, n_removed)."""
    found, held = disclosures(docs, text_col, **thresholds)
    per_text = held.join(found, ["entity", "term"]).groupBy("key", "size", "term").agg(F.max("removed").alias("removed"))
    per_text = per_text.groupBy("key", "size").agg(F.collect_list(F.struct("term", "removed")).alias("terms"))
    key, size, terms = (fresh([*docs.columns, name], x) for x in ("text_key", "text_size", "text_terms"))
    per_text = materialize(per_text.toDF(key, size, terms), "text-terms")
    text = column(text_col).cast("string")
    made = F.arrow_udf(_rewritten, "text string, n_entities bigint, n_generalised bigint, n_removed bigint").asNondeterministic()
    holds = F.arrow_udf(_holds, "boolean")(text)
    # texts without entities have no terms to look up, so they aren't shuffled
    joined = docs.where(holds).withColumn(key, F.xxhash64(text)).withColumn(size, F.octet_length(text)).join(per_text, [key, size], "left")
    some = joined.withColumn(name, made(text, F.col(f"{terms}.term"), F.col(f"{terms}.removed"))).drop(key, size, terms)
    none = F.struct(text.alias("text"), *(F.lit(0).cast("bigint").alias(n) for n in ("n_entities", "n_generalised", "n_removed")))
    return some.unionByName(docs.where(~F.coalesce(holds, F.lit(False))).withColumn(name, none))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, text, n_entities, n_generalised, n_removed) of every row."""
    return _added(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "made", "text", **thresholds).select("doc_id", "made.*")


def sanitised(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", **thresholds) -> DataFrame:
    """The rows of ``docs`` with their texts, and the numbers of characters in ``size_col`` of changed ones, replaced."""
    name = fresh(docs.columns, "sanitised_text")
    out = _added(docs, name, text_col, **thresholds)
    made = column(name)
    if size_col in docs.columns:
        changed = made["text"] != column(text_col)
        out = out.withColumn(size_col, F.when(changed, F.length(made["text"])).otherwise(column(size_col)).cast(docs.schema[size_col].dataType))
    return out.withColumn(text_col, made["text"]).select(*(column(c) for c in docs.columns))
