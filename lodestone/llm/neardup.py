"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document's set is its runs of ``SHINGLE`` words (a shorter document has one run of all its words).
Words are maximal runs of letters and digits, ASCII and Latin-1 letters in lower case; punctuation and spaces beyond
ASCII end a word too, and characters of scripts that are written without spaces are a word each.
Each element permutes the signature's positions; position ``p`` takes the least ``rank + fraction`` over all
elements, where ``rank`` is the place of ``p`` in an element's permutation. Ranks are worked off one after the
other for all elements at once, and a document drops out as soon as all its positions are taken: a position
taken at a rank can't be improved by a later one, which is SuperMinHash's early stop.

Documents of equal word sequences are one text. Two texts that share a band (``ROWS`` equal positions) are candidates;
they are joined when at least ``threshold`` of their positions agree. Groups are the connected components.

A band that many texts share makes a large bucket. One of over ``BUCKET`` texts is cut into parts by a hash, each part
is compared in itself by a task of its own, and components are formed; where that leaves a bucket with texts of more
than one component, its parts are compared with each other, pair by pair of parts, without the pairs that are joined
already. So no task holds a bucket of any size, and the groups are those of comparing every pair of every bucket.

Defined cases: a null or wordless text is in no set, so such rows stay alone; a document id that occurs in several rows
is one document, tied to every text it has; null ids are dropped; an empty table gives an empty result. Only the id
and text columns are read, so other columns can have any name. ``dedup`` keeps one row of each group: of an id that
occurs in several rows the one with the least text; rows with a null id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded_batches, column, fresh, materialize, mix64, spans, text_parts

SHINGLE = 3
BANDS = 40
ROWS = 3
THRESHOLD = 0.4
BUCKET = 4096
#: Ids that ``dedup`` broadcasts.
LISTED = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_FOLD = np.zeros(256, np.uint64)
for _b in range(256):
    _ch = chr(_b)
    if _b >= 128 or _ch.isascii() and _ch.isalnum():
        _FOLD[_b] = ord(_ch.lower()) if _b < 128 else _b
#: First bytes of characters that may be no part of a word, or a word by themselves.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, *range(0xE0, 0xEA), 0xEF, 0xF0]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = _powers[0] = (tables[0], tables[1])
    return have


def _special(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of UTF-8 that belong to separators, and first bytes of characters that are words by themselves."""
    lead = np.flatnonzero(_LEAD[data])
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
    two = (a == 0xC2) & (b != 0xAA) & (b != 0xB5) & (b != 0xBA)
    three = (a == 0xE2) & (b <= 0xAF) & ~((b == 0x80) & ((c == 0x8C) | (c == 0x8D)))
    three |= (a == 0xE3) & (b == 0x80) & ((c < 0x85) | (c > 0x87))
    three |= (a == 0xEF) & ((b == 0xBC) & ((c <= 0x8F) | ((c >= 0x9A) & (c <= 0xA0)) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | ((c >= 0x9B) & (c <= 0xA5))))
    gone = np.concatenate([lead[two], lead[two] + 1, lead[three], lead[three] + 1, lead[three] + 2])
    alone = (a >= 0xE3) & (a <= 0xE9) & ~three
    alone |= (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    alone |= (a == 0xE1) & ((b == 0x80) | (b == 0x81) | (b == 0x82) & (c <= 0x9F) | (b == 0x9E) | (b == 0x9F))
    alone |= (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)
    alone |= (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    return gone[gone < len(data)], lead[alone]


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, where it starts and ends, and how many words each row has."""
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(rows, np.int64)
    folded = _FOLD[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
    folded[capital] += np.uint64(0x20)
    gone, alone = _special(data)
    folded[gone] = 0
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if len(alone):
        after = alone + np.where(data[alone] == 0xF0, 4, 3)
        first[alone] = True
        after = after[after < len(data)]
        first[after] = inside[after]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(folded * power[: len(data)], out=sums[1:])
    hashes = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _GOLD)
    place = np.searchsorted(start, offsets)
    return hashes, start, end, np.diff(place)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, counts = word_table(data, offsets)
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words and the row it belongs to."""
    runs = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    row = np.repeat(np.arange(len(counts)), runs)
    begin = np.cumsum(counts) - counts
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + begin[row]
    left = (begin + counts)[row] - at
    h = np.zeros(len(row), np.uint64)
    for k in range(width):
        there = left > k
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(k + 1)) if len(words) else h)
    return h, row


def superminhash(elements: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Signatures of ``rows`` sets as a (rows, size) matrix of 32-bit values; a row without elements keeps all ones."""
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(rows * size, free, np.uint64)
    swaps: list[np.ndarray] = []
    for rank in range(size):
        if not len(elements):
            break
        x = mix64(elements + np.uint64((rank + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        swap = (np.uint64(rank) + (((x >> np.uint64(32)) * np.uint64(size - rank)) >> np.uint64(32))).astype(np.int64)
        position = swap.copy()
        for t in range(rank - 1, -1, -1):  # what earlier swaps left at that place
            position = np.where(swaps[t] == position, t, position)
        swaps.append(swap)
        # a position that an earlier rank took holds a smaller value and stays
        np.minimum.at(best, row * size + position, (np.uint64(rank) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        open_row = (best.reshape(rows, size) == free).any(axis=1)
        keep = open_row[row]
        if not keep.all():
            elements, row = elements[keep], row[keep]
            swaps = [s[keep] for s in swaps]
    rank_of = (best >> np.uint64(32)).astype(np.uint32)
    return ((best & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (rank_of * np.uint32(0x9E3779B9))).reshape(rows, size)


def signatures(texts: pa.Array, width: int = SHINGLE, size: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its number of words, a hash of its word sequence, and its signature."""
    data, offsets = text_parts(texts)
    counts, whole, out = [], [], []
    for low, high in spans(offsets):
        part = offsets[low : high + 1]
        words, n = word_hashes(data[part[0] : part[-1]], part - part[0])
        counts.append(n)
        begin = np.cumsum(n) - n
        within = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, n).astype(np.uint64)
        mixed = mix64(words + within * _GOLD)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        whole.append(mix64(sums[begin + n] - sums[begin] + n.astype(np.uint64)))
        elements, row = shingle_hashes(words, n, width)
        out.append(superminhash(elements, row, len(n), size))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, size), np.uint32)
    return np.concatenate(counts), np.concatenate(whole), np.concatenate(out)


def _sign(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, whole, sig = signatures(b.column(1), width, size)
            keep = words > 0
            # 16 bits of each value are kept: unequal values agree once in 65,536
            packed = (sig[keep] >> np.uint32(7)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(keep)), pa.array(whole[keep].view(np.int64)), pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["id", "text", "sig"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    return data.view(np.uint16).reshape(n, -1) if n else np.zeros((0, 1), np.uint16)


def _band(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column(1)).reshape(b.num_rows, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, sig.shape[:2])
            for r in range(rows):
                key = mix64(key + sig[:, :, r] + np.uint64(r + 1))
            times = np.repeat(np.arange(b.num_rows), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), b.column(0).take(pa.array(times))], names=["key", "text"])

    return run


#: Texts of one band that are held at once; a band with more is given out in pieces under its own name.
_HELD = 1 << 20


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) in order of their keys to (bucket, text) of keys with several texts. A bucket is named by its texts, so that bands with the same ones are one bucket."""
    keys, texts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    flushed: int | None = None  # a key of which pieces were given out

    def close(keys: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(start, len(keys)))
        with np.errstate(over="ignore"):
            name = mix64(np.add.reduceat(mix64(texts.view(np.uint64) ^ _GOLD), start) + mix64(np.bitwise_xor.reduceat(mix64(texts.view(np.uint64)), start)) + size.astype(np.uint64)).view(np.int64)
        own = keys[start] == flushed if flushed is not None else np.zeros(len(start), bool)
        name[own] = keys[start][own]
        some = np.repeat((size > 1) | own, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[some]), pa.array(texts[some])], names=["bucket", "text"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, texts = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([texts, b.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield close(keys[:cut], texts[:cut])
            keys, texts = keys[cut:], texts[cut:]
        if len(keys) > _HELD:
            flushed = int(keys[0])
            yield close(keys, texts)
            keys, texts = keys[:0], texts[:0]
    if len(keys):
        yield close(keys, texts)


class _Forest:
    """Union-find over positions, the least position being the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, pairs: np.ndarray) -> None:
        up = self.up
        for a, b in pairs.tolist():
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)


def verified(ids: np.ndarray, sig: np.ndarray, least: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Joins within one bucket, as (member, root) pairs.

    Every pair that isn't joined already (by ``known`` roots, if they are given) is compared, so the result is that of comparing all pairs.
    """
    order = np.argsort(ids, kind="stable")
    ids, sig = ids[order], sig[order]
    n = len(ids)
    forest = _Forest(n)
    lead = np.zeros(n, np.int64) - 1
    todo = np.arange(n)
    if known is not None:
        _, start, which = np.unique(known[order], return_index=True, return_inverse=True)
        lead, todo = start[which], todo[:0]
    while len(todo):  # each round, all that is left is held against its first
        hit = (sig[todo] == sig[todo[0]]).sum(axis=1) >= least
        hit[0] = True
        lead[todo[hit]] = todo[0]
        todo = todo[~hit]
    forest.up = lead.copy()
    if (lead != 0).any():  # members of different leads can agree all the same
        step = max(1, (4 << 20) // (n * sig.shape[1]))
        for low in range(0, n, step):
            roots = forest.roots()
            if (roots == roots[0]).all():
                break
            block = np.arange(low, min(n, low + step))
            other = roots[block][:, None] != roots[None, :]
            other &= block[:, None] < np.arange(n)[None, :]
            if other.any():
                a, b = np.nonzero(other)
                same = np.zeros(len(a), bool)
                for k in range(0, len(a), 1 << 15):
                    same[k : k + (1 << 15)] = (sig[block[a[k : k + (1 << 15)]]] == sig[b[k : k + (1 << 15)]]).sum(axis=1) >= least
                forest.join(np.stack([block[a[same]], b[same]], axis=1))
    roots = forest.roots()
    moved = roots != np.arange(n)
    return ids[moved], ids[roots[moved]]


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def close(bucket: np.ndarray, ids: np.ndarray, sig: np.ndarray, *known: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(bucket)) + 1
            start = np.concatenate([[0], edge])
            end = np.concatenate([edge, [len(bucket)]])
            a, b = [], []
            two = start[end - start == 2]
            same = (sig[two] == sig[two + 1]).sum(axis=1) >= least
            pair = np.stack([ids[two[same]], ids[two[same] + 1]], axis=1)
            a.append(pair.max(axis=1, initial=-(1 << 63)))
            b.append(pair.min(axis=1, initial=(1 << 63) - 1))
            for s, e in zip(start.tolist(), end.tolist()):
                if e - s > 2:
                    x, y = verified(ids[s:e], sig[s:e], least, *(k[s:e] for k in known))
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, batch.num_columns)))
            if held is not None:
                now = tuple(np.concatenate([x, y]) for x, y in zip(held, now))
            cut = int(np.searchsorted(now[0], now[0][-1])) if now[0][0] != now[0][-1] else 0
            held = tuple(x[cut:] for x in now)
            if cut:
                yield close(*(x[:cut] for x in now))
        if held is not None:
            yield close(*held)

    return run


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), the root being the least node of the component.

    Alternates large-star and small-star steps until nothing changes. Each takes the least neighbour of every node,
    an aggregate that is formed before anything is shuffled, and joins it to the edges; adaptive execution cuts the
    edges of a node with very many. The table of a round is deleted when the next one is written.
    """
    now = Scratch()
    edges = now.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(nearest.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, Scratch()
        edges = now.keep(small, what)
        last.drop()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _links(texts: DataFrame, members: DataFrame, least: int, scratch: Scratch, most: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of a bucket with ``least`` equal positions. ``texts``: (text, sig); ``members``: (bucket, text)."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    large = scratch.keep(large, "large-buckets")
    name, sig = F.col("bucket"), ("text", "sig")
    if large.isEmpty():
        cut = members.join(texts, "text")
    else:
        members = members.join(large, "bucket", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")))
        cut, name = members.join(texts, "text"), F.when(F.col("part").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "part"))
    grouped = cut.select(name.alias("bucket"), *sig).repartition(parts, "bucket").sortWithinPartitions("bucket")
    edges = grouped.mapInArrow(_verify(least), "a bigint, b bigint")
    if large.isEmpty():
        return edges
    edges = scratch.keep(edges, "edges")
    roots = scratch.keep(components(edges), "roots")
    rooted = members.where("parts is not null").join(roots, members["text"] == roots["node"], "left").select("bucket", "parts", "part", "text", F.coalesce("root", "text").alias("root"))
    rooted = scratch.keep(rooted, "large-members")
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    other = F.explode(F.expr("filter(sequence(0, parts - 1), p -> p <> part)")).alias("other")
    pairs = rooted.join(open_, "bucket", "left_semi").select("bucket", "part", "text", "root", other)
    pairs = pairs.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"), F.lit(1)).alias("bucket"), "text", "root").join(texts, "text")
    crossed = pairs.select("bucket", "text", "sig", "root").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_verify(least), "a bigint, b bigint")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossed)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, group_id, n_links, keep): ``group_id`` is the least id of the document's group, which is the one to keep; ``n_links`` counts the other documents that links lead to."""
    bounded_batches(docs.sparkSession)
    size, scratch = bands * rows, Scratch()
    source = docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).cast("string").alias("text")).where("id is not null")
    signed = scratch.keep(source.mapInArrow(_sign(width, size), "id bigint, text bigint, sig binary"), "signatures")
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = scratch.keep(signed.groupBy("text").agg(F.min("id").alias("first"), F.first("sig").alias("sig")), "texts")
    keyed = texts.select("text", "sig").mapInArrow(_band(bands, rows), "key bigint, text bigint").repartition(parts, "key").sortWithinPartitions("key")
    members = scratch.keep(keyed.mapInArrow(_buckets, "bucket bigint, text bigint").distinct(), "buckets")
    links = _links(texts.select("text", "sig"), members, int(np.ceil(threshold * size - 1e-9)), scratch, bucket)
    # one text stands for an id; where an id has several they are tied together
    firsts = scratch.keep(signed.groupBy("id").agg(F.min("text").alias("text"), F.max("text").alias("last")), "texts-of-ids")
    several = firsts.where("text <> last").select("id", F.col("text").alias("b"))
    if not several.isEmpty():
        links = links.union(signed.join(several, "id").select(F.col("text").alias("a"), "b"))
    roots = scratch.keep(components(links), "roots")
    tied = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    held = texts.select("text", "first").join(firsts.groupBy("text").agg(F.count("*").alias("documents")), "text", "left").fillna(0, "documents")
    tied = tied.join(held.withColumnRenamed("text", "node"), "node")
    tied = tied.join(tied.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("documents").alias("all")), "root").select("node", "group_id", "all")
    of_text = held.join(tied, F.col("text") == F.col("node"), "left").select("text", F.coalesce("group_id", "first").alias("group_id"), F.coalesce("all", "documents").alias("all"))
    found = firsts.select("id", "text").join(of_text, "text").select("id", "group_id", "all")
    everyone = source.select(F.col("id").alias("doc_id")).distinct()
    out = everyone.join(found, everyone["doc_id"] == found["id"], "left")
    out = out.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), (F.coalesce("all", F.lit(1)) - 1).alias("n_links"))
    return scratch.finish(out.withColumn("keep", F.col("doc_id") == F.col("group_id")), "near-duplicates")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group; rows with a null id stay."""
    name, key = fresh(docs.columns, "gone_id"), column(id_col)
    gone = near_duplicates(docs, id_col, text_col, **options).where("not keep").select(F.col("doc_id").alias(name))
    # ids of some 10 MB are broadcast; for more, texts are shuffled once
    gone = F.broadcast(gone) if gone.count() <= LISTED else gone
    left = docs.join(gone, key.cast("bigint") == F.col(name), "left_anti")
    again = docs.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count("*").alias("rows")).where("rows > 1").select(name)
    if again.isEmpty():
        return left
    again = materialize(again, "repeated-ids")
    row = F.struct(*(column(c) for c in docs.columns))
    least = F.struct(F.coalesce(column(text_col).cast("string"), F.lit("")), F.xxhash64(row))
    one = left.join(again, key == F.col(name), "left_semi").groupBy(key.alias(name)).agg(F.min_by(row, least).alias("row")).select("row.*")
    return left.join(again, key == F.col(name), "left_anti").unionByName(one)
