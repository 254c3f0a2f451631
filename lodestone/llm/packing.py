"""Best-fit packing of documents into sequences of equal capacity by linear grouping.

A document's length is the number of ids that the SentencePiece codec gives its text, and one for the id that ends it;
documents over ``capacity`` are cut into full pieces and a rest. Lengths are whole numbers up to ``capacity``, so their histogram, which is all that is
brought to the driver, has at most ``capacity`` entries however many documents there are. On it

1. pieces over ``capacity / SMALL`` are sorted by falling length and cut into ``GROUPS`` groups of equal cardinality;
   within a group lengths are rounded up to the largest, which leaves few sizes;
2. a linear program over the ways to fill a bin with those sizes is solved by column generation (a knapsack finds the
   next way), rounded down, and what is left over is packed by best fit;
3. actual pieces take the places of their rounded sizes: the piece of rank ``r`` has a place that follows from ``r``
   by arithmetic, so each row finds its bin by itself;
4. small pieces, longest first, go to the bin with the least room that holds them. Pieces of one length and bins of
   one room are as good as each other, so this too is worked off in runs on the histogram of the room left, and each
   row finds its bin by its rank.

Ranks within a length come from a window over (hash bucket, length) and prefix sums over buckets, so no task holds all
pieces of a common length.

Defined cases: a null or empty text has the end token alone; null and repeated ids are packed like others,
a row at a time; equal lengths are told apart by id; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import Scratch
from lodestone.llm.sentencepiece_codec import counts, read_model

CAPACITY = 2048
SMALL = 8
GROUPS = 32
BUCKETS = 1024
#: Runs of ranks that are broadcast, some 10 MB; more are joined by their lengths.
RUNS = 1 << 17

_RUNS = "struct<low:bigint,high:bigint,room:bigint,first:bigint,each:bigint>"
Run = tuple[int, int, int, int, int]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """(doc_id, piece, start, length) of each document's runs of at most ``capacity`` ids."""
    rows = counts(docs, model or read_model(), id_col, text_col).select("doc_id", (F.col("n_tokens") + 1).alias("tokens"))
    last = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("bigint") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("bigint").alias("length"))


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... among those with equal ``by``."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = bucketed.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(by, "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    own = bucketed.withColumn("own", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order)) - 1)
    return own.join(bases, [by, "bucket"]).withColumn("rank", F.col("base") + F.col("own")).drop("bucket", "base", "own")


def _fill(room: int, sizes: list[int], worth: np.ndarray) -> tuple[float, list[int]]:
    """Most worth of sizes that fit into ``room``, each any number of times, and how many of each."""
    best = np.zeros(room + 1)
    levels, most = [], room // min(sizes)
    for _ in range(most):
        options = np.stack([np.concatenate([np.full(s, -np.inf), best[: room + 1 - s] + w]) for s, w in zip(sizes, worth)])
        pick = options.argmax(axis=0)
        better = options[pick, np.arange(room + 1)]
        take = better > best
        levels.append(np.where(take, pick, -1))
        best = np.where(take, better, best)
    counts, at = [0] * len(sizes), room
    for picked in reversed(levels):
        if picked[at] >= 0:
            counts[picked[at]] += 1
            at -= sizes[picked[at]]
    return float(best[room]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Ways to fill bins and how often each is used, which together hold each size exactly as often as demanded."""
    k = len(sizes)
    if not k:
        return []
    d = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(60 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, way = _fill(capacity, sizes, np.maximum(worth, 0))
        if value <= 1 + 1e-7:
            break
        step, have = np.linalg.solve(basis, np.array(way, float)), np.linalg.solve(basis, d)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(have, 0) / step, np.inf)
        basis[:, int(ratio.argmin())] = way
    used: Counter = Counter()
    left = list(demand)
    for j, x in enumerate(np.linalg.solve(basis, d)):
        way = [int(round(v)) for v in basis[:, j]]
        n = min([max(0, int(np.floor(x + 1e-9))), *(left[i] // a for i, a in enumerate(way) if a)])
        used[tuple(way)] += n
        left = [have - n * a for have, a in zip(left, way)]
    while any(left):  # a few bins for what rounding left over, filled as well as can be, the same way as often as it goes
        way, room = [0] * k, capacity
        for i in sorted(range(k), key=lambda i: -sizes[i]):
            way[i] = min(left[i], room // sizes[i])
            room -= way[i] * sizes[i]
        n = min(left[i] // a for i, a in enumerate(way) if a)
        used[tuple(way)] += n
        left = [have - n * a for have, a in zip(left, way)]
    return [(list(way), n) for way, n in used.items() if n]


def place_large(hist: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[dict[int, list[Run]], int]:
    """For each length, runs (low, high, -1, first, each): rank ``r`` goes to bin ``first + (r - low + offset) // each``.

    ``first`` and the offset are folded together by cutting runs where a bin begins. Also the number of bins.
    """
    lengths = sorted(hist, reverse=True)
    total = sum(hist.values())
    if not total:
        return {}, 0
    per = -(-total // groups)
    spots: list[tuple[int, int, int, int]] = []  # (length, lowest rank, how many, rounded size)
    size, seen = 0, 0
    for n in lengths:
        at = 0
        while at < hist[n]:
            if seen % per == 0:
                size = n
            take = min(hist[n] - at, per - seen % per)
            spots.append((n, at, take, size))
            at, seen = at + take, seen + take
    sizes = sorted({s for *_, s in spots}, reverse=True)
    demand = [sum(t for *_, t, s in spots if s == size) for size in sizes]
    ways = configurations(sizes, demand, capacity)
    bins = sum(n for _, n in ways)
    runs: dict[int, list[Run]] = {}
    for i, size in enumerate(sizes):
        own = [[n, low, take] for n, low, take, s in spots if s == size]
        first = 0
        for way, times in ways:
            need = way[i] * times
            done = 0
            while done < need:
                n, low, take = own[0]
                take = min(take, need - done)
                # place ``done`` is in bin first + done // each
                each, at = way[i], done
                while at < done + take:
                    stop = done + take if at % each == 0 else min(done + take, at - at % each + each)
                    runs.setdefault(n, []).append((low + at - done, low + stop - done, -1, first + at // each, each))
                    at = stop
                done += take
                own[0][1] += take
                own[0][2] -= take
                if not own[0][2]:
                    own.pop(0)
            first += times
    return runs, bins


def place_small(hist: dict[int, int], rooms: dict[int, int], capacity: int) -> dict[int, list[Run]]:
    """For each length, runs (low, high, room, first, each): rank ``r`` goes to bin ``first + (r - low) // each`` of those that had ``room`` at first.

    Exactly the result of best fit one by one, longest first; ``room`` is ``capacity`` of bins that are opened for it.
    """
    # bins as (room now, room at first, rank from, rank to), by room; a bin that is opened has at first room for all
    bins = sorted((r, r, 0, n) for r, n in rooms.items() if r > 0 and n)
    opened = 0
    runs: dict[int, list[Run]] = {}
    for length in sorted(hist, reverse=True):
        low, n = 0, hist[length]
        while low < n:
            k = bisect_left(bins, (length,))
            if k < len(bins):
                room, born, first, last = bins.pop(k)
            else:
                room, born, first = capacity, -1, opened
                last = opened = opened + -(-(n - low) // (capacity // length))
            each = room // length
            full = min(last - first, (n - low) // each)
            if full:
                runs.setdefault(length, []).append((low, low + full * each, born, first, each))
                low += full * each
                if room - each * length:
                    insort(bins, (room - each * length, born, first, first + full))
                first += full
            if first < last and low < n:  # the last of this length, fewer than fill a bin
                rest = n - low
                runs.setdefault(length, []).append((low, n, born, first, rest))
                insort(bins, (room - rest * length, born, first, first + 1))
                low, first = n, first + 1
            if first < last:
                insort(bins, (room, born, first, last))
    return runs


def _with_runs(rows: DataFrame, runs: dict[int, list[Run]]) -> DataFrame:
    """Join each row to the run of its length that holds its rank."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(n), [tuple(map(int, r)) for r in own]) for n, own in runs.items()], f"run_length bigint, runs array<{_RUNS}>")
    flat = table.select("run_length", F.inline("runs"))
    # a few runs for each of at most ``capacity`` lengths, whatever the number of documents
    flat = F.broadcast(flat) if sum(map(len, runs.values())) <= RUNS else flat
    return rows.join(flat, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop("run_length", "high")


def pack(docs: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """(bin_id, doc_id, piece, start, length): ids ``start`` to ``start + length`` of the document are in the bin."""
    scratch = Scratch()
    cut = scratch.keep(pieces(docs, capacity, id_col, text_col, model), "pieces")  # read twice, and texts are encoded once
    rows = scratch.keep(ranked(cut, "length", "doc_id", "piece"), "ranked-pieces")
    hist = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity entries at most
    limit = capacity // small
    large, bins = place_large({n: c for n, c in hist.items() if n > limit}, capacity, groups)
    columns = ["bin_id", "doc_id", "piece", "start", "length"]
    put = _with_runs(rows.where(F.col("length") > limit), large)
    put = put.withColumn("bin_id", F.expr("first + floor((rank - low) / each)").cast("bigint"))
    filled = put.groupBy("bin_id").agg((F.lit(capacity) - F.sum("length")).cast("bigint").alias("room"))
    filled = scratch.keep(ranked(filled.where("room > 0"), "room", "bin_id").withColumnRenamed("rank", "bin_rank"), "rooms")
    rooms = {r.room: r.n for r in filled.groupBy("room").agg(F.count("*").alias("n")).collect()}  # as above
    runs = place_small({n: c for n, c in hist.items() if n <= limit}, rooms, capacity)
    rest = _with_runs(rows.where(F.col("length") <= limit), runs).withColumn("bin_rank", F.expr("first + floor((rank - low) / each)").cast("bigint"))
    into = rest.where("room >= 0").join(filled, ["room", "bin_rank"])
    opened = rest.where("room < 0").withColumn("bin_id", F.col("bin_rank") + bins)
    return scratch.finish(put.select(*columns).union(into.select(*columns)).union(opened.select(*columns)), "bins")
