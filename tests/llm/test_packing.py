import numpy as np
import pytest

from lodestone.llm import packing as P
from lodestone.llm import sentencepiece_codec as S

ONE = "the"  # one id each, with the space before it
assert S.codec(S.read_model()).library.encode(" ".join([ONE] * 3)) == [S.codec(S.read_model()).ids[" the"]] * 3


def frame(spark, sizes, ids=None):
    ids = range(len(sizes)) if ids is None else ids
    return spark.createDataFrame([(i, None if n is None else " ".join([ONE] * (n - 1))) for i, n in zip(ids, sizes)], "doc_id bigint, text string")


def best_fit(sizes, capacity):
    """Best fit decreasing, one by one."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def check(rows, sizes, capacity):
    used, seen = {}, {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.length
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert max(used.values(), default=0) <= capacity
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n
    return len(used)


@pytest.mark.parametrize("seed,low,high", [(1, 1, 100), (2, 20, 100), (3, 1, 20), (4, 1, 350), (5, 50, 51)])
def test_every_token_has_one_place_and_bins_are_few(spark, seed, low, high):
    sizes = np.random.default_rng(seed).integers(low, high, 600).tolist()
    rows = P.pack(frame(spark, sizes), 100, groups=16).collect()
    bins = check(rows, sizes, 100)
    least = -(-sum(sizes) // 100)
    cut = [min(100, n - s) for n in sizes for s in range(0, n, 100)]
    # rounding up within a group costs a group's worth of large pieces, rounding the program down a bin a size
    assert bins <= len(best_fit(cut, 100)) * (1 + 1 / 16) + 16
    assert bins >= least


def test_documents_are_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = S.codec(S.read_model()).library
    sizes = {r.doc_id: len(library.encode(r.text)) + 1 for r in docs.collect()}
    rows = P.pack(docs).collect()
    assert len({r.doc_id for r in rows}) == len(sizes)
    assert sum(r.length for r in rows) == sum(sizes.values())
    assert len({r.bin_id for r in rows}) <= sum(sizes.values()) / P.CAPACITY * 1.02 + P.GROUPS


def test_small_pieces_are_best_fit_one_by_one():
    rng = np.random.default_rng(7)
    for _ in range(60):
        rooms = rng.integers(1, 60, rng.integers(0, 12)).tolist()
        sizes = rng.integers(1, 12, rng.integers(1, 60)).tolist()
        want = list(rooms)
        for n in sorted(sizes, reverse=True):
            fits = [k for k, r in enumerate(want) if r >= n]
            if fits:
                want[min(fits, key=lambda k: want[k])] -= n
            else:
                want.append(60 - n)
        hist = {int(n): sizes.count(n) for n in sizes}
        start = {int(r): rooms.count(r) for r in rooms}
        left = {(r, k): r for r, n in start.items() for k in range(n)}
        for length, runs in P.place_small(hist, start, 60).items():
            got = []
            for lo, hi, room, first, each in runs:
                for r in range(lo, hi):
                    key = (room, first + (r - lo) // each)
                    left[key] = left.get(key, 60) - length
                    got.append(r)
            assert sorted(got) == list(range(hist[length]))
        assert min(left.values()) >= 0
        assert sorted(left.values()) == sorted(want)


def test_configurations_meet_the_demand():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = sorted({int(x) for x in rng.integers(13, 101, rng.integers(1, 9))}, reverse=True)
        demand = rng.integers(1, 400, len(sizes)).tolist()
        ways = P.configurations(sizes, demand, 100)
        assert [sum(w[i] * n for w, n in ways) for i in range(len(sizes))] == demand
        assert all(sum(a * s for a, s in zip(w, sizes)) <= 100 for w, _ in ways)
        bins = sum(n for _, n in ways)
        assert bins <= len(best_fit([s for s, n in zip(sizes, demand) for _ in range(n)], 100)) + len(sizes)


def test_large_places_are_distinct():
    hist = {90: 7, 60: 20, 40: 33, 35: 11, 14: 50}
    runs, bins = P.place_large(hist, 100, 4)
    used = np.zeros(bins, int)
    for n, own in runs.items():
        ranks = []
        for lo, hi, _, first, each in own:
            for r in range(lo, hi):
                used[first + (r - lo) // each] += n
                ranks.append(r)
        assert sorted(ranks) == list(range(hist[n]))
    assert used.max() <= 100 and used.min() > 0


def test_edges(spark):
    assert P.pack(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(None, "the the", 1), (None, "the the", 1), (3, None, 2), (3, "", 2), (4, "\n", 9), (5, "the " * 9_999 + "the", 9)], "doc_id bigint, text string, bin_id int")
    rows = P.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.doc_id != 5) == [(0, 3), (0, 3), (3, 1), (3, 1), (4, 3)]
    assert sorted((r.start, r.length) for r in rows if r.doc_id == 5) == [(0, 2048), (2048, 2048), (4096, 2048), (6144, 2048), (8192, 1809)]


def test_equal_lengths(spark):
    rows = P.pack(frame(spark, [30] * 100), 100).collect()
    assert check(rows, [30] * 100, 100) == 34


def test_many_runs_are_joined_without_a_broadcast(spark, monkeypatch):
    sizes = np.random.default_rng(11).integers(1, 90, 200).tolist()
    want = sorted(map(tuple, P.pack(frame(spark, sizes), 100, groups=8).collect()))
    monkeypatch.setattr(P, "RUNS", 0)
    assert sorted(map(tuple, P.pack(frame(spark, sizes), 100, groups=8).collect())) == want
