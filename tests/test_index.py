import numpy as np
import pyarrow as pa
import pytest

from lodestone.functions import vector as V
from lodestone.operators import evaluate as E
from lodestone.operators import index as I
from lodestone.sources import index_files as B


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id bigint, vec array<float>")


@pytest.fixture(scope="module")
def gauss():
    return np.random.default_rng(456).standard_normal((256, 64)).astype(np.float32)


def brute(q, m, k, exclude=None):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit(q.astype(float)) @ unit(m.astype(float)).T
    return [[j for j in np.lexsort((np.arange(len(m)), -r)) if exclude is None or j != exclude[i]][:k] for i, r in enumerate(s)]


def test_basis_vectors(spark):
    built = I.build(frame(spark, np.eye(3), [10, 11, 12]), "int8")
    found = I.search(built, frame(spark, [[1, 0, 0]]), 2).orderBy("rank").collect()
    assert [r.id for r in found] == [10, 11] and found[0].score == pytest.approx(1)
    assert built.count() == 3 and built.dim == 3
    assert built.vector(11).first().vec == [0, 1, 0] and built.vector(99).count() == 0


@pytest.mark.parametrize("mode", ["fp32", "int8", "int16"])
def test_search_against_brute_force(spark, gauss, mode):
    rows = frame(spark, gauss)
    built = I.build(rows, mode)
    queries = frame(spark, gauss[:20] * 3)
    fast = {(r.query_id, r["rank"]): (r.id, r.score) for r in I.search(built, queries, 10).collect()}
    slow = {(r.query_id, r["rank"]): (r.id, r.score) for r in I.search_native(built, queries, 10).collect()}
    assert fast == slow
    want = brute(gauss[:20], gauss, 10)
    assert [fast[q, 1][0] for q in range(20)] == [w[0] for w in want]
    if mode == "fp32":
        assert [[fast[q, r][0] for r in range(1, 11)] for q in range(20)] == want


def test_ties_and_k_beyond_count(spark):
    m = np.array([[1, 0], [1, 0], [0, 1], [1, 0]])
    found = I.search(I.build(frame(spark, m, [7, 3, 1, 5]), "int8"), frame(spark, [[2, 0]]), 9).orderBy("rank").collect()
    assert [r.id for r in found] == [3, 5, 7, 1]
    none = I.search(I.build(frame(spark, m), "int8"), frame(spark, m), 2, exclude_self=True).collect()
    assert all(r.id != r.query_id for r in none) and len(none) == 8


def test_zero_vectors(spark):
    found = I.search(I.build(frame(spark, [[0, 0], [1, 0]]), "fp32"), frame(spark, [[0, 0]]), 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(0, 0.0), (1, 0.0)]


def test_many_blocks(spark, monkeypatch, gauss):
    monkeypatch.setattr(I, "QUERY_ROWS", 7)
    monkeypatch.setattr(I, "CORPUS_ROWS", 13)
    rows = frame(spark, gauss)
    found = {}
    for r in I.search(I.build(rows, "fp32"), rows, 5, exclude_self=True).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.id
    want = brute(gauss, gauss, 5, range(256))
    assert [[found[q][r] for r in range(1, 6)] for q in range(256)] == want


def test_euclidean(spark, gauss):
    rows = frame(spark, gauss)
    found = {}
    for r in I.nearest(rows, rows, 3, "euclidean", exclude_self=True).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.distance)
    d = np.sqrt(((gauss[:, None].astype(float) - gauss[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for q in range(256):
        order = np.argsort(d[q])[:3]
        assert [found[q][r][0] for r in (1, 2, 3)] == order.tolist()
        assert [found[q][r][1] for r in (1, 2, 3)] == pytest.approx(d[q][order].tolist())


def test_errors(spark):
    good = frame(spark, np.eye(3))
    for bad in (frame(spark, np.eye(3), [1, 1, 2]), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, vec array<float>"), spark.createDataFrame([(1, None)], "id int, vec array<float>"), good.limit(0)):
        with pytest.raises(I.VectorError):
            I.build(bad)
    with pytest.raises(I.VectorError):
        I.build(good, dim=4)
    built = I.build(good)
    with pytest.raises(I.VectorError):
        I.search(built, good, 0)
    with pytest.raises(I.VectorError):
        I.search(built, frame(spark, [[1.0, 0.0]]), 1)
    with pytest.raises(ValueError):
        I.build(good, "int4")


@pytest.mark.parametrize("mode", ["fp32", "int8", "int16"])
def test_files(spark, tmp_path, gauss, mode):
    built = I.build(frame(spark, gauss), mode)
    built.save(str(tmp_path / "table"))
    again = I.load(spark, str(tmp_path / "table"))
    assert (again.dim, again.mode, again.count()) == (64, mode, 256)
    size = B.export_exact(built, str(tmp_path / "x.idx"))
    assert size == E.index_size(256, 64, mode) == built.metadata().first().bytes
    raw = (tmp_path / "x.idx").read_bytes()
    ids, codes, kind = B.read_exact(raw)
    assert kind == mode and B.write_exact(ids, codes, mode) == raw
    own = {r.id: r.codes for r in built.table.collect()}
    assert all(own[i] == c.tolist() for i, c in zip(ids.tolist(), codes))
    loaded = B.load_exact(spark, str(tmp_path / "x.idx"))
    assert {r.id: r.codes for r in loaded.table.collect()} == own
    with pytest.raises(B.FormatError):
        B.read_exact(raw[:-1])
    with pytest.raises(B.FormatError):
        B.read_exact(b"ANNG" + raw[4:])
    with pytest.raises(B.FormatError):
        B.write_exact(np.array([1 << 40]), codes[:1], mode)


def test_empty_file_finds_nothing(spark, tmp_path, gauss):
    (tmp_path / "e.idx").write_bytes(B.write_exact(np.zeros(0, np.int64), np.zeros((0, 64), np.float32), "fp32"))
    assert I.search(B.load_exact(spark, str(tmp_path / "e.idx")), frame(spark, gauss[:2]), 3).count() == 0


def test_cache_or_build(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return I.build(frame(spark, np.eye(3)))

    for _ in range(2):
        assert I.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1


def test_recall(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query_id int, id int")
    truth, found = pairs([(1, 1), (1, 2), (2, 5)]), pairs([(1, 2), (1, 3), (1, 4)])
    got = {r.query_id: r.recall for r in E.recall(truth, found).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_sweep(spark, gauss):
    rows = {(r.dim, r.mode): r for r in E.sweep(frame(spark, gauss), [64, 16], ["fp32", "int8"], 5).collect()}
    assert rows[64, "fp32"].recall == 1 and rows[64, "int8"].recall > 0.9 > rows[16, "int8"].recall
    assert rows[16, "int8"].bytes == 20 + 4 * 256 + 256 * 16


def test_most_similar(spark):
    rows = frame(spark, [[1, 0], [0, 1], [1, 0.1], [0, 0]])
    best = E.most_similar(rows).first()
    assert (best.a, best.b) == (0, 2)
    pairs = {(r.a, r.b): r.similarity for r in E.pairwise(rows).collect()}
    assert len(pairs) == 6 and np.isnan(pairs[0, 3]) and pairs[0, 1] == 0
    assert V.bits("q8") == 8


def test_sample_follows_the_seed(spark, gauss):
    rows = frame(spark, gauss)
    one, two = ({r.id for r in E.sample(rows.repartition(n), 20).collect()} for n in (1, 5))
    assert one == two and len(one) == 20 and one != {r.id for r in E.sample(rows, 20, seed=1).collect()}


def test_callbacks(spark, gauss):
    built = I.build(frame(spark, gauss[:20]), "int8")
    total = spark.sparkContext.accumulator(0)
    built.for_each(lambda i, v: total.add(i * len(v)))
    assert total.value == 64 * sum(range(20))
    rows = {r.id: r.value for r in built.map_rows(lambda ids, m: m.sum(axis=1).astype(float)).collect()}
    want = {r.id: sum(r.vec) for r in built.scan().collect()}
    assert rows == pytest.approx(want, abs=1e-5)
    with pytest.raises(Exception, match="stop here"):
        built.for_each(lambda i, v: (_ for _ in ()).throw(ValueError("stop here")))


@pytest.mark.parametrize("mode", ["fp32", "int8", "int16"])
def test_many_files(spark, tmp_path, gauss, mode):
    built = I.build(frame(spark, gauss), mode)
    listed = B.export_exact_files(built, str(tmp_path / "many"), 100).collect()
    assert len(listed) == 3 and sum(r.rows for r in listed) == 256
    rows = {r.id: r.vec for r in B.scan_exact(spark, str(tmp_path / "many")).collect()}
    assert rows == {r.id: r.vec for r in built.scan().collect()}


def test_groups(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 2.0], 7), (3, [3.0, 3.0], 8), (4, None, 8), (5, [0.0, 0.0], 9), (6, [1.0, 1.0], None)], "id bigint, vec array<float>, g int")
    got = {(r.group_a, r.group_b): (r.pairs, r.most) for r in E.similarity_of_groups(rows, "g").collect()}
    half = pytest.approx(0.5**0.5)
    assert got == {(7, 7): (1, 0.0), (7, 8): (2, half), (7, 9): (2, None), (8, 9): (1, None)}


def test_argmax_pair(spark):
    rows = lambda m: frame(spark, m, range(5, 5 + len(m)))
    assert tuple(E.argmax_pair(rows([[1, 0], [1, 1], [1, 1], [2, 2]])).first()) == (6, 7, pytest.approx(1))
    assert tuple(E.argmax_pair(rows([[1, 0], [-1, 0], [0, 1]])).first()) == (5, 5, 0.0)
    assert E.argmax_pair(rows([[1, 0]]).limit(0)).count() == 0


def _odd_rows(n=700):
    """(id, vec, group): ids in no order and negative, copies, turned and zero vectors, groups of unequal size."""
    rng = np.random.default_rng(5)
    m = np.round(rng.standard_normal((n, 6)), 2).astype(np.float32)
    m[50:60], m[60:63], m[63] = m[0], 0, -m[0]
    ids = rng.permutation(n) * 3 - 500
    return [(int(i), v.tolist(), int(g)) for i, v, g in zip(ids, m, rng.integers(0, 4, n) * (np.arange(n) % 5 > 0) - 1)]


def test_pairs_are_sifted_without_loss(spark, monkeypatch):
    """Only what may be among the best is summed in double precision: far fewer than all pairs, on blocks whose ids overlap or not."""
    rows = _odd_rows()
    count = 0
    exact, whole = E._cosines, [(np.array(v, np.float64), i, g) for i, v, g in rows]
    want = []
    for x, i, g in whole:
        for y, j, h in whole:
            if i < j and x.any() and y.any():
                want.append((float(np.add.accumulate(x * y)[-1] / (np.sqrt(np.add.accumulate(x * x)[-1]) * np.sqrt(np.add.accumulate(y * y)[-1]))), i, j, g, h))
    best = sorted(want, key=lambda t: (-t[0], t[1], t[2]))
    most, n = {}, {}
    for s, _, _, g, h in want:
        most[g, h] = max(most.get((g, h), -2), s)
    for _, i, g in whole:
        for _, j, h in whole:
            n[g, h] = n.get((g, h), 0) + (i < j)
    for ordered in (rows, sorted(rows)):
        df = spark.createDataFrame(ordered, "id long, vec array<float>, label int").coalesce(3)
        assert [tuple(r) for r in E.most_similar(df, 80).collect()] == [(i, j, s) for s, i, j, _, _ in best[:80]]
        got = {(r.group_a, r.group_b): (r.pairs, r.most) for r in E.similarity_of_groups(df, "label").collect()}
        assert got == {k: (n[k], most[k]) for k in n if n[k]}

    def counted(x, y, r, c):
        nonlocal count
        count += len(r)
        return exact(x, y, r, c)

    monkeypatch.setattr(E, "_cosines", counted)
    sides, rng = [], np.random.default_rng(6)
    for low in (0, 400):
        sides.append(E.Side(pa.py_buffer(np.arange(low, low + 400).tobytes()), pa.py_buffer(rng.standard_normal((400, 16)).tobytes()), 0))
    held = []
    monkeypatch.setattr(E, "_pairs", lambda vectors, use, out, tail=0: held.append(use))
    monkeypatch.setattr(E, "_single", lambda vectors: vectors)
    E.pairwise(None, 5)
    assert sum(b.num_rows for b in held[0](iter([(sides[0], sides[0], True), (sides[0], sides[1], False)]))) == 5
    assert count < 2000


def test_native_search_of_sifted_pairs(spark):
    rows = spark.createDataFrame([(i, v) for i, v, _ in _odd_rows(300)], "id long, vec array<float>")
    built = I.build(rows, "int8")
    want = sorted(map(tuple, I.search_native(built, rows, 5, exclude_self=True).collect()))
    assert sorted(map(tuple, I.search_native(built, rows, 5, exclude_self=True, all_pairs=False).collect())) == want
    assert sorted(map(tuple, I.search(built, rows, 5, exclude_self=True).collect())) == want


@pytest.mark.parametrize("metric", ["dot", "euclidean", "cosine"])
def test_tiles_lose_nothing(metric):
    from lodestone.operators.blocks import Top, best_pairs, unit_rows

    m = unit_rows(np.array([v for _, v, _ in _odd_rows()], np.float32))
    ids = np.array([i for i, _, _ in _odd_rows()])
    top = Top(ids[:90], 7)
    for low in (0, 333):
        best_pairs(top, m[:90], ids[low : low + 333 if not low else None], m[low : low + 333 if not low else None], metric, 1.0, True, step=64)
    x = m.astype(np.float64)
    for n in range(90):
        value = -np.sqrt(np.add.accumulate((x[n] - x) ** 2, axis=1)[:, -1]) if metric == "euclidean" else np.add.accumulate(x[n] * x, axis=1)[:, -1]
        value = np.clip(value, -1, 1) - 1 if metric == "cosine" else value
        order = [i for i in np.lexsort((ids, -value)) if i != n][:7]
        assert top.id[top.row == n].tolist() == ids[order].tolist() and top.value[top.row == n].tolist() == value[order].tolist()
