import numpy as np
import pytest

from lodestone.operators import forest as T
from lodestone.operators import index as I
from lodestone.sources import index_files as B
from tests.test_index import frame


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(5).standard_normal((400, 16)).astype(np.float32)


def test_basis_vectors(spark, tmp_path):
    T.build(frame(spark, np.eye(3), [1, 2, 3]), str(tmp_path), T.Options(trees=8, leaf=1, seed=42))
    found = T.search(frame(spark, [[1, 0, 0]]), str(tmp_path), 2).orderBy("rank").collect()
    assert [r.id for r in found] == [1, 2] and found[0].distance == pytest.approx(0)


@pytest.mark.parametrize("metric,shards", [("cosine", 1), ("euclidean", 1), ("cosine", 3)])
def test_all_leaves_are_exact(spark, tmp_path, points, metric, shards):
    rows = frame(spark, points)
    built = T.build(rows, str(tmp_path), T.Options(metric, 3, 8), shard_bytes=-(-400 * 16 * 4 // shards))
    assert built.count() == shards
    leaves = int(built.agg({"leaves": "max"}).first()[0])
    found = {(r.query_id, r["rank"]): r.id for r in T.search(rows, str(tmp_path), 5, leaves, exclude_self=True).collect()}
    p = points.astype(float)
    if metric == "cosine":
        p /= np.linalg.norm(p, axis=1, keepdims=True)
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert all(found[q, r + 1] == want[q, r] for q in range(400) for r in range(5))


def test_recall_and_nested_candidates(spark, tmp_path, points):
    rows = frame(spark, points)
    T.build(rows, str(tmp_path), T.Options(trees=20, leaf=16))
    mean = T.evaluate(rows, str(tmp_path), 50, 5).agg({"recall": "avg"}).first()[0]
    assert mean > 0.9
    few, more = ({(r.query_id, r.id) for r in T.candidate_sets(rows, str(tmp_path), n).collect()} for n in (3, 12))
    assert few < more


def test_leaves_hold_every_item_once(spark, tmp_path, points):
    T.build(frame(spark, points), str(tmp_path), T.Options(trees=2, leaf=10))
    rows = T.nodes(spark, str(tmp_path)).collect()
    for t in (0, 1):
        own = [r for r in rows if r.tree == t]
        assert sorted(i for r in own if r.leaf for i in r["items"]) == list(range(400))
        assert all(len(r["items"]) <= 10 for r in own if r.leaf)
        assert sum(r.leaf for r in own) == sum(not r.leaf for r in own) + 1


def test_equal_vectors_make_one_large_leaf(spark, tmp_path):
    same = np.tile([1.0, 2.0], (50, 1))
    T.build(frame(spark, same), str(tmp_path), T.Options(trees=2, leaf=4))
    assert {len(r["items"]) for r in T.nodes(spark, str(tmp_path)).where("leaf").collect()} == {50}
    found = T.search(frame(spark, [[1, 2]], [999]), str(tmp_path), 3).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 1, 2]


def test_few_candidates_fall_back(spark, tmp_path, points):
    rows = frame(spark, points)
    T.build(rows, str(tmp_path), T.Options(trees=1, leaf=2))
    assert T.search(rows, str(tmp_path), 30, search_k=1).count() == 400 * 30


def test_file_round_trip(points):
    forest = T.build_local(np.arange(400), points, T.Options("euclidean", 3, 8, 9))
    raw = B.write_forest(forest)
    again = B.read_forest(raw)
    assert B.write_forest(again) == raw
    assert np.array_equal(again.vectors, points) and again.options.metric == "euclidean"
    assert [t.leaves() for t in again.trees] == [t.leaves() for t in forest.trees]
    q = points[3] * 1.1
    assert T.search_local(again, q, 7, 12)[0].tolist() == T.search_local(forest, q, 7, 12)[0].tolist()
    for bad in (raw[:-3], b"BRUT" + raw[4:], raw[:10]):
        with pytest.raises(B.FormatError):
            B.read_forest(bad)


def test_options_and_errors(spark, tmp_path):
    assert (T.Options(trees=0).trees, T.Options(leaf=-1).leaf) == (1, 32)
    with pytest.raises(I.VectorError):
        T.Options("dot")
    rows = frame(spark, np.eye(3))
    T.build(rows, str(tmp_path))
    with pytest.raises(I.VectorError):
        T.search(rows, str(tmp_path), 0)
    with pytest.raises(I.VectorError):
        T.search(frame(spark, [[1.0]]), str(tmp_path), 1)
    with pytest.raises(I.VectorError):
        T.build(frame(spark, np.eye(2), [1, 1]), str(tmp_path))


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall_holds_on_tens_of_thousands(spark, tmp_path, spread):
    """64 components without clusters (a fixed number of leaves finds a fifth) and in 200 tight clusters."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((20_000, 64)) * spread
    if spread < 1:
        v += rng.standard_normal((200, 64))[rng.integers(200, size=len(v))]
    v = v.astype(np.float32)
    rows = frame(spark, v)
    T.build(rows, str(tmp_path), shard_bytes=-(-v.nbytes // 2))
    asked = rows.where("id < 100")
    found = {}
    for r in T.search(asked, str(tmp_path), 10, exclude_self=True, recall=0.9).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    p = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = p[:100] @ p.T
    score[np.arange(100), np.arange(100)] = -2
    want = np.argsort(-score, axis=1)[:, :10]
    assert np.mean([len(found[q] & set(want[q].tolist())) / 10 for q in range(100)]) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_whole_search_has_the_bits_of_the_local_one(points, metric):
    twice = np.concatenate([points, points[:50]])
    forest = T.build_local(np.arange(450), twice, T.Options(metric, 1, 8))
    every = sum(t.leaves() for t in forest.trees)
    ids = np.arange(450)
    for i, (a, d) in zip(ids, T.search_whole(forest, twice, 7, ids)):
        b, e = T.search_local(forest, twice[i], 7, every, int(i))
        assert a.tolist() == b.tolist() and d.tolist() == e.tolist()


def test_progress(spark, tmp_path, points):
    told = []
    T.build(frame(spark, points), str(tmp_path), T.Options(trees=3, leaf=16), shard_bytes=points.nbytes // 3, progress=lambda done, total: told.append((done, total)))
    assert told[-1][0] == told[-1][1] and told[-1][1] % 3 == 0
    assert [d for d, _ in told] == sorted(d for d, _ in told) and len({t for _, t in told}) == 1
    rows = {r.id: r.vec for r in T.stored(spark, str(tmp_path)).collect()}
    assert len(rows) == len(points)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_all_leaves_are_a_whole_search(spark, tmp_path, monkeypatch, metric):
    """Where all leaves are asked for no tree is walked, and the results are those of walking them."""
    m = np.random.default_rng(8).standard_normal((300, 8)).astype(np.float32)
    m[7], m[8] = m[3], 2 * m[3]
    rows = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(m)], "id long, vec array<float>")
    folder = str(tmp_path / metric)
    built = T.build(rows, folder, T.Options(metric, trees=2, leaf=8, seed=3), shard_bytes=5000)
    most = built.agg({"leaves": "max"}).first()[0]
    found = {}
    for r in T.search(rows, folder, 5, int(most), exclude_self=True).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.distance, r.id))
    forest = T.build_local(np.arange(300) * 2, m, T.Options(metric, trees=2, leaf=8, seed=3))
    for i, v in enumerate(m):
        ids, away = T.search_local(forest, v, 5, 10_000, i * 2)
        assert found[i * 2] == list(zip(away.tolist(), ids.tolist()))
    opened = []
    monkeypatch.setattr(T, "_over_shards", lambda *x: opened.append(x[-1]) or spark.createDataFrame([], "query_id long, id long, distance double"))
    T.search(rows, folder, 5, int(most))
    T.search(rows, folder, 5, 1)
    assert len(opened[0]) == built.count() > 1 and not opened[1]
