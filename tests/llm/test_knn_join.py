import numpy as np
import pytest

from lodestone.llm import knn_join as K


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "vec_id bigint, embedding array<float>")


def brute(q, q_ids, m, ids, k, exclude=True):
    out = {}
    for i, v in zip(q_ids, q):
        d = np.sqrt(np.add.accumulate((m.astype(float) - v.astype(float)) ** 2, axis=1)[:, -1])
        order = [j for j in np.lexsort((ids, d)) if not exclude or ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
@pytest.mark.parametrize("group,part", [(4096, 1 << 16), (40, 1 << 16), (60, 90)])
def test_self_join_is_exact(spark, kind, group, part):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((500, 12)).astype(np.float32)
    if kind == "clusters":
        m = (rng.standard_normal((8, 12)) * 20)[rng.integers(8, size=500)].astype(np.float32) + m
    if kind == "ties":
        m = rng.integers(0, 2, (500, 4)).astype(np.float32)
    ids = rng.permutation(500) * 3
    got = result(K.knn_join(frame(spark, m, ids), k=7, group=group, part=part))
    assert got == brute(m, ids, m, ids, 7)


def test_two_tables(spark):
    rng = np.random.default_rng(4)
    q, m = rng.standard_normal((90, 6)).astype(np.float32), rng.standard_normal((300, 6)).astype(np.float32)
    got = result(K.knn_join(frame(spark, q, range(1000, 1090)), frame(spark, m), k=5, group=16))
    assert got == brute(q, np.arange(1000, 1090), m, np.arange(300), 5, False)


def test_two_tables_with_equal_ids(spark):
    """Equal ids are other rows, unless the queries are said to be among the data."""
    rng = np.random.default_rng(9)
    m = rng.standard_normal((200, 5)).astype(np.float32)
    q = m[::10] + np.float32(0.001)
    got = result(K.knn_join(frame(spark, q), frame(spark, m), k=4, part=64))
    assert got == brute(q, np.arange(20), m, np.arange(200), 4, False) and got[3][0][0] == 30
    asked = frame(spark, m[::10], range(0, 200, 10))
    assert result(K.knn_join(asked, frame(spark, m), k=4, exclude_self=True)) == brute(m[::10], np.arange(0, 200, 10), m, np.arange(200), 4)


@pytest.mark.parametrize("scale", [1e20, 1e-25, 1e140])
def test_components_of_any_size(spark, scale):
    rng = np.random.default_rng(10)
    m = rng.standard_normal((60, 4)) * scale
    m[::3] /= 1e12
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    ids = np.arange(60)
    assert result(K.knn_join(df, k=3, group=20, part=25)) == brute(m, ids, m, ids, 3)
    three = spark.createDataFrame([(1, [1e20, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert {i: x[0][0] for i, x in result(K.knn_join(three, k=1)).items()} == {1: 2, 2: 3, 3: 2}  # equally far from 1: by id


def test_bounds_prune_but_never_too_much():
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.standard_normal((100, 3)) + c for c in ([0, 0, 0], [50, 0, 0], [0, 80, 0])])
    pivots = m[[0, 100, 200]]
    cell = ((m[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    far = np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1))
    queries = [(i, 100, far[cell == i].max()) for i in range(3)]
    near = [(j, np.sort(far[cell == j])[:6].tolist()) for j in range(3)]
    theta, least = K.bounds(pivots, queries, near, 6)
    for i in range(3):
        d = np.sqrt(((m[cell == i][:, None] - m[None]) ** 2).sum(axis=2))
        assert np.sort(d, axis=1)[:, 5].max() <= theta[i]
        for j in {0, 1, 2} - {i}:
            assert least[i][j] > far[cell == j].max()  # another cluster isn't sent


def test_groups_hold_every_cell_once():
    rng = np.random.default_rng(6)
    pivots = rng.standard_normal((30, 4))
    queries = [(i, int(rng.integers(1, 50)), 1.0) for i in range(30)]
    groups = K.group_cells(pivots, queries, 100)
    assert sorted(i for g in groups for i in g) == list(range(30))
    assert all(sum(queries[i][1] for i in g) <= 100 for g in groups)


def test_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, []), (8, [None, 1.0]), (9, [5.0, 5.0])]
    assert K.clean(spark.createDataFrame([(1, [1e200]), (2, [1.0])], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")[0].count() == 1
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id bigint, embedding array<float>, cell int")
    got = result(K.knn_join(df, k=10))
    assert {i: [j for j, _ in x] for i, x in got.items()} == {1: [2, 9], 2: [1, 9], 9: [2, 1]}
    assert K.knn_join(df.limit(0)).count() == 0
    assert K.knn_join(df.where("vec_id = 1")).count() == 0
    same = frame(spark, np.ones((300, 3)))
    got = result(K.knn_join(same, k=3, group=50))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and got[299] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        K.knn_join(same, k=0)
