import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import quality as Q


def network(seed=1):
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.standard_normal(s).astype(np.float32)
    embed = f(256, Q.EMBED)
    embed[0] = 0
    return Q.Network(embed, f(Q.WIDTH * Q.EMBED, Q.FILTERS) * 0.1, f(Q.FILTERS), f(Q.FILTERS) * 0.1, 0.1)


def plain(net, text):
    """Chunk by chunk over the whole text."""
    raw = text.encode()
    if not raw.strip():
        return 0.0
    starts = range(0, -(-len(raw) // Q.STRIDE) * Q.STRIDE, Q.STRIDE)
    chunks = [net.embed[np.frombuffer(raw[s : s + Q.WIDTH].ljust(Q.WIDTH, b"\0"), np.uint8)].reshape(-1) for s in starts]
    best = np.max(np.array(chunks) @ net.filters, axis=0)
    hidden = np.maximum(best + net.shift, 0)
    return 1 / (1 + np.exp(-float(hidden @ net.weights + net.bias)))


@pytest.mark.parametrize("sizes", [[1, 2, 15, 16, 17, 64, 1000], [0, 3, 0], [200_000, 5], [70_000, 70_000, 1]])
def test_every_chunk_counts(sizes):
    rng = np.random.default_rng(0)
    net = network()
    texts = ["".join(rng.choice(list("abc dé"), n)) for n in sizes]
    got = Q.probabilities(net, pa.array(texts, pa.large_string()))
    assert got == pytest.approx([plain(net, t) for t in texts], abs=1e-5)


def test_the_end_of_a_long_text_is_read():
    net = network()
    a = "plain text " * 30_000
    p, q = Q.probabilities(net, pa.array([a, a + "ÿþýü" * 8], pa.large_string()))
    assert p != q


def test_learns_and_generalises():
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for _ in range(300):
        good = rng.random() < 0.5
        own = rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(5, 60)).tolist()
        texts.append((" " if good else " | ").join(own).encode())
        labels.append(int(good))
    net = Q.train(texts[:200], np.array(labels[:200]))
    p = Q.probabilities(net, pa.array([t.decode() for t in texts[200:]], pa.large_string()))
    assert ((p > 0.5) == np.array(labels[200:])).mean() > 0.97


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    net = Q.fit(docs, labels.where("doc_id % 3 <> 0"))
    p = {r.doc_id: r.accepted for r in Q.score(docs, net).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    good = [p[r.doc_id] for r in held if r.quality == 1]
    bad = [p[r.doc_id] for r in held if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.25


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "good words", 5), (4, "good words", 5), (None, "good words", 5), (7, "w " * 1_000_000, 5)], "doc_id bigint, text string, probability int")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    for none in ([], [(4, 1)], [(None, 1), (4, None)], [(99, 0), (98, 1)]):
        net = Q.fit(docs, labels(none))
        assert net is None
        out = [(r.doc_id, r.probability) for r in Q.score(docs, net).collect()]
        assert sorted(out, key=str) == sorted([(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (None, 1), (7, 1)], key=str)
    net = Q.fit(docs, labels([(4, 1), (7, 0), (7, 1)]))
    assert net is not None
    kept = Q.accept(docs, net)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert Q.score(docs.limit(0), net).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good words")] * 300 + [(2, "bad")] * 300 + [(3, "x" * 5000), (3, "short")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda texts, y, epochs: seen.append((texts, y.tolist())))
    Q.fit(docs, labels, train_bytes=100)
    assert sorted(zip(*seen[0])) == [(b"bad", 0), (b"good words", 1), (b"short", 1)]
