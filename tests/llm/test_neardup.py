import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import neardup as N
from lodestone.llm.common import mix64


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u9fff\uf900-\ufaff\U00020000-\U00033fff"
BREAK = "\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u200b\u200e-\u2bff\u3000-\u3004\u3008-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"


def words(text):
    lower = (text or "").translate({c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7})
    return re.findall(f"[{ALONE}]|(?:(?![{ALONE}{BREAK}])[0-9a-z\u0080-\U0010ffff])+", lower)


def shingles(text, width=N.SHINGLE):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0


def test_word_hashes_tell_words_apart():
    texts = pa.array(["The cat's café", "the CAT S CAFÉ", "", None, "x" * 9, "a-b"], pa.large_string())
    data, offsets = N.text_parts(texts)
    h, counts = N.word_hashes(data, offsets)
    assert counts.tolist() == [4, 4, 0, 0, 1, 2]
    assert h[:4].tolist() == h[4:8].tolist() and len(set(h.tolist())) == 7


def test_words_of_all_scripts():
    rng = np.random.default_rng(2)
    marks = list("aZ0é×ÉÿıЖ日本ー々。、「カ한국ไทย„“–—… \u00a0\u200c½ªµº！Ａｚ～｡漢\U00020001🙂܀ᄀကႠჀខⰀ٠\u2c00€→")
    texts = ["".join(rng.choice(marks, int(n))) for n in rng.integers(0, 40, 400)]
    data, offsets = N.text_parts(pa.array(texts))
    h, start, end, counts = N.word_table(data, offsets)
    raw = data.tobytes()
    got = [raw[s:e].decode() for s, e in zip(start, end)]
    edge = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert [w for x in got[edge[k] : edge[k + 1]] for w in words(x)] == words(t) and counts[k] == len(words(t)), t


def test_texts_without_spaces_have_near_copies(spark):
    base = "日本語の文章は単語の間に空白を置かないので文字ごとに分けて比べる必要がある。これは長い例文です、よく似た写しがあります"
    rows = [(1, base), (2, base.replace("例文", "文例")), (3, "全く別の話をするもう一つの文章で共通する部分はほとんどありません本当に")]
    assert {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def plain_superminhash(elements, size):
    """One element after another, with its own shuffle of the positions."""
    best = [None] * size
    for x in elements:
        p = list(range(size))
        for rank in range(size):
            with np.errstate(over="ignore"):
                y = int(mix64(np.array([x], np.uint64) + np.uint64((rank + 1) * int(N._GOLD) & (1 << 64) - 1))[0])
            j = rank + ((y >> 32) * (size - rank) >> 32)
            p[rank], p[j] = p[j], p[rank]
            value = (rank << 32) | (y & 0xFFFFFFFF)
            if best[p[rank]] is None or value < best[p[rank]]:
                best[p[rank]] = value
    return best


@pytest.mark.parametrize("n", [1, 3, 10, 200])
def test_superminhash_is_that_of_plain_loops(n):
    rng = np.random.default_rng(n)
    sets = [rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, 2 * n, np.uint64)]
    got = N.superminhash(np.concatenate(sets), np.repeat([0, 1], [n, 2 * n]), 2, 24)
    for row, own in zip(got, sets):
        want = np.array(plain_superminhash(own.tolist(), 24), np.uint64)
        ranks = (want >> np.uint64(32)).astype(np.uint32)
        assert np.array_equal(row, (want & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (ranks * np.uint32(0x9E3779B9)))


def test_estimates_are_close_and_of_low_variance():
    rng = np.random.default_rng(9)
    off = []
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, 60, np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 30, np.uint64)]) for _ in range(2))
        sig = N.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 90), 2, 120)
        off.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(off)) < 0.02
    assert np.var(off) < 0.25 / 120  # independent positions would have that


def corpus(rng, n=120):
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(2000)]
    rows, i = [], 0
    for _ in range(n):
        base = rng.choice(vocabulary, rng.integers(30, 200)).tolist()
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.integers(0, 4)):
            copy = list(base)
            for at in rng.integers(0, len(copy), max(0, len(copy) // 30)):
                copy[at] = str(rng.choice(vocabulary))
            rows.append((i, " ".join(copy).capitalize() + "!"))
            i += 1
    return rows


def test_against_brute_force(spark):
    rows = corpus(np.random.default_rng(1))
    group = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert set(group) == {i for i, _ in rows}
    found = missed = wrong = 0
    for i, a in rows:
        for j, b in rows:
            if i < j:
                s = jaccard(a, b)
                if s >= 0.6:
                    found, missed = found + (group[i] == group[j]), missed + (group[i] != group[j])
                if s < 0.1 and group[i] == group[j]:
                    wrong += 1
    assert found > 100 and missed / (found + missed) < 0.02 and wrong == 0


@pytest.mark.parametrize("listed", [N.LISTED, 0])
def test_groups_keep_their_least_id(spark, monkeypatch, listed):
    monkeypatch.setattr(N, "LISTED", listed)
    rows = corpus(np.random.default_rng(2), 40)
    out = N.near_duplicates(frame(spark, rows)).collect()
    size = Counter(r.group_id for r in out)
    for r in out:
        assert r.n_links == size[r.group_id] - 1
        assert r.group_id <= r.doc_id and r.keep == (r.group_id == r.doc_id)
    kept = N.dedup(frame(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in out if r.keep}


def test_thousands_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text) for i in range(3000)] + [(5000 + i, text + f" more{i} more{i}a") for i in range(400)] + [(9000, "another text of its own entirely")]
    out = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    links = {r.doc_id: r.n_links for r in N.near_duplicates(frame(spark, [*rows, (7, text), (7, "said otherwise"), (8, None)])).collect()}
    assert links[0] == links[7] == links[5399] == 3399 and links[9000] == 0 and links[8] == 3399
    assert {g for i, g in out.items() if i < 9000} == {0} and out[9000] == 9000


def test_verified_is_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(3, 40))
        sig = rng.integers(0, 3, (n, 12)).astype(np.uint16)
        ids = rng.permutation(n) * 7
        a, b = N.verified(ids, sig, 7)
        up = {int(i): int(i) for i in ids}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(n):
            for j in range(i):
                if (sig[i] == sig[j]).sum() >= 7:
                    x, y = sorted((root(int(ids[i])), root(int(ids[j]))))
                    up[y] = x
        got = {int(i): int(i) for i in ids}
        got |= dict(zip(a.tolist(), b.tolist()))
        assert got == {i: root(i) for i in up}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def test_edges(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None), (2, None), (3, ""), (4, "..."), (5, "one"), (6, "ONE."), (7, "one two"), (8, "one two"), (None, "one two"), (9, "x " * 400_000), (10, "x " * 400_000)]
    out = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 9}
    docs = spark.createDataFrame([(1, "one two three four", "k"), (1, "one two three four", "k"), (2, "one two three four", "l"), (None, "one two three four", "m")], "doc_id bigint, text string, group_id string")
    kept = N.dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r.group_id) for r in kept.collect()) == ["k", "m"]


def test_large_buckets_are_compared_whole(spark):
    """Parts of a few texts each, and texts that only a chain of links joins: groups are those of one part."""
    rng = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"t{i // 3}x{j}" for j in range(int(rng.integers(5, 90))))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in corpus(rng, 30)]
    want = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert len({g for i, g in want.items() if i < 150}) > 1
    got = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows), bucket=4).collect()}
    assert got == want


def test_buckets_in_pieces(monkeypatch):
    monkeypatch.setattr(N, "_HELD", 10)
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 12, 300))
    texts = np.arange(300)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[s : s + 7]), pa.array(texts[s : s + 7])], names=["key", "text"]) for s in range(0, 300, 7)]
    got = {}
    for b in N._buckets(iter(batches)):
        for bucket, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got.setdefault(bucket, set()).add(text)
    # every text is in the bucket of its key, whole or under the name of the key
    assert set().union(*got.values()) == set(range(300))
    assert all(len({keys[t] for t in own}) == 1 for own in got.values())


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (5, c + " more"), (5, None), (6, "none of them at all")]
    got = {r.doc_id: r.group_id for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    docs = spark.createDataFrame([(1, "x", a), (1, "x", a), (1, "x", b), (2, "y", None), (2, "y", None), (None, "z", a), (None, "z", a)], ["doc_id", "a.b", "text"])
    kept = N.dedup(docs)
    assert kept.columns == docs.columns and sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(1, "x", a), (2, "y", None), (None, "z", a), (None, "z", a)]))
