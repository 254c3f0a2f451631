import os

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import sentencepiece_codec as S
from lodestone.llm import tokenbin as B

MODEL = S.read_model()
TEXTS = ["", " ", "  a", "a  b ", "Hello world", "naïve café – ½", "日本語のテキスト", "a\tb\nc\r\n", "▁ mark ▁▁", "emoji 🙂👩‍👩‍👧", "x" * 70, "0123456789" * 5, "\u0000\u0001", "aaaa aaaa", "ñ" * 40, "<s> </s> <unk>"]


def library(texts):
    p = S.codec(MODEL).library
    ids = p.encode(texts, num_threads=1)
    return ids, p.decode(ids, num_threads=1)


def split(flat, offsets):
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_ids_and_texts_are_those_of_the_library():
    rng = np.random.default_rng(1)
    letters = list("abcdefghij  éñü.,'\n日🙂") + ["the", "ing", " and ", "tion"]
    texts = TEXTS + ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 300, 400)]
    c = S.codec(MODEL)
    ids, offsets = c.encode(pa.array(texts))
    want, spelled = library(texts)
    assert split(ids, offsets) == want
    data, at = c.decode(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == spelled


def test_agenda_takes_the_best_score_first():
    c = S.codec(MODEL)
    for word in (" understanding", " internationalisation", " zzzzqqq"):
        assert c.chunk_ids(word) == c.library.encode(word[1:])


def words(n, seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnop") + ["é", "ß", "日", "the", "tion", "\u0000"]
    return [" ".join("".join(rng.choice(letters, int(k))) for k in rng.integers(1, 9, 40)) for _ in range(n)]


def test_short_chunks_never_become_objects(monkeypatch):
    c, seen = S.Codec(MODEL), []
    known = c._known
    monkeypatch.setattr(c, "_known", lambda chunks: seen.extend(chunks) or known(chunks))
    texts = words(200, 5)
    ids, offsets = c.encode(pa.array(texts))
    assert split(ids, offsets) == library(texts)[0]
    assert all(len(x.encode()) > S.SHORT for x in seen) and c.short.used > 1000


def test_chunks_of_all_lengths_share_no_keys():
    # beginnings of each other, zero bytes at their end, and lengths on both sides of a key's
    texts = ["a" * n + z * m for n in range(20) for z in "\u0000bé" for m in range(6)] + ["\u0000" * n for n in range(20)]
    ids, offsets = S.Codec(MODEL).encode(pa.array(texts * 2))
    assert split(ids, offsets) == library(texts)[0] * 2


@pytest.mark.parametrize("slots, at_once", [(1 << 10, 1 << 9), (1 << 12, 7), (1 << 20, 100)])
def test_table_of_short_chunks_is_emptied_when_full(monkeypatch, slots, at_once):
    monkeypatch.setattr(S, "SLOTS", slots)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    c, emptied = S.Codec(MODEL), []
    empty = c._empty
    monkeypatch.setattr(c, "_empty", lambda: emptied.append(1) or empty())
    for seed in (1, 2, 1):
        texts = words(100, seed)
        ids, offsets = c.encode(pa.array(texts))
        assert split(ids, offsets) == library(texts)[0]
    assert bool(emptied) == (slots < 1 << 20)


def test_rows_merged_side_by_side_are_those_of_the_heap():
    c, rng = S.codec(MODEL), np.random.default_rng(9)
    chunks = ["".join(rng.choice(list("abcdehinorst"), int(n))) for n in rng.integers(1, 33, 3000)]
    flat, start, count = c._many("".join(chunks), np.array([len(x) for x in chunks]))
    assert all(flat[a : a + n].tolist() == c.chunk_ids(x) for x, a, n in zip(chunks, start, count))


def test_long_text():
    text = "The quick brown fox, déjà vu. " * 40_000 + "q" * 5000
    ids, offsets = S.codec(MODEL).encode(pa.array([text]))
    assert ids.tolist() == library([text])[0][0]


def test_dataframes(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a"), (3, "a  b ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    out = S.encode(docs, MODEL)
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    want, spelled = library(TEXTS)
    assert all(got[i].ids == want[i] and got[i].n_tokens == len(want[i]) for i in range(len(TEXTS)))
    assert got[99].ids is None and got[99].n_tokens is None
    assert all(got[i].round_trip == (spelled[i] == t) for i, t in enumerate(TEXTS))
    back = {r.doc_id: r.text for r in S.decode(out, MODEL).collect()}
    assert all(back[i] == s for i, s in enumerate(spelled)) and back[99] is None
    odd = spark.createDataFrame([(1, [-5, 10**6, None]), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.text for r in S.decode(odd, MODEL).collect()} == {""}
    assert all(r.agrees for r in S.library_check(docs, MODEL).collect())
    assert S.encode(docs.limit(0), MODEL).count() == 0


def test_benchmark_agrees_with_the_library(spark):
    out = S.library_check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), MODEL)
    assert out.where("not agrees").count() == 0


def test_binary_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 20)] + [(7, "again"), (None, "no id"), (1000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = str(tmp_path / "bin")
    index = B.write(docs, folder, MODEL).collect()  # a local path
    tokens = B.Tokens(folder)
    assert tokens.dtype == np.uint16 and len(tokens) == sum(r.n_tokens for r in index)
    assert len(index) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library([t or ""])[0][0] + [S.codec(MODEL).end])
    for r in index:
        assert tokens.read(r.offset, r.n_tokens).tolist() in want[r.doc_id]
    # the documents follow each other without gaps, over all files
    places = sorted((r.offset, r.n_tokens) for r in index)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    everything = tokens.read(0, len(tokens))
    assert len(everything) == len(tokens) and (everything == S.codec(MODEL).end).sum() >= len(rows)
    for k, f in enumerate(tokens.files):
        assert os.path.getsize(f"{folder}/{f['file']}") == 2 * f["tokens"]
        own = tokens.offsets(k)
        assert own[0] == f["base"] and own[-1] == f["base"] + f["tokens"] and (np.diff(own) > 0).all()
    with pytest.raises(IndexError):
        tokens.read(len(tokens) - 1, 5)
    sums = B.read_back(spark.createDataFrame(index), folder).collect()
    assert len(sums) == len(rows)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert B.write(docs, str(tmp_path), MODEL).count() == 0 and len(B.Tokens(str(tmp_path))) == 0


def test_other_models_are_refused():
    def model(trainer, normalizer):
        """A protocol buffer of small numbers."""
        specs = [(2, trainer), (3, normalizer)]
        raw = [b"".join(bytes([n << 3, v]) for n, v in spec.items()) for _, spec in specs]
        return b"".join(bytes([n << 3 | 2, len(r)]) + r for (n, _), r in zip(specs, raw))

    S.check_model(MODEL)
    S.check_model(model({3: 2}, {4: 0}))
    for trainer, normalizer in (({}, {4: 0}), ({3: 1}, {4: 0}), ({3: 3}, {4: 0}), ({3: 2}, {}), ({3: 2}, {4: 0, 3: 0}), ({3: 2}, {4: 0, 5: 0})):
        with pytest.raises(ValueError):
            S.check_model(model(trainer, normalizer))
    with pytest.raises(ValueError):
        S.codec(model({3: 1}, {}))


def test_counts_are_those_of_encode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in S.counts(docs, MODEL).collect()}
    assert got == {r.doc_id: r.n_tokens or 0 for r in S.encode(docs, MODEL).collect()}


def test_files_elsewhere_are_read_by_ranges(spark, tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    folder = str(tmp_path / "bin")
    rows = B.write(docs, folder, MODEL)
    mapped = B.Tokens(folder)
    other = B.Tokens(folder)
    other.fs = pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())
    assert (mapped.read(0, len(mapped)) == other.read(0, len(other))).all() and (mapped.offsets(0) == other.offsets(0)).all()
    assert rows.count() == len(TEXTS)
