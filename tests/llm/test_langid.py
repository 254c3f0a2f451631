import math

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import langid as L


def longest_match_phrases(text, sample, block):
    """Greedy phrases by searching the sample for every prefix."""
    n = 0
    for low in range(0, len(text), block):
        part, at = text[low : low + block], 0
        while at < len(part):
            k = 1
            while at + k < len(part) and part[at : at + k + 1] in sample:
                k += 1
            at += k if part[at : at + 1] in sample else 1
            n += 1
    return n


@pytest.mark.parametrize("alphabet", ["ab", "abcd", "aéñ z"])
def test_phrases_against_search(monkeypatch, alphabet):
    monkeypatch.setattr(L, "BLOCK", 50)
    rng = np.random.default_rng(len(alphabet))
    sample = L.normalise("".join(rng.choice(list(alphabet), 300)))
    texts = ["".join(rng.choice(list(alphabet + "q"), int(n))) for n in rng.integers(0, 200, 40)]
    bits, length = L.cross_entropies([sample], pa.array(texts))
    for t, b, n in zip(texts, bits[:, 0], length):
        own = L.normalise(t)
        assert n == len(own)
        want = longest_match_phrases(own, sample, 50) * math.log2(len(sample)) / max(1, len(own))
        assert b == pytest.approx(want)


def test_normalise():
    assert L.normalise("  Ünd—ÀÉ, 12 x!") == "ünd—àé x ".encode()
    assert L.normalise("123 ...") == b""


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    samples = L.fit(half)
    assert set(samples) == {"de", "en", "es", "fr"} and all(len(s) <= L.SAMPLE for s in samples.values())
    rows = L.identify(docs.where("doc_id % 2 = 1"), samples).collect()
    said = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang == said[r.doc_id] for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97


def test_wrong_labels_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    samples = L.fit(docs)
    wrong = docs.replace({"en": "de", "de": "fr", "fr": "es", "es": "en"}, subset="lang")
    out = L.identify(wrong, samples).groupBy("accepted").count().collect()
    counts = {r.accepted: r["count"] for r in out}
    assert counts[False] > 0.95 * sum(counts.values())


def test_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "123", "en", "c"), (4, "the cat sat", None, "d"), (4, "the cat sat", None, "d"), (None, "the cat sat", "en", "e"), (5, "the cat sat on the mat " * 100_000, "en", "f"), (6, "the cat", "xx", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string")
    samples = {"de": L.normalise("die katze sass auf der matte"), "en": L.normalise("the cat sat on the mat")}
    out = {(r.doc_id, r.lang, r.accepted) for r in L.identify(docs, samples).collect()}
    assert out == {(1, None, False), (2, None, False), (3, None, False), (4, "en", True), (None, "en", True), (5, "en", True), (6, "en", False)}
    kept = L.accept(docs, samples)
    assert kept.columns == docs.columns and sorted(r.language for r in kept.collect()) == ["d", "d", "e", "f"]
    assert {r.lang for r in L.identify(docs, {}).collect()} == {None}
    assert L.identify(docs.limit(0), samples).count() == 0 and L.fit(docs.limit(0)) == {}
    assert L.fit(docs.where("lang is null")) == {}


def test_languages_of_short_texts_are_learned(spark):
    """A language of captions beside one of long texts, and a table of captions alone."""
    captions = [(i, f"der hund und die katze nummer {'abcdefghij'[i % 10]}", "de") for i in range(30)]
    long = [(100 + i, "the dog and the cat walked over the hill to the river again and again " * 6, "en") for i in range(20)]
    for rows in (captions + long, captions + [(99, "the dog and the cat", "en"), (None, "ein hund", "nl")]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        samples = L.fit(docs)
        assert set(samples) == {r[2] for r in rows} and all(0 < len(x) <= L.SAMPLE for x in samples.values())
        out = L.identify(docs, samples).collect()
        assert all(r.accepted for r in out if r.doc_id is not None)


def test_repeated_rows_are_learned_from_once(spark):
    rows = [(1, "the same words of one document", "en")] * 400 + [(2, "andere Worte", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert L.fit(docs) == {"de": L.normalise("andere Worte"), "en": L.normalise("the same words of one document")}
