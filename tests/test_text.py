import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.operators import tokenizer as K
from lodestone.sources import corpus as C

VOCAB = ["<unk>", "<s>", "</s>", "▁", "h", "e", "l", "o", "w", "r", "d", "he", "ll", "hell", "hello", "▁w", "▁wo", "▁world", "rld", "or", "  "]


def toy(**more):
    return K.Tokenizer(VOCAB, [float(len(t) - 10) for t in VOCAB], unknown=0, bos=1, eos=2, **more)


def slow(t, text):
    """Scan all pairs for each merge: best score, rightmost of equals."""
    part = list(text)
    while True:
        best = None
        for i in range(len(part) - 1):
            j = t.ids.get(part[i] + part[i + 1])
            if j is not None and (best is None or t.scores[j] >= best[0]):
                best = (t.scores[j], i)
        if best is None:
            return part
        part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]


def test_merges_equal_a_scan_of_all_pairs():
    rng = np.random.default_rng(1)
    vocab = list("abc") + sorted({"".join(rng.choice(list("abc"), n)) for n in (2, 3, 4, 5) for _ in range(12)})
    t = K.Tokenizer(vocab, rng.integers(-5, 0, len(vocab)).astype(float).tolist())
    for _ in range(300):
        text = "".join(rng.choice(list("abcd"), rng.integers(0, 30)))
        assert t.pieces(text) == slow(t, text)


def test_words_are_merged_as_the_whole_text():
    rng = np.random.default_rng(2)
    vocab = list("ab▁ ") + ["▁a", "▁▁", "ab", "▁ab", "aba", "▁▁a", "  ", "b ", "ba"]
    t = K.Tokenizer(vocab, rng.integers(-4, 0, len(vocab)).astype(float).tolist())
    assert t.by_word and not K.Tokenizer(["a", "▁", "a▁"], [0.0] * 3).by_word
    for _ in range(300):
        text = "".join(rng.choice(list("ab▁ c"), rng.integers(0, 25)))
        assert t.pieces(text) == slow(t, text) == t.merged(text)


def test_encode_and_decode():
    t = toy(add_bos=True, add_eos=True)
    ids = t.encode("hello world")
    assert ids[0] == 1 and ids[-1] == 2 and t.decode(ids) == "hello world"
    assert t.encode("") == [1, 2] and toy().encode("") == []
    assert toy().encode("x") == [0] and toy().decode([999, -1, 4]) == "h"


def test_byte_pieces():
    vocab = [f"t{i}" for i in range(238)] + [f"<0x{b:02X}>" for b in range(256)]
    t = K.Tokenizer(vocab, [0.0] * len(vocab))
    assert t.encode("é") == [238 + 0xC3, 238 + 0xA9]


def test_spaces(spark):
    cases = {"a b": "a▁b", " a": "▁a", "a ": "a▁", "a  b": "a  b", "  ": "  ", " ": "▁", "a   b c": "a   b▁c", "": ""}
    assert {k: K.mark_spaces(k) for k in cases} == cases
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", K.mark_spaces_column(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == cases


def test_normalize(spark):
    assert K.normalize("ﬁÉ", strip_accents=True, lower=True) == "fie"
    df = spark.createDataFrame([(1, "①É"), (2, None)], "id int, text string")
    assert [r.text for r in K.normalized(df, lower=True).orderBy("id").collect()] == ["1é", None]


def test_bad_vocabularies():
    with pytest.raises(ValueError):
        K.Tokenizer(["a"], [])
    with pytest.raises(ValueError):
        K.Tokenizer(["a"], [0.0], [1, 2])
    with pytest.raises(ValueError):
        K.Tokenizer.from_metadata({"tokenizer.ggml.tokens": ["a"]})
    t = K.Tokenizer.from_metadata({"tokenizer.ggml.tokens": ["a", "b"], "tokenizer.ggml.scores": [0.0, 1.0], "tokenizer.ggml.token_type": [1, 3], "tokenizer.ggml.bos_token_id": 1})
    assert t.add_bos and not t.add_eos and t.encode("a") == [1, 0] and t.decode([1, 0]) == "a"


def test_dataframes(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, "")], "id int, text string")
    rows = K.encode(df, toy())
    assert {r.id: r.token_ids for r in rows.collect()} == {1: [14], 2: None, 3: []}
    assert {r.id: r.text for r in K.decode(rows, toy()).collect()} == {1: "hello", 2: None, 3: ""}


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 37).tolist()
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 5.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in stats.latency_summary(df, "v", ["g"], {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    s = sorted(values)
    assert (got["a"].p50, got["a"].p95, got["a"].p100, got["a"].n) == (s[18], s[35], s[36], 37)
    assert (got["b"].p50, got["b"].p100, got["b"].mean) == (5, 5, 5)
    r = spark.range(1).select(stats.linear_cost(F.lit(10.0), 9, F.lit(50.0), 49).alias("c"), stats.ratio(F.lit(50.0), F.lit(10.0)).alias("r")).first()
    assert (r.c.per_word, r.c.fixed, r.r) == (1, 1, 5)


def test_percentiles_of_large_and_odd_groups(spark):
    """Ties, a group that holds most rows, null keys; positions as in the sorted values."""
    rng = np.random.default_rng(4)
    rows = [("big", float(v)) for v in rng.normal(0, 1, 6000)] + [("ties", float(v)) for v in rng.integers(0, 3, 3000)] + [(None, 7.5), ("one", -1.0)] + [("same", 2.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for accuracy in (1000, 50):
        got = {r.g: r for r in stats.latency_summary(df, "v", ["g"], points, accuracy).collect()}
        for g in {x for x, _ in rows}:
            s = sorted(v for x, v in rows if x == g)
            assert [got[g][n] for n in points] == [s[min(len(s) - 1, int(len(s) * p))] for p in points.values()]
    r = stats.latency_summary(df, "v", [], {"p50": 0.5}).first()
    assert r.p50 == sorted(v for _, v in rows)[len(rows) // 2]


def test_records_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"icons": [{"id": "a", "title": "A", "description": "' + "é" * 100 + '"},\n {"id": "b"}]}')
    rows = C.read_records(spark, str(tmp_path / "c.json"))
    assert [(r.id, r.slug, r.title) for r in rows.orderBy("id").collect()] == [(0, "a", "A"), (1, "b", "")]
    found = spark.createDataFrame([(0, 0.5, 1), (9, 0.4, 2)], "id int, distance double, rank int")
    out = C.with_records(found, rows, 141).collect()
    assert len(out) == 1 and out[0].description == "é" * 70 + "..."
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, vec array<float>")
    C.write_vectors(vec, str(tmp_path / "v"))
    assert C.read_vectors(spark, str(tmp_path / "v")).collect() == vec.collect()
    m = spark.createDataFrame([(768, "int8", 3 << 20, 260.0, 0.9508)], "dim int, mode string, bytes bigint, search_us double, recall double")
    assert "| 768 | int8 | 3.00 | 0.26 | 95.08 | 4.92 |" in C.markdown(m)
    C.write_report_csv(m, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 1


def test_texts_become_objects_a_slice_at_a_time(spark, monkeypatch):
    """However large a batch is, its texts and ids are Python's objects a slice at a time, and no row is lost."""
    import pyarrow as pa

    from lodestone.operators import tokenizer as T
    from lodestone.sources import sample as S

    texts = ["ab" * (n % 7 * 500) if n % 5 else None for n in range(400)]
    for column in (pa.array(texts), pa.array([None if t is None else [1] * len(t) for t in texts], pa.list_(pa.int32()))):
        monkeypatch.setattr(T, "SLICE_BYTES", 10_000)
        parts = list(T._slices(column))
        assert pa.concat_arrays(parts).equals(column) and len(parts) > 20
        assert all(len(p) == 1 or p.nbytes < 40_000 for p in parts)
    tokens, scores, types = S.vocabulary()
    t = T.Tokenizer(tokens, scores, types, nfkc=False)
    long = "the" * 5000
    assert t.decode(t.encode(long)) == long and not any(len(w) > T._KEPT_LENGTH for w in t.known)
    df = spark.createDataFrame([(1, "the and"), (2, None), (3, ""), (4, long)], "id long, text string")
    got = {r.id: r.token_ids for r in T.encode(df, t).collect()}
    assert got == {1: t.encode("the and"), 2: None, 3: [], 4: t.encode(long)}
    assert {r.id: r.text for r in T.decode(T.encode(df, t), t).collect()} == {1: "the and", 2: None, 3: "", 4: long}
