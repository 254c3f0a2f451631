import corpus_pipeline
import pytest

from lodestone.llm import disclosure, langid, neardup, packing, quality
from lodestone.llm.common import materialize
from lodestone.llm.sentencepiece_codec import codec, read_model

import __spark_entry__ as entry
from tests.test_entry import DATA, plain


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.01"), "test")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] > kept[3] == kept[4] > 0.4 * kept[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "pii", "best_fit_packing"]


def test_against_each_stage_by_itself(spark):
    """Every decision of a stage, made again row by row from what the operator says of single rows."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet")
    net = quality.fit(docs, labels)
    import pyarrow as pa

    kept = {i: r for i, r in kept.items() if quality.probabilities(net, pa.array([r.text]))[0] >= quality.ACCEPT}
    left = spark.createDataFrame(list(kept.values()), docs.schema)
    samples = langid.fit(left)
    names = list(samples)
    for i, r in list(kept.items()):
        bits, length = langid.cross_entropies(list(samples.values()), pa.array([r.text]))
        if not length[0] or r.lang in names and bits[0][names.index(r.lang)] > bits[0].min() * (1 + langid.TOLERANCE):
            del kept[i]
    # copies by the words of their texts, compared pair by pair
    from tests.llm.test_neardup import jaccard, words

    groups = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(list(kept.values()), docs.schema)).collect()}
    for i, a in kept.items():
        for j, b in kept.items():
            if i < j and words(a.text) and (words(a.text) == words(b.text) or jaccard(a.text, b.text) >= 0.7):
                assert groups[i] == groups[j]
    kept = {i: r for i, r in kept.items() if groups[i] == i}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(spark.createDataFrame(list(kept.values()), docs.schema)).collect()}
    library = codec(read_model()).library
    sizes = {i: len(library.encode(t)) + 1 for i, t in clean.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}} == sizes
    used = {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.length
    assert max(used.values()) <= packing.CAPACITY


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the and of this " * 20_000, "en", "s", 5), (3, "mail a.b@mail1.example.com the and", "en", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {2, 3}
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["sentencepiece_library_check", "op9_voronoi_knn", "op10_tiff_pages", "packing_totals", "chat_parts", "chat_transcript"])
def test_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())


def test_all_are_registered():
    names = list(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_all_documents_are_held_against_the_library(spark, duck):
    got = sorted(map(tuple, entry.queries()["sentencepiece_documents_check"](spark, DATA).collect()))
    assert got == sorted(duck.execute(entry.oracle_sql()["sentencepiece_documents_check"]).fetchall())
