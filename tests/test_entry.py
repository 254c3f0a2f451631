"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5000


def test_every_query_reads_whole_tables():
    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(entry.queries())


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import main
    from tests.test_encoder import make

    make(tmp_path / "toy.gguf")
    model = str(tmp_path / "toy.gguf")
    (tmp_path / "c.json").write_text('{"icons": [{"id": "a", "title": "star", "description": "bright star"}, {"id": "b", "title": "cat", "description": "small cat"}]}')
    records = ["--records", str(tmp_path / "c.json"), "--model", model, "--dim", "128"]
    main(["tokens", model, "abc"])
    main(["tensors", model])
    main(["metadata", model])
    main(["build", str(tmp_path / "ix"), *records])
    main(["search", str(tmp_path / "ix"), *records, "--query", "star", "-k", "2"])
    main(["brute", str(tmp_path / "ix"), *records, "--query", "star", "-k", "2"])
    out = capsys.readouterr().out
    assert "token_embd.weight" in out and "toy.block_count" in out and out.count("bright star") == 2


def test_both_sides_large(spark):
    """Without broadcasts the blocks are written once and paired as a cartesian product."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, plans.knn_exact_cosine(spark, DATA).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.knn_exact_cosine(spark, DATA)
        assert "CartesianProduct" in df._jdf.queryExecution().toString()
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
