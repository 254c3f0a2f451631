"""Command line: ``python -m lodestone COMMAND``; see ``--help``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.functions.formats import progress_line
from lodestone.operators import encoder, evaluate, forest
from lodestone.operators import index as exact
from lodestone.session import get_session
from lodestone.sources import corpus, gguf


def _vectors(spark, args):
    """Vectors of a JSON-lines export, or of a record corpus embedded with a model."""
    if args.vectors:
        return corpus.read_vectors(spark, args.vectors)
    records = corpus.read_records(spark, args.records)
    requests = records.select("id", F.lit("SearchDocument").alias("task"), "title", F.col("description").alias("content"), F.lit(args.dim).alias("dim"))
    return encoder.embed(requests, args.model).select("id", "vec")


def _query(spark, args):
    if args.query is None:
        return corpus.read_vectors(spark, args.query_vectors)
    vec = encoder.embed_one(args.model, args.query, "SearchQuery", args.dim)
    return spark.createDataFrame([(0, vec.tolist())], "id bigint, vec array<float>")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("metadata", "tensors"):
        sub.add_parser(name, help=f"{name} of a model file").add_argument("model")
    tokens = sub.add_parser("tokens", help="token ids of a text")
    tokens.add_argument("model")
    tokens.add_argument("text")
    for name, told in (("build", "write an index and a forest"), ("search", "search a forest"), ("brute", "search an exact index"), ("eval", "recall of a forest"), ("sweep", "recall by dimension and quantisation"), ("pairs", "the most similar two"), ("batch", "embed all records and tell how long that took")):
        c = sub.add_parser(name, help=told)
        c.add_argument("folder")
        c.add_argument("--model")
        c.add_argument("--records")
        c.add_argument("--vectors")
        c.add_argument("--query")
        c.add_argument("--query-vectors")
        c.add_argument("--dim", type=int, default=512)
        c.add_argument("--mode", default="int8")
        c.add_argument("--metric", default="cosine")
        c.add_argument("--trees", type=int, default=20)
        c.add_argument("--leaf", type=int, default=32)
        c.add_argument("--seed", type=int, default=1)
        c.add_argument("--search-k", type=int)
        c.add_argument("--samples", type=int, default=200)
        c.add_argument("-k", type=int, default=10)
    return p


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "tokens":
        print(encoder.encoder(args.model).tokenizer.encode(args.text))
        return
    spark = get_session()
    if args.command == "metadata":
        gguf.scan_metadata(spark, args.model).show(1000, 120)
    elif args.command == "tensors":
        gguf.scan_tensors(spark, args.model).show(10_000, 120)
    elif args.command == "build":
        rows = _vectors(spark, args)
        exact.build(rows, args.mode).save(f"{args.folder}/exact", "overwrite")
        forest.build(rows, f"{args.folder}/forest", forest.Options(args.metric, args.trees, args.leaf, args.seed), progress=lambda done, total: print(progress_line("trees", done, total), flush=True)).show()
    elif args.command == "pairs":
        evaluate.argmax_pair(_vectors(spark, args)).show()
    elif args.command == "batch":
        records = corpus.read_records(spark, args.records)
        requests = records.select("id", F.lit("SearchDocument").alias("task"), "title", F.col("description").alias("content"), F.lit(args.dim).alias("dim"))
        for name, value in encoder.throughput(requests, args.model).items():
            print(f"{name} {value:.3f}")
    elif args.command in ("search", "brute"):
        asked = _query(spark, args)
        found = forest.search(asked, f"{args.folder}/forest", args.k, args.search_k) if args.command == "search" else exact.search(exact.load(spark, f"{args.folder}/exact"), asked, args.k)
        if args.records:
            found = corpus.with_records(found, corpus.read_records(spark, args.records))
        found.orderBy("query_id", "rank").show(1000, 140)
    elif args.command == "eval":
        forest.evaluate(_vectors(spark, args), f"{args.folder}/forest", args.samples, args.k, args.search_k, args.metric).agg(F.avg("recall").alias("recall")).show()
    else:
        rows = _vectors(spark, args)
        dim = rows.select(F.size("vec")).first()[0]
        evaluate.sweep(rows, [d for d in (768, 512, 256, 128, 64, 32) if d <= dim], list(V.SCALES) + ["fp32"], args.k, queries=evaluate.sample(rows, 500)).show(100)


if __name__ == "__main__":
    main()
