"""Record corpora as JSON, and the sinks of vectors, metrics and ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "icons array<struct<id:string,title:string,description:string>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, slug, title, description) of a JSON file of one array; ``id`` is the place in it."""
    rows = spark.read.schema(RECORDS).option("multiLine", True).json(path).select(F.posexplode("icons").alias("id", "r"))
    return rows.select("id", F.col("r.id").alias("slug"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.description", F.lit("")).alias("description"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """JSON lines of ``{"id", "vector"}``."""
    vectors.select("id", F.col("vec").alias("vector")).write.json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, vector array<float>").json(path).withColumnRenamed("vector", "vec")


def report(metrics: DataFrame) -> DataFrame:
    """(dim, mode, mib, search_ms, recall_pct, loss_pct) of rows (dim, mode, bytes, search_us, recall)."""
    pct = F.col("recall") * 100
    return metrics.select("dim", "mode", F.round(F.col("bytes") / (1 << 20), 3).alias("mib"), F.round(F.col("search_us") / 1000, 4).alias("search_ms"), F.round(pct, 3).alias("recall_pct"), F.round(100 - pct, 3).alias("loss_pct"))


def write_report_csv(metrics: DataFrame, path: str) -> None:
    report(metrics).coalesce(1).write.option("header", True).csv(path)


def markdown(metrics: DataFrame) -> str:
    """The report as a table; a row a configuration, so it is small."""
    head = ["dim", "mode", "MiB", "ms/query", "recall %", "loss %"]
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    for r in report(metrics).orderBy(F.desc("dim"), "mode").collect():
        lines.append(f"| {r.dim} | {r.mode} | {r.mib:.2f} | {r.search_ms:.2f} | {r.recall_pct:.2f} | {r.loss_pct:.2f} |")
    return "\n".join(lines)


def shorten(text, most: int = 140):
    """At most ``most`` bytes of UTF-8, a cut character left out, with dots behind what was cut."""
    raw = F.encode(text, "UTF-8")
    # a text can be cut before a byte that doesn't continue a character; one has four bytes at most
    ends = [F.substring(raw, 1, n) for n in range(most, max(0, most - 4), -1)]
    whole = [F.when(F.is_valid_utf8(e.cast("string")), e.cast("string")) for e in ends]
    return F.when(F.octet_length(text) > most, F.concat(F.coalesce(*whole, F.lit("")), F.lit("..."))).otherwise(text)


def with_records(found: DataFrame, records: DataFrame, most: int = 140) -> DataFrame:
    """Ranked results with their records; ids without one are dropped."""
    joined = found.join(records, "id")
    return joined.select(*found.columns, "slug", "title", shorten(F.col("description"), most).alias("description"))
