"""Appending embedded rows of a stream to an index folder (beyond what the batch engine needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import encoder as E
from lodestone.operators import index as I
from lodestone.operators import shared


def append(batch: DataFrame, number: int, folder: str, mode: str, dim: int, id_col: str = "id", vec_col: str = "vec") -> None:
    """Quantise the vectors of a batch and add them to the index in ``folder``, which ``index.load`` opens.

    Null, wrongly sized or repeated rows, and ids that another batch has, are an error. A batch that is run again is
    written once: each has a folder of its own, which is overwritten.
    """
    spark = batch.sparkSession
    rows = batch.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    if rows.isEmpty():
        return
    I.measured(rows, dim)
    if shared.exists(spark, f"{folder}/vectors"):
        twice = spark.read.parquet(f"{folder}/vectors").where(F.col("batch") != number).select("id").join(rows.select("id"), "id", "left_semi").first()
        if twice:
            raise I.VectorError(f"id {twice['id']} is in the index already")
    built = I.build(rows, mode, dim, validate=False)
    built.table.write.mode("overwrite").parquet(f"{folder}/vectors/batch={number}")
    if not I.exists(spark, folder):
        built.save_metadata(folder)


def append_vectors(stream: DataFrame, folder: str, checkpoint: str, mode: str, dim: int, id_col: str = "id", vec_col: str = "vec") -> StreamingQuery:
    """``append`` for every batch of a stream of vectors."""

    def write(batch: DataFrame, number: int) -> None:
        append(batch, number, folder, mode, dim, id_col, vec_col)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_texts(stream: DataFrame, model: str, folder: str, checkpoint: str, mode: str, dim: int) -> StreamingQuery:
    """As ``append_vectors`` for a stream of embedding requests; rows that can't be embedded are left out."""

    def write(batch: DataFrame, number: int) -> None:
        vectors = E.embed(batch, model, strict=False).where("error is null").select("id", "vec")
        append(shared.materialize(vectors, "embedded"), number, folder, mode, dim)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
