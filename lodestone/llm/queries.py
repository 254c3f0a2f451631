"""Queries over the training-data tables, and the SQL that the expressible ones must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, disclosure, knn_join, langid, neardup, packing, quality, sentencepiece_codec, tiff, tokenbin
from lodestone.llm.common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.sanitise(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), sentencepiece_codec.read_model())


def sentencepiece_library_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against the library over the benchmark texts, whole."""
    benchmark = _table(spark, sf_dir, "benchmark")
    return sentencepiece_codec.library_check(benchmark, sentencepiece_codec.read_model(), id_col="item_id")


def sentencepiece_documents_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against the library over op2's table, whole."""
    return sentencepiece_codec.library_check(_table(spark, sf_dir, "documents"), sentencepiece_codec.read_model())


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against op2's table: every id of every document and its end are in one bin, in as few pieces as can be, and no bin holds too much."""
    docs, model = _table(spark, sf_dir, "documents"), sentencepiece_codec.read_model()
    rows = packing.pack(docs, model=model)
    ids = sentencepiece_codec.encode(docs, model).select("doc_id", (F.coalesce("n_tokens", F.lit(0)) + 1).alias("ids"))
    full = rows.groupBy("bin_id").agg(F.sum("length").alias("used")).where(F.col("used") > packing.CAPACITY)
    over = rows.join(full, "bin_id", "left_semi").select("doc_id", F.lit(True).alias("over")).distinct()
    each = rows.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"))
    held = ids.join(each, "doc_id", "left").join(over, "doc_id", "left")
    fewest = F.ceil(F.col("ids") / packing.CAPACITY)
    return held.select("doc_id", (F.col("tokens") == F.col("ids")).alias("all_tokens"), (F.col("end") == F.col("ids")).alias("to_the_end"), (F.col("pieces") == fewest).alias("fewest_pieces"), F.coalesce("over", F.lit(False)).alias("any_over"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    rows = tokenbin.write(_table(spark, sf_dir, "documents"), folder, sentencepiece_codec.read_model())
    return tokenbin.read_back(rows, folder)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turn has the page of its number as a document and later ones an image or a recording."""
    turns = _table(spark, sf_dir, "conversations")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.ceil(F.length("html") / 3000).cast("int").alias("sheets"))
    joined = turns.join(pages, (turns["conv_id"] == pages["page_id"]) & (turns["turn"] == 0), "left")
    size = (F.length("text") % 7 + 1) * 256
    extra = F.when(F.col("url").isNotNull(), chat.other_part("document", F.col("url"), pages=F.col("sheets")))
    extra = extra.when(F.col("turn") % 3 == 1, chat.other_part("image", F.concat(F.lit("image/"), "conv_id", F.lit("/"), "turn"), width=size, height=size))
    extra = extra.when((F.col("turn") > 0) & (F.col("turn") % 3 == 0), chat.other_part("audio", F.concat(F.lit("audio/"), "conv_id", F.lit("/"), "turn"), seconds=F.length("text") / 15))
    typed = joined.select("conv_id", "turn", "role", F.concat(chat.text_part(F.col("text")), F.coalesce(extra, F.array().cast(f"array<{chat.PART}>"))).alias("parts"))
    return chat.format_chats(typed, sentencepiece_codec.read_model())


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: all but the tokens of text. A row an attachment, one with nulls for a conversation without any."""
    rows = op7_chat_formatting(spark, sf_dir).select("conv_id", F.md5("text").alias("md5"), "n_turns", F.explode_outer("attachments").alias("a"))
    return rows.select("conv_id", "md5", "n_turns", "a.*")


def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.transcript(_table(spark, sf_dir, "conversations"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by 100 are the queries, held against all rows but themselves."""
    data = _table(spark, sf_dir, "embeddings")
    return knn_join.knn_join(data.where(F.col("vec_id") % 100 == 0), data, exclude_self=True)


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's source as the pixels of a TIFF, read again."""
    read = tiff.read_pages(tiff.scans(_table(spark, sf_dir, "pages")))
    return read.withColumn("md5", F.md5("pixels")).drop("pixels")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii_disclosure, op2_sentencepiece, op3_best_fit_packing, op4_language_id, op5_minhash_near_dedup, op6_token_binary, op7_chat_formatting, op8_quality_classifier, op9_voronoi_knn, op10_tiff_pages, sentencepiece_library_check, sentencepiece_documents_check, packing_totals, chat_parts, chat_transcript, pipeline]
    return {f.__name__: f for f in found}


_KNN = f"""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, sqrt(list_reduce(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)), lambda s, x: s + x)) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM pairs
)
SELECT query_id, id, place::INTEGER AS rank, distance FROM placed WHERE place <= {knn_join.K}
"""

_PIXELS = tiff.WIDE * tiff.TALL
_TIFF = f"""
WITH raw AS (SELECT page_id, hex(encode(html)) AS h FROM pages),
sheets AS (
  SELECT page_id, h, unnest(range(greatest(1, (length(h) + {2 * _PIXELS - 1}) // {2 * _PIXELS}))) AS k FROM raw
)
SELECT page_id AS image_id, k::INTEGER AS page, {tiff.WIDE} AS width, {tiff.TALL} AS height, 1 AS samples, 8 AS bits,
  (['none', 'packbits', 'lzw', 'deflate', 'lzw', 'deflate'])[((page_id + k) % 6 + 1)::INTEGER] AS compression,
  ([1, 1, 2, 2, 1, 1])[((page_id + k) % 6 + 1)::INTEGER] AS predictor,
  {_PIXELS}::BIGINT AS n_bytes, NULL::VARCHAR AS error,
  md5(unhex(rpad(substr(h, (1 + k * {2 * _PIXELS})::BIGINT, {2 * _PIXELS}), {2 * _PIXELS}, '0'))) AS md5
FROM sheets
"""

_PACKING = "SELECT doc_id, TRUE AS all_tokens, TRUE AS to_the_end, TRUE AS fewest_pieces, FALSE AS any_over FROM documents"

_CHAT = """
SELECT conv_id, string_agg('<|' || replace(role, '|', '') || '|>' || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') || '<|end|>' || chr(10), '' ORDER BY turn, role) AS text, count(*)::INTEGER AS n_turns
FROM conversations GROUP BY conv_id
"""


_CHAT_PARTS = f"""
WITH typed AS (
  SELECT c.*, '<|' || replace(role, '|', '') || '|>' || chr(10) || replace(text, '<|', '<' || chr(8203) || '|') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS nth,
    CASE WHEN url IS NOT NULL THEN 'document' WHEN turn % 3 = 1 THEN 'image' WHEN turn > 0 AND turn % 3 = 0 THEN 'audio' END AS kind,
    coalesce(url, CASE WHEN turn % 3 = 1 THEN 'image/' ELSE 'audio/' END || conv_id || '/' || turn) AS ref,
    CASE WHEN url IS NOT NULL THEN ceil(length(html) / 3000::DOUBLE) * {chat.PAGE_TOKENS}
      WHEN turn % 3 = 1 THEN {chat.IMAGE_TOKENS} + {chat.TILE_TOKENS} * ceil((length(text) % 7 + 1) * 256 / {chat.TILE}::DOUBLE) ** 2
      ELSE ceil(length(text) / 15::DOUBLE * {chat.SECOND_TOKENS}) END AS tokens
  FROM conversations c LEFT JOIN pages p ON c.conv_id = p.page_id AND c.turn = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY nth) AS number FROM typed),
lines AS (SELECT *, said || CASE WHEN kind IS NULL THEN '' ELSE '<|' || kind || '_' || number || '|>' END || '<|end|>' || chr(10) AS line FROM numbered),
placed AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(said) AS "at" FROM lines),
whole AS (SELECT conv_id, md5(string_agg(line, '' ORDER BY nth)) AS md5, count(*)::INTEGER AS n_turns FROM lines GROUP BY conv_id)
SELECT w.conv_id, md5, n_turns, kind, number::INTEGER AS number, CASE WHEN kind IS NOT NULL THEN ref END AS ref, nth::INTEGER AS turn, "at"::INTEGER AS "at", tokens::BIGINT AS tokens
FROM whole w LEFT JOIN placed p ON w.conv_id = p.conv_id AND p.kind IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "sentencepiece_library_check": "SELECT item_id AS doc_id, TRUE AS agrees FROM benchmark",
        "sentencepiece_documents_check": "SELECT doc_id, TRUE AS agrees FROM documents",
        "op9_voronoi_knn": _KNN,
        "op10_tiff_pages": _TIFF,
        "packing_totals": _PACKING,
        "chat_parts": _CHAT_PARTS,
        "chat_transcript": _CHAT,
    }
