"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.graph import nearest
from lectern.llm.jaccard import jaccard_join
from lectern.llm.lines import dedupe_lines
from lectern.llm.mix import mix_sources
from lectern.llm.pack import pack_documents
from lectern.llm.passages import repeated_passages
from lectern.llm.shard import shard_documents
from lectern.llm.topk import top_k
from lectern.llm.toxicity import score_toxicity
from lectern.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(_table(spark, sf_dir, "documents"), threshold=0.8, words=5)
    return joined.select("doc_id", "class_id", "copy_of", "copies", "links")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), passage_words=50, threshold=0.8, words=5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe_lines(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return found.select("doc_id", "lines", "exact", "near", "chars", "kept_chars", crc)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, beam=160)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256.0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(_table(spark, sf_dir, "pages"), least=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_pack_documents": op3_pack_documents,
    "op4_shard_documents": op4_shard_documents,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_graph_neighbours": op8_graph_neighbours,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op9_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
        ), g AS (
          SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM g
    """,
}
