"""The ten operators as queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import leaks
from .langid import identify_held_out
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .pii import replace_entities
from .quality import quality_rules
from .sharding import extendible_shards
from .tokencount import count_tokens
from .toxicity import score_held_out
from .warc import write_read

#: Places of the public vocabulary files; a parameter of the operators.
PACK_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COUNT_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = ngram_jaccard_join(table(spark, sf_dir, "documents"))
    return links.select(F.col("rid").alias("doc_id"), "class_id", "copy_of", "n_copies", "n_links", "n_texts")


#: The key of surrogates; a secret of the deployment, here a fixed one so that runs agree.
SURROGATE_KEY = "corpusmill-test-key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count_col="n_entities")


#: Bytes of text that a shard may hold.
SHARD_LIMIT = 2 << 20


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), SHARD_LIMIT)


OP3_SQL = f"""
WITH rows AS (
  SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS m, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents
), hashed AS (
  SELECT doc_id, n_bytes, CAST('0x' || substr(m, 1, 15) AS BIGINT) AS h FROM rows
), sizes AS (
  SELECT d.depth, (h >> (60 - d.depth)) AS p, sum(n_bytes) AS shard_bytes, count(*) AS n
  FROM hashed, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth) d GROUP BY ALL
), fits AS (SELECT * FROM sizes WHERE shard_bytes <= {SHARD_LIMIT} OR n = 1)
SELECT doc_id, n_bytes, 'b' || lpad(bin(p), depth, '0') AS shard_id, depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {SHARD_LIMIT} AS over_limit
FROM hashed JOIN fits ON (h >> (60 - depth)) = p
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER, end_id=2, length=4096, with_ids=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), COUNT_TOKENIZER, limit=4096)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = write_read(table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_pii": op2_pii,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_packing": op5_packing,
        "op6_token_counts": op6_token_counts,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL}
