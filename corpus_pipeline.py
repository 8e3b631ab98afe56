"""The corpus pipeline: toxic documents go, near duplicates go but one, benchmark leaks go, personal
data is replaced, and what is left is packed. Part of the training-data operators (corpusmill.llm).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and reread as
the next stage's docs. All but the last keep the columns of docs. Null texts count as empty: they
are never toxic, have no near duplicates and pack as an end id alone. Of repeated rows one stays. Empty tables pass
through: without labels nothing is toxic, without a benchmark nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import common, decontam, ngram_join, packing, pii, toxicity
from corpusmill.llm.queries import PACK_TOKENIZER, SURROGATE_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from labels outside the held-out fold."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, train_rows=common.fold("doc_id", 3) != 1)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by a 5-gram similarity of 0.8."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, also with other numbers or names."""
    return decontam.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced in their texts (n_chars is the length found before)."""
    return pii.replace_entities(docs, SURROGATE_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids."""
    return packing.pack(docs, PACK_TOKENIZER, end_id=2, length=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", replace_personal),
    ("packing", pack),
]

#: Models, band hashing and tokenization can't be written in SQL. The stages are tested in tests/llm: each operator against
#: brute force, a library or planted rows, and the order and decisions of the stages over small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
