"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

1. toxicity: documents that the factorization machine rejects go;
2. n-gram Jaccard join: of each component one document stays, the one with the smallest id;
3. benchmark decontamination: documents with a passage that aligns with a test item go;
4. mixing: sources are repeated or thinned to their target weights, document by document;
5. token output: the ids of what is left as directly addressable codes, read back.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of ``docs``; a row that the mix repeats is a row
of its own in the token files. Nulls are handled as the operators state.
"""

from __future__ import annotations

from quayline.llm import decontamination, jaccard, mixing, token_codes, toxicity
from quayline.llm.common import table, written
from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_codes.encode_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)


# A model, exact similarity and token ids have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None
