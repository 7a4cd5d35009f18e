"""From raw documents to training tokens, in five stages.

Each stage takes (session, documents, sample folder) and returns a DataFrame.
All but the last return the columns of ``documents``; their decisions are in
the rows they return. ``run`` writes each stage's result to the shared folder
and reads it back, so a stage never repeats the work of those before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotscribe.llm import bpe, decontaminate, jaccard, secrets, toxicity
from slotscribe.llm.common import stage, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids, their number and digest, and the digest of what they decode to."""
    return bpe.tokenized(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("doc_id", "source", "lang"))


STAGES = [
    ("toxicity", civil), ("ngram_jaccard", distinct), ("decontamination", uncontaminated), ("secrets", without_secrets), ("byte_bpe", tokens),
]

# The toxicity model and the tokenizer have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a sample folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
