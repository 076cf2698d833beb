"""A training corpus from raw documents: clean, drop exact and near copies, take out secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents``; the last returns the packed pieces. Null texts, texts without ten words and texts that are mostly junk leave with
the first stage; rows alike in doc_id and text leave with the second; an empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperline.llm import exact_dedup, near_dedup, packing, quality_rules, secrets
from paperline.llm.common import removed, table, written

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that lose too much by that or fail the base rules."""
    return quality_rules.clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five-word shingles: of texts linked by a similarity of 0.8 or more the one with the smallest doc_id stays."""
    return near_dedup.dedup(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redacted(docs, secrets.train(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secret_scan", no_secrets), ("packing", packed)]

#: Forests and fingerprint classes can't be put in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, last = written(stage(spark, docs, sf_dir), name), before
        if last is not None:
            removed(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
