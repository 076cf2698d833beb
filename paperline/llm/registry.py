"""Queries of this subpackage, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, conversations, decontamination, divergence, exact_dedup, licenses, line_dedup, packing, quality_model, quality_rules, secrets, sharding, simhash
from .common import table

ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op11_divergence": divergence.ORACLE, "op12_decontamination": decontamination.ORACLE, "op13_conversations": conversations.ORACLE}


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("cleaned").cast("binary"), 256).alias("cleaned_sha256"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"), with_text=False)


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.train(spark))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"), secrets.train(spark))


def op8_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op12_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark, sf_dir):
    return conversations.damage_report(table(spark, sf_dir, "conversations"))


def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_quality_rules, op4_exact_dedup, op5_bpe, op6_licenses, op7_packing, op8_quality_model, op9_sharding, op10_secrets, op11_divergence, op12_decontamination, op13_conversations)}
