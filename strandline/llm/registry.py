"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, decontaminate, line_dedup, quality_model, quality_rules, secrets, simhash, surrogates, token_counts, toxicity
from strandline.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda spark, sf_dir: table(spark, sf_dir, "documents")
    return {
        "op1_byte_bpe": lambda s, d: bpe.op1_byte_bpe(documents(s, d)),
        "op2_quality_rules": lambda s, d: quality_rules.op2_quality_rules(documents(s, d)),
        "op3_line_dedup": lambda s, d: line_dedup.op3_line_dedup(documents(s, d)),
        "op4_decontaminate": lambda s, d: decontaminate.op4_decontaminate(documents(s, d), table(s, d, "benchmark")),
        "op5_simhash": lambda s, d: simhash.op5_simhash(documents(s, d)),
        "op6_secrets": lambda s, d: secrets.op6_secrets(documents(s, d)),
        "op7_toxicity": lambda s, d: toxicity.op7_toxicity(documents(s, d), table(s, d, "labels")),
        "op8_quality_classifier": lambda s, d: quality_model.op8_quality_classifier(documents(s, d), table(s, d, "labels")),
        "op9_token_counts": lambda s, d: token_counts.op9_token_counts(documents(s, d)),
        "op10_surrogates": lambda s, d: surrogates.op10_surrogates(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
    }
