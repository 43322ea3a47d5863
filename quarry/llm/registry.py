"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import byte_bpe, clustering, collocations, decontamination, licenses, mixing, pseudonyms, quality, simhash, substring_dedup, suffix_dedup, token_counts, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_pseudonyms": pseudonyms.op3_pseudonyms,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_files": token_files.op6_token_files,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_licenses": licenses.op8_licenses,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_mixing": mixing.op10_mixing,
        "op11_byte_bpe": byte_bpe.op11_byte_bpe,
        "op12_collocations": collocations.op12_collocations,
        "op13_clusters": clustering.op13_clusters,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.OP1_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
