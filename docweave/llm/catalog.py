"""The queries of this package and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import ctw, divergence, hyperplanes, mixing, negatives, packing, quality, records, sharding, simhash, suffix, syncmers, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_temperature_mix": mixing.op1_temperature_mix,
        "op2_interleaved_shards": sharding.op2_interleaved_shards,
        "op3_quality_scores": quality.op3_quality_scores,
        "op4_syncmer_fingerprints": syncmers.op4_syncmer_fingerprints,
        "op5_binary_records": records.op5_binary_records,
        "op6_packed_sequences": packing.op6_packed_sequences,
        "op7_va_file_topk": topk.op7_va_file_topk,
        "op8_repeated_bytes": suffix.op8_repeated_bytes,
        "op9_simhash_groups": simhash.op9_simhash_groups,
        "op10_context_tree_scores": ctw.op10_context_tree_scores,
        "op11_embedding_copies": hyperplanes.op11_embedding_copies,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_hard_negatives": negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_temperature_mix": mixing.ORACLE_SQL, "op7_va_file_topk": topk.ORACLE_SQL, "op11_embedding_copies": hyperplanes.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
