"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, exact_dedup, filter_audit, language_id, mixing, near_dedup, nearest, packing, pii, pitman_yor, sharding, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_compression": _on_documents(language_id.language_report),
    "op2_order_minhash": _on_documents(near_dedup.near_duplicates),
    "op3_ftrl_toxicity": lambda spark, d: toxicity.toxicity_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_weak_supervision_pii": _on_documents(pii.pii_report),
    "op5_content_sort_dedup": _on_documents(exact_dedup.exact_duplicates),
    "op6_cost_balanced_packing": _on_documents(packing.packed_digest),
    "op7_hash_threshold_mixing": _on_documents(mixing.mix_digest),
    "op8_hypergeometric_sharding": _on_documents(sharding.shard_digest),
    "op9_cross_polytope_search": lambda spark, d: nearest.nearest(table(spark, d, "embeddings")),
    "op13_pitman_yor_scores": _on_documents(pitman_yor.language_scores),
    "op12_prefix_fingerprint_trie": lambda spark, d: conversation_trie.conversation_trie(table(spark, d, "conversations")),
    "op11_permutation_trie_audit": lambda spark, d: filter_audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_seekable_token_frames": lambda spark, d: token_files.round_trip_digest(spark, table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {"op12_prefix_fingerprint_trie": conversation_trie.SQL, "op11_permutation_trie_audit": filter_audit.SQL, "op5_content_sort_dedup": exact_dedup.SQL, "op7_hash_threshold_mixing": mixing.SQL}
