"""The queries of this package and their SQL."""

from __future__ import annotations

from . import embedding_dedup, fingerprints, licenses, mixing, packing, quality, sharding, simhash_dedup, suffix_dedup, url_filters


def queries() -> dict:
    """Name to (spark, sf_dir) -> DataFrame, one for each operator, and the pipeline."""
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_quality": quality.op4_quality,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_packing": packing.op6_packing,
        "op7_mixing": mixing.op7_mixing,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express."""
    return {
        "op3_url_filters": url_filters.OP3_SQL,
        "op5_embedding_dedup": embedding_dedup.OP5_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op8_suffix_dedup": suffix_dedup.OP8_SQL,
        "op10_licenses": licenses.OP10_SQL,
    }
