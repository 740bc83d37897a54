"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import sql
from .licenses import op8_license_scan
from .minhash import op1_minhash_near_dedup
from .packing import op4_best_fit_packing
from .pieces import op5_sentencepiece
from .quality import op3_quality_classifier
from .substrings import op6_substring_dedup
from .tokencounts import op9_token_counts
from .topk import op2_exact_top_k
from .urls import op10_url_filter
from .vectors import op7_embedding_near_dedup


def queries():
    """Query name to a function of (spark, sf_dir)."""
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_token_counts": op9_token_counts,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql():
    """DuckDB SQL for those queries that SQL can express over whole tables; tests hold the others against brute force."""
    return {
        "op1_minhash_near_dedup": sql.near_documents(),
        "op2_exact_top_k": sql.top_k(),
        "op7_embedding_near_dedup": sql.near_vectors(),
        "op8_license_scan": sql.licenses(),
    }
