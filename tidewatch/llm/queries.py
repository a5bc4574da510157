"""Queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .embeddings import op3_near_embeddings
from .licenses import op7_license_scan
from .manifest import OP13_SQL, op13_manifest
from .minhash import op2_near_duplicates
from .mixing import OP8_SQL, op8_mixing
from .packing import op10_packing
from .pages import op4_main_text
from .search import op9_exact_search
from .sharding import OP11_SQL, op11_sharding
from .tokens import op1_token_counts
from .toxicity import op5_toxicity
from .urls import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_near_embeddings": op3_near_embeddings,
    "op4_main_text": op4_main_text,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_exact_search": op9_exact_search,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_alignment": op12_alignment,
    "op13_manifest": op13_manifest,
}

ORACLES = {"op6_url_filter": OP6_SQL, "op8_mixing": OP8_SQL, "op11_sharding": OP11_SQL, "op13_manifest": OP13_SQL}
