"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from . import decontaminate, licenses, minhash_dedup, mixing, pii, subspace_join, suffix_tree, token_files, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_files.op1_token_counts,
    "op2_licenses": licenses.op2_licenses,
    "op3_suffix_tree": suffix_tree.op3_suffix_tree,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_mixing": mixing.op5_mixing,
    "op6_minhash": minhash_dedup.op6_minhash,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_subspace": subspace_join.op9_subspace,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_minhash": minhash_dedup.OP6_SQL,
    "op9_subspace": subspace_join.OP9_SQL,
}
