"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from framelake.llm import centroids, covertree, jaccard
from framelake.llm.bpe import op4_bpe
from framelake.llm.centroids import op11_centroids
from framelake.llm.covertree import op1_near_vectors
from framelake.llm.fingerprints import op8_fingerprints
from framelake.llm.jaccard import op6_jaccard
from framelake.llm.language import op9_language
from framelake.llm.licenses import op13_licenses
from framelake.llm.packing import op7_packing
from framelake.llm.pii import op2_pii
from framelake.llm.quality import op10_quality
from framelake.llm.runs import op12_runs
from framelake.llm.token_counts import op5_token_counts
from framelake.llm.toxicity import op3_toxicity


def queries() -> dict:
    return {
        "op1_near_vectors": op1_near_vectors,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_bpe": op4_bpe,
        "op5_token_counts": op5_token_counts,
        "op6_jaccard": op6_jaccard,
        "op7_packing": op7_packing,
        "op8_fingerprints": op8_fingerprints,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_centroids": op11_centroids,
        "op12_runs": op12_runs,
        "op13_licenses": op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    """Models, tokenizers, hashes and the differencing aren't for SQL; the others are tested against plain versions."""
    return {"op1_near_vectors": covertree.ORACLE_SQL, "op6_jaccard": jaccard.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL}
