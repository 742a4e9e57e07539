"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids
from .cover_tree import OP9_SQL, op9_top_k
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .jaccard_join import op5_jaccard_join
from .lm_score import op6_language_model
from .media import op7_media
from .packing import op2_packing
from .pieces import op10_sentencepiece
from .quality import op8_quality
from .secret_scan import op4_secrets
from .token_counts import op13_token_counts
from .token_files import op1_token_files
from .warc import op3_warc


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_secrets": op4_secrets,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_language_model": op6_language_model,
        "op7_media": op7_media,
        "op8_quality": op8_quality,
        "op9_top_k": op9_top_k,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_centroids": op12_centroids,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_centroids": OP12_SQL}
