"""Queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .chat import OP1_SQL, op1_chat_format
from .edits import op11_edit_fingerprint
from .language import op4_language_id
from .media import op10_media_columns
from .packing import op8_packing
from .pieces import op2_sentencepiece
from .quality import op6_quality
from .repeats import op3_suffix_dedup
from .simhash import op9_simhash
from .spelling import op12_spelling_variants
from .topk import OP5_SQL, op5_top_k
from .urls import op7_url_filter


def queries():
    return {
        "op1_chat_format": op1_chat_format,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op5_top_k": op5_top_k,
        "op6_quality": op6_quality,
        "op7_url_filter": op7_url_filter,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_media_columns": op10_media_columns,
        "op11_edit_fingerprint": op11_edit_fingerprint,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql():
    return {"op1_chat_format": OP1_SQL, "op5_top_k": OP5_SQL}
