"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .decontaminate import op2_decontamination
from .embedding_dedup import op10_embedding_dedup
from .html_text import op6_html
from .ngram_join import op3_ngram_join
from .ngram_lm import op11_language_model
from .packing import op1_packing
from .pii import op8_pii
from .quality import op4_quality
from .repeats import op7_repeats
from .resampling import OP12_SQL, op12_resampling
from .token_alignment import op13_alignment
from .urls import OP5_SQL, op5_urls

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_urls": op5_urls,
    "op6_html": op6_html,
    "op7_repeats": op7_repeats,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_language_model": op11_language_model,
    "op12_resampling": op12_resampling,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {"op5_urls": OP5_SQL, "op9_chat": OP9_SQL, "op12_resampling": OP12_SQL}
