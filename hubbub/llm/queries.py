"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import hard_negatives
from .boundary_bpe import op11_bpe
from .decontam import op6_decontam
from .hard_negatives import op12_hard_negatives
from .html_text import op3_html
from .langid import op2_langid
from .media import op9_media
from .near_dedup import op7_near_dedup
from .packing import op5_packing
from .pii import op8_pii
from .quality import op10_quality
from .repeats import op4_repeats
from .token_store import op1_token_store
from .word_runs import op13_runs

QUERIES = {f.__name__: f for f in (op1_token_store, op2_langid, op3_html, op4_repeats, op5_packing, op6_decontam, op7_near_dedup, op8_pii, op9_media, op10_quality, op11_bpe, op12_hard_negatives, op13_runs)}
ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": hard_negatives.ORACLE}
