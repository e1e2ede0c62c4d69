"""Registered queries of the training-data operators."""

from __future__ import annotations

from .alignment import op13_alignment
from .ann import op4_nearest
from .decontaminate import op10_decontamination
from .hard_negatives import SQL as OP11_SQL, op11_hard_negatives
from .katz import op2_katz
from .langid import op1_language_id
from .partenum import op9_jaccard
from .pii import op6_pii
from .packing import op7_packing
from .secret_scan import op3_secrets
from .substring_dedup import SQL as OP12_SQL, op12_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .simple8b import op8_token_files

QUERIES = {f.__name__: f for f in (op1_language_id, op2_katz, op3_secrets, op4_nearest, op5_suffix_dedup, op6_pii, op7_packing, op8_token_files, op9_jaccard,
                                op10_decontamination, op11_hard_negatives, op12_substring_dedup, op13_alignment)}
SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_substring_dedup": OP12_SQL}
