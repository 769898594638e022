"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from . import decontaminate, jaccard, language, licenses, mixing, neighbours, repeats, secrets, token_store, toxicity
from .sql import ORACLE_SQL as ORACLE_SQL

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language": language.op2_language,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_token_output": token_store.op6_token_output,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_remove_repeats": repeats.op9_remove_repeats,
    "op10_license_scan": licenses.op10_license_scan,
}
