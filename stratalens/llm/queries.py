"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from stratalens.llm import ann, htmltext, imatch, langid, mixing, neardup, packing, quality, secrets, toxicity
from stratalens.llm.oracles import ORACLES as ORACLES

QUERIES = {
    "op1_nearest": ann.op1_nearest,
    "op2_language_id": langid.op2_language_id,
    "op3_imatch": imatch.op3_imatch,
    "op4_main_text": htmltext.op4_main_text,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_ledger": secrets.op8_secret_ledger,
    "op9_packing": packing.op9_packing,
    "op10_near_duplicates": neardup.op10_near_duplicates,
}
