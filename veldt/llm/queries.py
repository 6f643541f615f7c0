"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontam, langid, licenses, linededup, minhash, mixing, quality, suffixes, tokencount, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        tokencount.op1_section_tokens, quality.op2_risk_controlled_rules, mixing.op3_systematic_mix, linededup.op4_three_line_windows, licenses.op5_license_scan,
        suffixes.op6_suffix_merge_sort, toxicity.op7_multiple_instance, langid.op8_rank_order_profiles, minhash.op9_minhash_components, decontam.op10_positional_index,
    )
}

ORACLE_SQL = {
    "op2_risk_controlled_rules": quality.ORACLE,
    "op3_systematic_mix": mixing.ORACLE,
    "op4_three_line_windows": linededup.ORACLE,
    "op9_minhash_components": minhash.ORACLE,
    "op10_positional_index": decontam.ORACLE,
}
