"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, fingerprints, html, huffman, language, middle, mixing, near, oracle, packing, ranked, repeats, secrets, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_huffman": huffman.op3_huffman,
    "op4_html": html.op4_html,
    "op5_packing": packing.op5_packing,
    "op6_language": language.op6_language,
    "op7_repeats": repeats.op7_repeats,
    "op8_secrets": secrets.op8_secrets,
    "op9_near": near.op9_near,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_ranked": ranked.op11_ranked,
    "op12_middle": middle.op12_middle,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op7_repeats": oracle.OP7,
    "op9_near": oracle.OP9,
    "op10_decontaminate": oracle.OP10,
    "op11_ranked": oracle.OP11,
    "op12_middle": oracle.OP12,
}
