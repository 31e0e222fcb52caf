"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embeddings, html, licenses, lines, lm, manifest, middle, minhash, mixing, passages, pii, quality

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_pii": pii.op2_pii,
    "op3_minhash": minhash.op3_minhash,
    "op4_html": html.op4_html,
    "op5_itq": embeddings.op5_itq,
    "op6_chaining": passages.op6_chaining,
    "op7_winnowing": decontaminate.op7_winnowing,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_attention": lm.op10_attention,
    "op11_manifest": manifest.op11_manifest,
    "op12_lines": lines.op12_lines,
    "op13_middle": middle.op13_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash": minhash.OP3_SQL,
    "op5_itq": embeddings.OP5_SQL,
    "op7_winnowing": decontaminate.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op12_lines": lines.OP12_SQL,
    "op13_middle": middle.OP13_SQL,
}
