"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from folioflow.llm import base_counts, infilling, licenses, mixing, near_dup, negatives, pieces, quality_model, quality_rules, secrets, topk, toxicity, training_order, warc

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc, training_order.op2_training_order, licenses.op3_licenses, pieces.op4_pieces, quality_rules.op5_quality_rules,
        quality_model.op6_quality_model, secrets.op7_secrets, mixing.op8_mixing, topk.op9_topk, near_dup.op10_near_dup,
        negatives.op11_negatives, toxicity.op12_toxicity, infilling.op13_infilling,
    )
} | base_counts.QUERIES

#: The others iterate, learn, or give ids and spans that SQL can't express; their tests use brute force, round trips or held-out rows.
ORACLE_SQL = {"op1_warc": warc.ORACLE, "op3_licenses": licenses.ORACLE, "op8_mixing": mixing.ORACLE, "op9_topk": topk.ORACLE, "op11_negatives": negatives.ORACLE, "op13_infilling": infilling.ORACLE} | base_counts.ORACLE_SQL
