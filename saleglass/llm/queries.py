"""Queries of the corpus operators, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from saleglass.llm import decontamination, html_main, importance, licenses, mixing, near_dedup, quality, sharding, suffix_dedup, token_output, top_search, toxicity, vector_codes
from saleglass.llm.common import ship

_RUN = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_licenses": licenses.op3_licenses,
    "op4_mixing": mixing.op4_mixing,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_output": token_output.op8_token_output,
    "op9_html_extraction": html_main.op9_html_extraction,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_importance": importance.op12_importance,
    "op13_top_search": top_search.op13_top_search,
}


def _shipped(run):
    def query(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {name: _shipped(run) for name, run in _RUN.items()}

SQL = {
    "op4_mixing": mixing.OP4_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_top_search": top_search.OP13_SQL,
}
