"""All queries of this subpackage and their SQL."""

from veil.llm import (
    op1_simhash,
    op2_paragraphs,
    op3_mixing,
    op4_ann,
    op5_secrets,
    op6_tokens,
    op7_urls,
    op8_langid,
    op9_decontaminate,
    op10_ppm,
    op11_alignment,
    op12_phrases,
    op13_packing,
)

MODULES = (op1_simhash, op2_paragraphs, op3_mixing, op4_ann, op5_secrets, op6_tokens, op7_urls, op8_langid, op9_decontaminate, op10_ppm, op11_alignment, op12_phrases, op13_packing)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
