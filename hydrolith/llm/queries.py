"""Registers the text operators' queries."""

from __future__ import annotations

from hydrolith.llm.chat import op6_chat_formatting
from hydrolith.llm.codes import SQL as CODES_SQL
from hydrolith.llm.codes import op11_vector_codes
from hydrolith.llm.extract import op4_html_extraction
from hydrolith.llm.fingerprints import op3_document_fingerprints
from hydrolith.llm.lines import SQL as LINES_SQL
from hydrolith.llm.lines import op12_line_dedup
from hydrolith.llm.manifest import SQL as MANIFEST_SQL
from hydrolith.llm.manifest import op13_merkle_manifest
from hydrolith.llm.mixing import op8_source_mixing
from hydrolith.llm.neardup import op10_simhash_near_dedup
from hydrolith.llm.packing import op1_best_fit_packing
from hydrolith.llm.pii import op7_pii
from hydrolith.llm.quality import SQL as QUALITY_SQL
from hydrolith.llm.quality import op5_quality_rules
from hydrolith.llm.rows import op9_token_rows
from hydrolith.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_pii": op7_pii,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_rows": op9_token_rows,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {"op5_quality_rules": QUALITY_SQL, "op11_vector_codes": CODES_SQL, "op12_line_dedup": LINES_SQL, "op13_merkle_manifest": MANIFEST_SQL}
