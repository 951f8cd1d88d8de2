"""Queries of this subpackage: name -> function of (spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from gridloom.llm.conversations import op13_conversation_repair
from gridloom.llm.decontaminate import op3_decontamination
from gridloom.llm.divergence import OP12_SQL, op12_divergence
from gridloom.llm.html_text import op8_html_text
from gridloom.llm.importance import op6_quality_classifier
from gridloom.llm.lm_score import op9_lm_score
from gridloom.llm.packing import op5_packing
from gridloom.llm.quality_rules import OP7_SQL, op7_quality_rules
from gridloom.llm.sharding import op10_sharding
from gridloom.llm.simhash import op1_simhash
from gridloom.llm.token_counts import op11_token_counts
from gridloom.llm.token_files import op2_token_output
from gridloom.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_output": op2_token_output,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_lm_score": op9_lm_score,
    "op10_sharding": op10_sharding,
    "op11_token_counts": op11_token_counts,
    "op12_divergence": op12_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": OP4_SQL,
    "op7_quality_rules": OP7_SQL,
    "op12_divergence": OP12_SQL,
}
