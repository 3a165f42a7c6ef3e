"""Queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from karst.llm.alignment import op13_alignment
from karst.llm.conversations import op11_conversation_repair
from karst.llm.decontaminate import OP1_SQL, op1_decontaminate
from karst.llm.html_extract import op2_html_extract
from karst.llm.jaccard_join import op5_jaccard_join
from karst.llm.jaccard_sql import OP5_SQL
from karst.llm.lm_score import op7_lm_score
from karst.llm.minhash_dedup import OP12_SQL, op12_minhash_dedup
from karst.llm.packing import op4_packing
from karst.llm.paragraph_dedup import op9_paragraph_dedup
from karst.llm.pii import op10_pii
from karst.llm.quality import OP3_SQL, op3_quality
from karst.llm.token_counts import op8_token_counts
from karst.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_warc": op6_warc,
    "op7_lm_score": op7_lm_score,
    "op8_token_counts": op8_token_counts,
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op10_pii": op10_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op3_quality": OP3_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op12_minhash_dedup": OP12_SQL,
}
