"""Registered queries of the corpus operators, and SQL where SQL expresses them."""

from __future__ import annotations

from tessella.llm.bpe import op8_bpe
from tessella.llm.decontaminate import SQL as LEAK_SQL
from tessella.llm.decontaminate import op10_decontaminate
from tessella.llm.html_text import op5_html_text
from tessella.llm.jaccard_join import op6_jaccard_join
from tessella.llm.language_id import op7_language_id
from tessella.llm.line_dedup import SQL as LINE_SQL
from tessella.llm.line_dedup import op3_line_dedup
from tessella.llm.order_minhash import op2_order_minhash
from tessella.llm.pii import op1_pii
from tessella.llm.substring_dedup import SQL as PASSAGE_SQL
from tessella.llm.substring_dedup import op4_substring_dedup
from tessella.llm.token_counts import op9_token_counts

QUERIES = {
    "op1_pii": op1_pii,
    "op2_order_minhash": op2_order_minhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_text": op5_html_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": LINE_SQL, "op4_substring_dedup": PASSAGE_SQL, "op10_decontaminate": LEAK_SQL}
