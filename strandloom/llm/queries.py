"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strandloom.llm import collocations, divergence
from strandloom.llm.ann import op9_ann
from strandloom.llm.bpe import op5_byte_bpe
from strandloom.llm.decontaminate import op3_decontaminate
from strandloom.llm.katz import op10_katz
from strandloom.llm.line_dedup import op1_line_dedup
from strandloom.llm.near_dedup import op7_near_dedup
from strandloom.llm.pieces import op13_pieces
from strandloom.llm.pii import op8_pii
from strandloom.llm.quality import op6_quality
from strandloom.llm.substring_dedup import op4_suffix_dedup
from strandloom.llm.toxicity import op2_toxicity

QUERIES = {"op1_line_dedup": op1_line_dedup, "op3_decontaminate": op3_decontaminate, "op6_quality": op6_quality, "op4_suffix_dedup": op4_suffix_dedup, "op8_pii": op8_pii, "op9_ann": op9_ann, "op2_toxicity": op2_toxicity, "op10_katz": op10_katz, "op5_byte_bpe": op5_byte_bpe, "op7_near_dedup": op7_near_dedup, "op11_collocations": collocations.op11_collocations, "op12_divergence": divergence.op12_divergence, "op13_pieces": op13_pieces}
ORACLE_SQL: dict[str, str] = {"op11_collocations": collocations.ORACLE_SQL, "op12_divergence": divergence.ORACLE_SQL}
