"""The registered queries of this subpackage."""

from __future__ import annotations

from colloquy.llm.decontamination import OP4_SQL, op4_decontamination
from colloquy.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from colloquy.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from colloquy.llm.language_id import op3_language_id
from colloquy.llm.line_dedup import OP13_SQL, op13_line_dedup
from colloquy.llm.lm_scoring import op2_lm_scoring
from colloquy.llm.mixing import op8_mixing
from colloquy.llm.quality_classifier import op1_quality_classifier
from colloquy.llm.secret_scan import op6_secret_scan
from colloquy.llm.sharding import op5_sharding
from colloquy.llm.simhash_dedup import op9_simhash_dedup
from colloquy.llm.toxicity import op10_toxicity
from colloquy.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_mixing": op8_mixing,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": OP4_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
