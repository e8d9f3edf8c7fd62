"""The registered queries of this subpackage."""

from __future__ import annotations

from corpusq.llm.bpe import op7_bpe
from corpusq.llm.licenses import op10_licenses
from corpusq.llm.minhash import op1_minhash
from corpusq.llm.mixing import op4_mixing
from corpusq.llm.neighbours import op3_neighbours
from corpusq.llm.oracle import ORACLE_SQL
from corpusq.llm.pii import op8_pii
from corpusq.llm.quality import op6_quality
from corpusq.llm.sharding import op2_sharding
from corpusq.llm.toxicity import op5_toxicity
from corpusq.llm.vector_dedup import op9_vector_dedup

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_sharding": op2_sharding,
    "op3_neighbours": op3_neighbours,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_licenses": op10_licenses,
}
