"""The registry of this subpackage: queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from strataforge.llm.bpe import op2_bpe
from strataforge.llm.embeddings import op9_embeddings
from strataforge.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from strataforge.llm.fingerprints import OP12_SQL, op12_fingerprints
from strataforge.llm.jaccard import OP6_SQL, op6_jaccard
from strataforge.llm.packing import op3_packing
from strataforge.llm.quality import op4_quality
from strataforge.llm.sharding import op5_sharding
from strataforge.llm.spelling import op11_spelling
from strataforge.llm.substrings import OP10_SQL, op10_substring
from strataforge.llm.suffixes import OP8_SQL, op8_suffixes
from strataforge.llm.vector_codes import OP13_SQL, op13_vector_codes
from strataforge.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_jaccard": op6_jaccard,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_suffixes": op8_suffixes,
    "op9_embeddings": op9_embeddings,
    "op10_substring": op10_substring,
    "op11_spelling": op11_spelling,
    "op12_fingerprints": op12_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {
    "op1_warc": OP1_SQL,
    "op6_jaccard": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_suffixes": OP8_SQL,
    "op10_substring": OP10_SQL,
    "op12_fingerprints": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
