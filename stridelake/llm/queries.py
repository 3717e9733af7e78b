"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from stridelake.llm.chunk_prints import op5_chunk_fingerprints
from stridelake.llm.exact_topk import OP8_SQL, op8_exact_topk
from stridelake.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from stridelake.llm.html_text import op4_html_text
from stridelake.llm.line_dedup import OP2_SQL, op2_line_dedup
from stridelake.llm.mixing import op6_mixing
from stridelake.llm.passages import op9_repeated_passages
from stridelake.llm.quality import op1_quality
from stridelake.llm.sentencepieces import op3_sentencepiece
from stridelake.llm.simhash import op10_simhash
from stridelake.llm.target_encoding import OP12_SQL, op12_target_encoding
from stridelake.llm.token_files import op7_token_files
from stridelake.llm.toxicity import op11_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_html_text": op4_html_text,
    "op5_chunk_fingerprints": op5_chunk_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_exact_topk": op8_exact_topk,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_simhash": op10_simhash,
    "op11_toxicity": op11_toxicity,
    "op12_target_encoding": op12_target_encoding,
    "op13_hard_negatives": op13_hard_negatives,
}
#: Operators that are not here (library tokenizers, fitted, random or iterative ones) are tested against brute force in tests/llm.
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op8_exact_topk": OP8_SQL, "op12_target_encoding": OP12_SQL, "op13_hard_negatives": OP13_SQL}
