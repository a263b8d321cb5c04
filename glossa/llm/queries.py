"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from glossa.llm.op01_quality import op1_quality_classifier
from glossa.llm.op02_lines import ORACLE as LINES_SQL
from glossa.llm.op02_lines import op2_line_dedup
from glossa.llm.op03_suffix import op3_suffix_array_dedup
from glossa.llm.op04_media import op4_media_columns
from glossa.llm.op05_simhash import op5_simhash_near_dedup
from glossa.llm.op06_toxicity import op6_toxicity
from glossa.llm.op07_pieces import op7_sentencepiece
from glossa.llm.op08_packing import op8_best_fit_packing
from glossa.llm.op09_secrets import op9_secret_scans
from glossa.llm.op10_fingerprints import op10_document_fingerprints
from glossa.llm.op11_merkle import ORACLE as MERKLE_SQL
from glossa.llm.op11_merkle import op11_merkle_manifest
from glossa.llm.op12_pii import op12_pii
from glossa.llm.op13_alignment import op13_cross_tokenizer_alignment

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secret_scans": op9_secret_scans,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii": op12_pii,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES_SQL, "op11_merkle_manifest": MERKLE_SQL}
