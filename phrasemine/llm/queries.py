"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from phrasemine.llm.decontaminate import op7_decontamination
from phrasemine.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from phrasemine.llm.license_scan import op6_licenses
from phrasemine.llm.lm_score import op8_lm_score
from phrasemine.llm.mixing import OP10_SQL, op10_mixing
from phrasemine.llm.ngram_join import op2_ngram_join
from phrasemine.llm.quality_cnn import op4_quality
from phrasemine.llm.spelling import OP13_SQL, op13_spelling
from phrasemine.llm.suffix_dedup import op9_suffix_dedup
from phrasemine.llm.token_counts import OP5_SQL, op5_token_counts
from phrasemine.llm.token_files import op11_token_files
from phrasemine.llm.url_filter import OP1_SQL, op1_url_filter
from phrasemine.llm.vector_dedup import op3_vector_dedup

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_lm_score": op8_lm_score,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}

SQL = {
    "op1_url_filter": OP1_SQL,
    "op5_token_counts": OP5_SQL,
    "op10_mixing": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
