"""The ten queries op1..op10 by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe_codec import op9_bpe_codec
from .decontamination import op2_decontamination
from .fingerprints import op6_fingerprints
from .html_extraction import op7_html_extraction
from .language_id import op4_language_id
from .ngram_jaccard import op1_ngram_jaccard
from .oracle import ORACLE_SQL
from .quality import op8_quality
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_fingerprints": op6_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality": op8_quality,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_suffix_dedup": op10_suffix_dedup,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
