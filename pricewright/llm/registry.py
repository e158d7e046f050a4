"""Queries and SQL of the llm operators."""

from __future__ import annotations

import corpus_pipeline
from pricewright.llm.decontamination import OP7_SQL, op7_decontamination
from pricewright.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from pricewright.llm.language_id import op1_language_id, page_language_id
from pricewright.llm.license_scan import op9_license_scan, op9_sql
from pricewright.llm.line_dedup import OP13_SQL, op13_line_dedup
from pricewright.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from pricewright.llm.near_dedup import op2_near_dedup
from pricewright.llm.quality_classifier import op6_quality_classifier
from pricewright.llm.sentencepiece_codec import op4_sentencepiece
from pricewright.llm.spelling_groups import OP11_SQL, op11_spelling_groups
from pricewright.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from pricewright.llm.token_counts import op10_token_counts
from pricewright.llm.warc_revisits import OP8_SQL, op8_warc_revisits

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "pages_language_id": page_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_warc_revisits": OP8_SQL,
    "op9_license_scan": op9_sql(),
    "op11_spelling_groups": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
