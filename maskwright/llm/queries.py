"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from .conversations import conversation_sql, op12_conversation_repair
from .decontaminate import contamination_sql, op3_decontaminate
from .discriminant import op13_quality_discriminant
from .jaccard_join import jaccard_sql, op10_jaccard_join
from .language_id import op7_language_id
from .language_model import op4_language_model
from .licenses import op2_license_scan
from .lines import host_line_dedup, host_line_sql, line_sql, op5_line_dedup
from .mixing import mix_sql, op1_mix_sources
from .pii import op9_pii
from .quality import op8_quality
from .substrings import op6_substring_dedup
from .variants import op11_spelling_variants, variants_sql

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_model": op4_language_model,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_discriminant": op13_quality_discriminant,
    "host_line_dedup": host_line_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_mix_sources": mix_sql(),
    "op3_decontaminate": contamination_sql(),
    "op5_line_dedup": line_sql(),
    "op10_jaccard_join": jaccard_sql(),
    "op11_spelling_variants": variants_sql(),
    "op12_conversation_repair": conversation_sql(),
    "host_line_dedup": host_line_sql(),
}
