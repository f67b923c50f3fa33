"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_encoding import op2_bpe_encoding
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .jaccard_join import op10_ngram_jaccard_join
from .license_scan import op5_license_scan
from .lm_scoring import op1_lm_scoring
from .packing import op4_packing
from .preference_format import OP6_SQL, op6_preference_format
from .quality_rules import op7_quality_rules
from .token_counts import op8_token_counts
from .toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_bpe_encoding": op2_bpe_encoding,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_preference_format": op6_preference_format,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_counts": op8_token_counts,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_preference_format": OP6_SQL, "op9_embedding_dedup": OP9_SQL}
