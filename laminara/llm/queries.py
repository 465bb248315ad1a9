"""The queries of this subpackage, each on its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laminara.llm.heap_lloyd import OP12_SQL, op12_codes
from laminara.llm.katz import op3_katz
from laminara.llm.learned_partitions import op11_partitions
from laminara.llm.mixing import op9_mixing
from laminara.llm.pii import op5_pii
from laminara.llm.quality_crf import op1_quality
from laminara.llm.recompression import op8_recompression
from laminara.llm.simhash import op2_simhash
from laminara.llm.sp_bpe import op10_sentencepiece
from laminara.llm.spelling import OP13_SQL, op13_spelling
from laminara.llm.tool_calls import OP7_SQL, op7_tool_calls
from laminara.llm.topk_threshold import OP4_SQL, op4_threshold
from laminara.llm.toxicity_mil import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_crf": op1_quality,
        "op2_simhash_multi_index": op2_simhash,
        "op3_katz_backoff": op3_katz,
        "op4_threshold_topk": op4_threshold,
        "op5_pii_surrogates": op5_pii,
        "op6_toxicity_mil": op6_toxicity,
        "op7_tool_calls": op7_tool_calls,
        "op8_recompression": op8_recompression,
        "op9_soft_mixing": op9_mixing,
        "op10_sentencepiece_backtracking": op10_sentencepiece,
        "op11_learned_partitions": op11_partitions,
        "op12_heap_lloyd": op12_codes,
        "op13_spelling_variants": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_threshold_topk": OP4_SQL,
        "op7_tool_calls": OP7_SQL,
        "op12_heap_lloyd": OP12_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
