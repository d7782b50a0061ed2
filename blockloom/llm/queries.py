"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .jaccard import OP4_SQL, op4_jaccard
from .langid import op2_language
from .mixing import OP9_SQL, op9_mix
from .neardup import op7_embeddings
from .pst import op6_suffix_tree
from .quality import op3_quality
from .substr import OP10_SQL, op10_substrings
from .tiff import op1_tiff
from .urlfilter import op8_sql, op8_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff": op1_tiff,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_jaccard": op4_jaccard,
    "op5_bpe": op5_bpe,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_embeddings": op7_embeddings,
    "op8_urls": op8_urls,
    "op9_mix": op9_mix,
    "op10_substrings": op10_substrings,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": OP4_SQL,
    "op8_urls": op8_sql(),
    "op9_mix": OP9_SQL,
    "op10_substrings": OP10_SQL,
}
