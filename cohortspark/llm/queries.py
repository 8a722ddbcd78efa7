"""Queries of this subpackage, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, line_dedup, sort_means
from .chat_format import op9_chat_format
from .decontamination import op2_decontamination
from .language_id import op7_language_id
from .line_dedup import op11_line_dedup
from .main_text import op4_main_text
from .near_duplicates import op1_near_duplicates
from .neighbours import op8_nearest_neighbours
from .quality import op6_quality
from .runs import op13_periodic_runs
from .secrets import op5_secret_scans
from .sentencepieces import op10_sentencepiece
from .sort_means import op12_centroid_clusters
from .token_counts import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_main_text": op4_main_text,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_chat_format": op9_chat_format,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_line_dedup": op11_line_dedup,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op12_centroid_clusters": sort_means.ORACLE,
}
