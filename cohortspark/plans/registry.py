"""Queries over the reference operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assessment_queries, clinical_queries, encounter_queries, entity_queries, evaluation_queries, ranking_queries, resolution_queries, search_queries, upkeep_queries, workflow_queries

_PARTS = (encounter_queries, evaluation_queries, ranking_queries, clinical_queries, workflow_queries, entity_queries, resolution_queries, assessment_queries, search_queries, upkeep_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
