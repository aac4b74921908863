"""The registered queries of the evidence engine and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.plans import contract_queries, corpus_queries, evidence_queries, learned_queries, perception_queries, retrieval_queries, rule_queries, scoring_queries, sequence_queries, window_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (retrieval_queries, window_queries, sequence_queries, evidence_queries, rule_queries, scoring_queries, perception_queries, learned_queries, corpus_queries, contract_queries)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
