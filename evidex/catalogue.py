"""All queries of the library outside the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidex.plans import card_queries, corpus_queries, evidence_queries, study_queries, understanding_queries

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**evidence_queries.QUERIES, **card_queries.QUERIES, **corpus_queries.QUERIES, **understanding_queries.QUERIES, **study_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
