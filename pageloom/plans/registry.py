"""All queries of the core engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect(*modules) -> tuple[dict[str, Query], dict[str, str]]:
    """The queries of `modules`, and the SQL of those that have some."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for m in modules:
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pages for every case's question."""
    from . import retrieval

    return retrieval.bm25_topk(spark, sf_dir, every=1)


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import annotation, comparison, governance, pages, retrieval, segmentation, selection, spans, verification

    return collect(pages, segmentation, retrieval, spans, governance, comparison, verification, annotation, selection)


QUERIES, SQL = _all()
