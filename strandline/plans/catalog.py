"""Named queries over the star-schema tables and their SQL oracles, group by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import corpus_queries, dataset_queries, graph_queries, relation_queries, source_queries, structure_queries, text_queries, vector_queries

_GROUPS = (relation_queries, graph_queries, text_queries, vector_queries, corpus_queries, source_queries, structure_queries, dataset_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for g in _GROUPS for name, (query, _) in g.CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in _GROUPS for name, (_, sql) in g.CATALOG.items() if sql}
