"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmesh.plans import data_queries, graph_queries, text_queries

_ALL = [*graph_queries.QUERIES, *data_queries.QUERIES, *text_queries.QUERIES]
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE_SQL = {f.__name__: sql for f, sql in _ALL if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by a question seed a walk over the page graph; the best are packed under a budget."""
    return graph_queries.mode_b_rank(spark, sf_dir)
