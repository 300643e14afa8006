"""All registered queries of the reference's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.plans import entities, evaluation, filings, formats, reports, retrieval, rules, scorecards, texts

FLAGSHIP = "agg_client_comparison"
MODULES = (scorecards, entities, retrieval, evaluation, rules, texts, formats, filings, reports)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
