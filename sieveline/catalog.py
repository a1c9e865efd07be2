"""Every registered query by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.plans import aggregates, answers, crawl, discovery, evidence, filters, joins, packs, pages, plain, probes, quality, ranking, records, retrieval, rules, seeds, shaping, stores, streams, texts  # noqa: F401
from sieveline.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry statistics by domain, the roll-up that the other reports build on."""
    return QUERIES["a01_entry_statistics"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
