"""All core query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfall.plans import graphs, problems, relational, text, workspace


def modules() -> list:
    return [problems, relational, text, graphs, workspace]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return relational.a3_trailing_stats_by_model(spark, folder)
