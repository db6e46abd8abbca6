"""Queries of the unit operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.units import normalize_units, unit_repairs
from ledgerlens.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_repairs(table(spark, d, "line_items"), table(spark, d, "unit_catalog"))


def p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Every readable item with its amount, where unit and scale came from, and the mixture's doubt."""
    li = table(spark, d, "line_items").select("item_id", "currency", "value", "raw_value", "unit", "scaling_factor")
    n = normalize_units(li, table(spark, d, "unit_catalog"))
    return n.where("amount_e4 is not null").select("item_id", "common_unit", F.col("amount_e4").alias("common_e4"), "unit_source", "scale_source", F.round("unit_posterior", 6).alias("unit_posterior"), "unit_uncertain").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_quantities": p2_quantities}


def oracle_sql() -> dict[str, str]:
    return {}
