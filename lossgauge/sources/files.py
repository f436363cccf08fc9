"""The inputs of the three analyses, each with its separator, encoding and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossgauge.sources.delimited import read_delimited


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """Loss observations: country, year, commodity, stage, method and percentage; more may follow."""
    return read_delimited(
        spark, path, types={"m49_code": "int", "year": "int", "loss_percentage": "double"}
    )


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicator series in Latin-1, one text column per year, ``..`` for missing."""
    return read_delimited(spark, path, encoding="ISO-8859-1")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Country, Region, Income."""
    return read_delimited(spark, path, sep=";")


def read_commodities(spark: SparkSession, path: str) -> DataFrame:
    """Commodities, Commodity Groups."""
    return read_delimited(spark, path, sep=";")


def read_renames(spark: SparkSession, path: str) -> DataFrame:
    """Old name, canonical name."""
    return read_delimited(spark, path, sep=";")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policy catalogue with survey ranks and factor loading; texts may hold line breaks."""
    surveys = {f"survey_{i}": "int" for i in range(1, 6)}
    return read_delimited(
        spark, path, sep=";", multiline=True, types={**surveys, "factor_loadings": "double"}
    )
