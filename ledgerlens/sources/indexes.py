"""Indexes saved as Parquet tables and loaded again, with the fitted topic model beside them.

Defined results: saving replaces what the folder held; a folder that lacks one of the tables loads as
absent (None), never in part; an index without a model loads with the model None.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.topics import TopicModel

TABLES = ("documents", "entities", "topics")
MODEL = ("model_terms", "model_centres")


class Index(NamedTuple):
    documents: DataFrame
    entities: DataFrame
    topics: DataFrame
    model: TopicModel | None


def save_index(index: Index, folder: str) -> None:
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = index.documents.sparkSession
    if index.model is not None:
        for name, t in zip(MODEL, index.model.tables(spark)):
            t.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> Index | None:
    try:
        tables = [spark.read.parquet(f"{folder}/{name}") for name in TABLES]
    except AnalysisException:
        return None
    try:
        model = TopicModel.from_tables(*[spark.read.parquet(f"{folder}/{name}") for name in MODEL])
    except AnalysisException:
        model = None
    return Index(*tables, model)
