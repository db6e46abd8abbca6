"""Named collections of chunks as Parquet tables.

Defined results: adding no rows changes nothing; an id already stored is not added again; repeated ids
within one addition are stored once; deleting unknown ids or collections changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.statements import where_filter
from ledgerlens.session import shared_checkpoint

PREFIX = "collection_"


class Collection:
    """One collection; ``key`` is the id column."""

    def __init__(self, spark: SparkSession, name: str, key: str = "chunk_id"):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"bad collection name {name!r}")
        self.spark, self.name, self.key, self.table = spark, name, key, PREFIX + name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, chunks: DataFrame) -> None:
        """Append rows whose id is new: an anti-join on the id, no rewrite of what is stored."""
        new = chunks.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        if self.exists():
            new = new.join(self.rows().select(self.key), self.key, "left_anti").select(*[c for c in self.rows().columns if c in new.columns])
        new.write.mode("append").format("parquet").saveAsTable(self.table)

    def get(self, ids: list[str]) -> DataFrame:
        return self.rows().where(F.col(self.key).isin(ids))

    def filter(self, where: dict) -> DataFrame:
        d = self.rows()
        return d.where(where_filter(where, d.columns, "metadata" if "metadata" in d.columns else None))

    def delete(self, ids: DataFrame) -> None:
        """Drop rows by id: the rest is written anew, as plain Parquet has no delete."""
        if not self.exists():
            return
        rest = shared_checkpoint(self.rows().join(ids.select(self.key).distinct(), self.key, "left_anti"))
        rest.write.mode("overwrite").format("parquet").saveAsTable(self.table)

    def count(self) -> int:
        return self.rows().count() if self.exists() else 0

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def collections(spark: SparkSession) -> list[str]:
    return sorted(t.name[len(PREFIX) :] for t in spark.catalog.listTables() if t.name.startswith(PREFIX))
