"""Quality reports over chunks and collections.

Defined results: shares over an empty table are null or absent; null types and entities form no group of
their own unless stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V


def collection_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, documents, tables and mean length per group."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.countDistinct(F.nullif(F.col("doc_id"), F.lit(""))).alias("n_docs"), F.sum(F.col("contains_table").cast("int")).alias("n_tables"), F.round(F.avg(F.length("content")), 4).alias("mean_chars"))


def type_shares(chunks: DataFrame, col: str = "statement_type") -> DataFrame:
    """Histogram of a column with shares in percent; the window runs over the few groups."""
    g = chunks.groupBy(col).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def entity_frequency(chunks: DataFrame, entities: str = "financial_entities", most: int = 15) -> DataFrame:
    """The ``most`` most frequent entities (a top-k report)."""
    return chunks.select(F.explode(entities).alias("entity")).groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(most)


def entity_coverage(chunks: DataFrame, entities: str = "financial_entities") -> DataFrame:
    """Each expected entity: in how many chunks it stands, whether at all, and the coverage in percent."""
    spark = chunks.sparkSession
    want = spark.createDataFrame([(e,) for e in V.EXPECTED_ENTITIES], "entity string")
    have = chunks.select("chunk_id", F.explode(entities).alias("e")).groupBy(F.lower("e").alias("entity")).agg(F.countDistinct("chunk_id").alias("n"))
    j = F.broadcast(want).join(have, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n_chunks"))
    return j.withColumn("coverage_percent", F.round(100.0 * F.avg((F.col("n_chunks") > 0).cast("int")).over(Window.partitionBy(F.lit(1))), 4))


def chunk_consistency(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Mean length, share with entities, mean entities, whether all have a type."""
    n = F.greatest(F.size("financial_entities"), F.lit(0))
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 4).alias("mean_chars"), F.round(100.0 * F.avg((n > 0).cast("int")), 4).alias("with_entities_percent"), F.round(F.avg(n), 4).alias("mean_entities"), F.bool_and(F.col("statement_type").isNotNull()).alias("all_typed"))


def boundary_violations(chunks: DataFrame, source: str, page: str, kind: str, section: str) -> DataFrame:
    """Pairs of successive pages of a source where the type changes though the section does not."""
    w = Window.partitionBy(source).orderBy(page, "chunk_id")
    p = chunks.where(F.col(page).isNotNull()).withColumns({"prev_page": F.lag(page).over(w), "prev_kind": F.lag(kind).over(w), "prev_section": F.lag(section).over(w)})
    return p.where((F.col(page) - F.col("prev_page") == 1) & (F.col(kind) != F.col("prev_kind")) & (F.coalesce(F.col(section), F.lit("")) == F.coalesce("prev_section", F.lit(""))))
