"""Queries of the operators of this subpackage, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import canonical, entities, leakage, mixing, ocr, pii, sentences
from ledgerlens.sources.tables import table

#: The vocabulary file of a public tokenizer, on the driver.
TOKENIZER = os.environ.get("LEDGERLENS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _pii_texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, rec_id, text) of chunk content and entity context."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text"))
    ents = table(spark, d, "entities").select(F.lit("entities").alias("src"), F.col("entity_id").alias("rec_id"), F.col("context").alias("text"))
    return chunks.unionByName(ents).where("rec_id is not null and text is not null").dropDuplicates(["src", "rec_id", "text"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_pii_texts(spark, d), ["src", "rec_id"]).select("src", "rec_id", "pii_type", "start_char", "end_char").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(_pii_texts(spark, d)).select("src", "rec_id", "redacted")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = ocr.repair_scans(table(spark, d, "chunks").select("chunk_id", "content"))
    return r.select("chunk_id", F.explode("findings").alias("f")).select("chunk_id", "f.noise_kind", "f.line_no", "f.fixed").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair_scans(table(spark, d, "chunks").select("chunk_id", "content")).select("chunk_id", "repaired", F.size("findings").alias("n_findings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.account_mappings(table(spark, d, "line_items"), table(spark, d, "accounts"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that no entry of the list fits, with their counts."""
    li = table(spark, d, "line_items").where("name is not null")
    m = canonical.map_names(li, table(spark, d, "accounts"), "statement_type", "name", "statement", "account_id", "account", [], canonical.accounting_aliases(spark), "statement_id")
    return m.where("canonical_id = 0").groupBy("statement_type", "name").agg(F.count("*").alias("n_items"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "statements").select(F.col("company_name").alias("name")).unionByName(table(spark, d, "upload_requests").select(F.col("reporting_entity").alias("name")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.name_pairs(entities.resolve_names(_names(spark, d)))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity, called by the first of its spellings."""
    r = entities.resolve_names(_names(spark, d))
    first = r.groupBy("entity_id").agg(F.min("name").alias("entity"), F.count("*").alias("n_spellings"))
    return r.join(first, "entity_id").select("name", "entity", "n_spellings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked: in how many documents, and the largest part held."""
    f = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return f.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("coverage"), 6).alias("largest_part"), F.min("edits").alias("fewest_edits"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_records(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)[1]


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_records(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return sentences.split_sentences(docs, sentences.learn(docs)).select("doc_id", "start_char")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return sentences.split_sentences(docs, sentences.learn(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_redacted, p3_found, p3_repaired, p4_found, p4_unmatched, p5_found, p5_entities, p6_found, p6_coverage, p7_shares, p7_records, p8_found, p8_sentences)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be put as SQL on whole tables; tests compare them with brute force."""
    return {}
