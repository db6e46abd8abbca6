"""Statements out of documents: tables in text, the test for financial tables, line items and statements.

Defined results: null and blank texts give no tables; tables of one row or one column are left out; a table
that fails the test, or whose context names no statement, is reported in the log and gives no items; labels
without a readable number give no item; of repeated labels in a table the last wins; a document without a
period has an annual one without a year. A repeated document gives its statements twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.operators import detect
from ledgerlens.operators.insights import table_context

_GAP = re.compile(r"\t+|\s{2,}")
_UNDERLINE = re.compile(r"[\s|:=+_-]*")


def cells_of(line: str) -> list[str]:
    """Cells of a line: split at bars, else at tabs or wider gaps."""
    parts = line.strip().strip("|").split("|") if "|" in line else _GAP.split(line.strip())
    return [p.strip() for p in parts]


def text_tables(text: str) -> list[list[list[str]]]:
    """Runs of lines with at least two cells, as rows of equal width; shorter rows are filled with blanks."""
    out: list[list[list[str]]] = []
    run: list[list[str]] = []
    for line in [*text.split("\n"), ""]:
        cells = cells_of(line) if line.strip() and not _UNDERLINE.fullmatch(line) else []
        if len(cells) > 1:
            run.append(cells)
        elif not (run and line.strip() and _UNDERLINE.fullmatch(line)):
            if len(run) > 1:
                width = max(map(len, run))
                out.append([r + [""] * (width - len(r)) for r in run])
            run = []
    return out


def extract_tables(docs: DataFrame, doc: str = "doc_id", text: str = "content") -> DataFrame:
    """(doc, table_index, header, rows): a table a row, in their order in the text; the first line is the header."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(d, k, t[0], t[1:]) for d, x in zip(p["d"], p["t"]) for k, t in enumerate(text_tables(x))]
            yield pd.DataFrame(rows, columns=[doc, "table_index", "header", "rows"])

    src = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"{doc} {kind}, table_index int, header array<string>, rows array<array<string>>")


def is_financial_table(cells: Column) -> Column:
    """Whether at least three of the listed words stand in an array of cells, and a cell starts with an amount."""
    low = F.array_join(F.transform(cells, F.lower), "\n")
    n = sum((F.contains(low, F.lit(w)).cast("int") for w in V.TABLE_WORDS), F.lit(0))
    return (n >= 3) & F.exists(cells, lambda c: F.coalesce(c.rlike("^(?:" + V.AMOUNT_START + ")"), F.lit(False)))


def table_items(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Line items (keys, name, raw_value, value) of tables (header, rows): the first column is the label; the
    second keeps it bare, later ones add their header."""
    r = tables.select(*keys, "header", F.posexplode("rows").alias("row", "cells"))
    c = r.select(*keys, "header", "row", F.element_at("cells", 1).alias("label"), F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("col", "raw"))
    raw = F.trim("raw")
    number = F.regexp_replace(F.regexp_replace(raw, r"[$,\s]", ""), r"^\((.*)\)$", "-$1").try_cast("double")
    name = F.when(F.col("col") == 0, F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.coalesce(F.get("header", F.col("col") + 1), F.lit("")), F.lit(")")))
    kept = c.where(F.trim("label") != "").select(*keys, name.alias("name"), raw.alias("raw_value"), number.alias("value"), F.struct("row", "col").alias("at")).where("value is not null and raw_value not in ('', '-') and lower(raw_value) <> 'nan'")
    return kept.groupBy(*keys, "name").agg(F.max_by("raw_value", "at").alias("raw_value"), F.max_by("value", "at").alias("value"))


def parse_statements(docs: DataFrame, doc: str = "doc_id", text: str = "content", head: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, line_items, log) of documents. Company and period come from the first ``head`` characters, as
    the parser defines them; a statement's type and confidence from the text around its table."""
    first = F.substring(text, 1, head)
    top = docs.select(doc, F.col(text).alias("text"), detect.company_info(first)["name"].alias("company_name"), F.get(detect.periods(first), 0).alias("period"))
    tables = extract_tables(docs, doc, text)
    judged = tables.withColumn("financial", is_financial_table(F.flatten(F.concat(F.array("header"), F.col("rows")))))
    around = table_context(top.select(doc, "text"), judged, doc)
    kind, conf = detect.statement_keywords(F.col("context"))
    typed = around.withColumns({"statement_type": F.when(F.col("financial"), kind).otherwise("unknown"), "confidence_score": conf})
    good = typed.where("statement_type <> 'unknown'").withColumn("statement_id", F.concat_ws("_", F.col(doc).cast("string"), F.lit("table"), F.col("table_index").cast("string")))
    info = top.select(doc, "company_name", F.coalesce(F.col("period.period_type"), F.lit("annual")).alias("period_type"), "period.fiscal_year", "period.fiscal_quarter", "period.end_date", F.when(F.col("period").isNull(), "Unknown Period").alias("label"))
    statements = good.select("statement_id", doc, "table_index", "statement_type", "confidence_score").join(info, doc)
    log = typed.where("statement_type = 'unknown'").select(doc, "table_index", F.when(F.col("financial"), "no statement named around the table").otherwise("not a financial table").alias("message"))
    return statements, table_items(good.select("statement_id", "header", "rows"), ["statement_id"]), log


def parse_summary(docs: DataFrame, statements: DataFrame, log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: statements found, mean confidence (null without any), messages, whether none was logged."""
    n = statements.groupBy(doc).agg(F.count("*").alias("n_statements"), F.avg("confidence_score").alias("confidence"))
    m = log.groupBy(doc).agg(F.count("*").alias("n_messages"))
    j = docs.select(doc).distinct().join(n, doc, "left").join(m, doc, "left")
    return j.select(doc, F.coalesce("n_statements", F.lit(0)).alias("n_statements"), "confidence", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.col("n_messages").isNull().alias("successful"))
