"""Findings from ratios and trends by tables of bounds, and further derived columns of documents.

Bounds are data: one row a rule, joined to the ratios, so other bounds are another table. Defined results:
null values give no finding; a value outside every bound of its ratio gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.session import broadcast_if_small

# Fixed values: (rule, ratio, lower bound, whether it belongs, upper bound, whether it belongs, category).
BOUNDS = [
    ("current_strong", "current_ratio", 2.0, True, None, False, "strength"), ("current_adequate", "current_ratio", 1.5, True, 2.0, False, "strength"), ("current_tight", "current_ratio", 1.0, True, 1.5, False, "risk"), ("current_short", "current_ratio", None, False, 1.0, False, "weakness"),
    ("quick_good", "quick_ratio", 1.0, True, None, False, "strength"), ("quick_low", "quick_ratio", None, False, 0.7, False, "risk"),
    ("margin_strong", "net_profit_margin", 0.15, True, None, False, "strength"), ("margin_good", "net_profit_margin", 0.08, True, 0.15, False, "strength"), ("margin_loss", "net_profit_margin", None, False, 0.0, True, "weakness"),
    ("roe_strong", "return_on_equity", 0.20, True, None, False, "strength"), ("roe_low", "return_on_equity", 0.0, False, 0.05, False, "weakness"), ("roe_negative", "return_on_equity", None, False, 0.0, True, "weakness"),
    ("leverage_high", "debt_to_equity", 2.0, True, None, False, "risk"), ("leverage_low", "debt_to_equity", None, False, 0.5, True, "strength"), ("coverage_strong", "interest_coverage", 5.0, True, None, False, "strength"), ("coverage_weak", "interest_coverage", None, False, 2.0, True, "risk"),
]
BOUNDS_SCHEMA = "rule_id string, ratio_key string, low double, low_in boolean, high double, high_in boolean, finding string"


def bounds_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or BOUNDS, BOUNDS_SCHEMA)


def ratio_findings(ratios: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ratios with each rule whose bounds hold them (an equi-join on the ratio, then the bounds)."""
    j = ratios.where("value is not null").join(broadcast_if_small(bounds, 10_000), "ratio_key")
    low = F.col("low").isNull() | (F.col("value") > F.col("low")) | (F.col("low_in") & (F.col("value") == F.col("low")))
    high = F.col("high").isNull() | (F.col("value") < F.col("high")) | (F.col("high_in") & (F.col("value") == F.col("high")))
    return j.where(low & high).drop("low", "low_in", "high", "high_in")


# Fixed values: (rule, metric, direction, category) of significant trends.
TREND_RULES = [
    ("revenue_rising", "revenue", "increasing", "trend"), ("revenue_falling", "revenue", "decreasing", "risk"), ("net_income_rising", "net_income", "increasing", "trend"), ("net_income_falling", "net_income", "decreasing", "risk"),
    ("operating_cash_rising", "operating_cash_flow", "increasing", "strength"), ("operating_cash_falling", "operating_cash_flow", "decreasing", "risk"),
]


def trend_findings(trends: DataFrame, keys: list[str], rules: list[tuple] | None = None) -> DataFrame:
    """(keys, rule_id, finding) of trends (keys, metric, direction, is_significant): significant ones by the rules'
    table, and comparisons of two metrics of a series. Metrics that a series lacks take part in no comparison."""
    table = trends.sparkSession.createDataFrame(rules or TREND_RULES, "rule_id string, metric string, direction string, finding string")
    single = trends.where("is_significant").join(broadcast_if_small(table, 10_000), ["metric", "direction"]).select(*keys, "rule_id", "finding")
    # One row a series: a few directions side by side, summed before the shuffle.
    side = trends.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.struct("direction", "is_significant"))).alias(m) for m in ("revenue", "net_income", "operating_cash_flow")])
    up = lambda m: F.col(f"{m}.direction") == "increasing"
    pairs = F.array(
        F.when(up("net_income") & F.col("net_income.is_significant") & ~up("revenue"), F.struct(F.lit("income_without_revenue").alias("rule_id"), F.lit("strength").alias("finding"))),
        F.when(up("net_income") & ~up("operating_cash_flow"), F.struct(F.lit("income_without_cash").alias("rule_id"), F.lit("risk").alias("finding"))),
        F.when(~up("net_income") & up("operating_cash_flow"), F.struct(F.lit("cash_without_income").alias("rule_id"), F.lit("opportunity").alias("finding"))),
    )
    return single.unionByName(side.select(*keys, F.explode(F.array_compact(pairs)).alias("p")).select(*keys, "p.rule_id", "p.finding"))


def all_findings(ratios: DataFrame, bounds: DataFrame, trends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, rule_id, finding) of the ratios' bounds and the trends' rules."""
    r = ratio_findings(ratios, bounds).select(*keys, F.lit("ratio").alias("source"), "rule_id", "finding")
    return r.unionByName(trend_findings(trends, keys).select(*keys, F.lit("trend").alias("source"), "rule_id", "finding"))


def query_type(query: Column, hits: Column) -> Column:
    """analysis, summarization or query of a question and its joined hits, by the words they contain."""
    low = F.lower(F.concat_ws(" ", query, hits))
    words = [F.contains(low, F.lit(t)).cast("int") for t in V.CHUNK_TERMS]
    n = words[0]
    for w in words[1:]:
        n = n + w
    asks = F.lower(query).rlike("summar|overview|key points|main findings")
    return F.when((n > 2) | F.contains(F.lower(query), F.lit("financial analysis")), "analysis").when(asks | (F.length(hits) > 10_000), "summarization").otherwise("query")


def context_metadata(metadata: Column) -> Column:
    """The metadata keys a prompt may hold, as JSON."""
    return F.to_json(F.map_filter(metadata, lambda k, v: k.isin(V.CONTEXT_KEYS) & v.isNotNull()))


def table_context(pages: DataFrame, tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text around each table: with k = paragraphs / tables (at least 1), paragraphs i*k-2 up to (i+1)*k+2.

    ``pages`` has a text per document, ``tables`` a table_index among all tables of the document.
    """
    n = tables.groupBy(doc).agg(F.count("*").alias("__n"))
    p = pages.join(n, doc).withColumn("__p", F.split("text", "\n\n"))
    k = F.greatest(F.floor(F.size("__p") / F.col("__n")), F.lit(1)).cast("int")
    j = tables.join(p.withColumn("__k", k), doc)
    first = F.greatest(F.col("table_index") * F.col("__k") - 2, F.lit(0))
    last = F.least((F.col("table_index") + 1) * F.col("__k") + 2, F.size("__p"))
    return j.withColumn("context", F.concat_ws("\n\n", F.slice("__p", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")))).drop("__p", "__n", "__k", "text")


def cached_embeddings(texts: DataFrame, cache: DataFrame, encode, text: str = "text") -> DataFrame:
    """``texts`` with ``embedding``, taken from ``cache`` (text_key, embedding) where it holds the text; only
    distinct texts it lacks are encoded by ``encode`` (Column -> Column)."""
    keyed = texts.withColumn("text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    lacking = keyed.select("text_key", text).dropDuplicates(["text_key"]).join(cache.select("text_key"), "text_key", "left_anti")
    both = cache.select("text_key", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(lacking.select("text_key", encode(F.col(text)).alias("embedding")))
    return keyed.join(both, "text_key", "left").drop("text_key")
