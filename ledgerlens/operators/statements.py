"""Statements and line items: unpivoting, lookups, ordering in time, derived measures and ratios.

Defined results: a division by null or zero is null; an item that is present with a null value stops the
search for alternatives; missing statements give no ratios of their category; empty tables give empty
results; repeated statements on one date count as the latest inserted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accepted names of items, in order of preference.
ITEMS: dict[str, list[str]] = {
    "current_assets": ["Current Assets", "Total Current Assets"],
    "current_liabilities": ["Current Liabilities", "Total Current Liabilities"],
    "inventory": ["Inventory", "Inventories"],
    "cash": ["Cash and Cash Equivalents", "Cash", "Cash & Equivalents"],
    "total_assets": ["Total Assets"],
    "total_liabilities": ["Total Liabilities"],
    "total_equity": ["Total Equity"],
    "debt": ["Total Debt", "Long-term Debt", "Total Liabilities"],
    "revenue": ["Revenue", "Total Revenue"],
    "gross_profit": ["Gross Profit"],
    "operating_income": ["Operating Income", "Operating Profit"],
    "net_income": ["Net Income"],
    "earnings_before": ["EBIT", "Operating Income", "Operating Profit"],
    "interest": ["Interest Expense", "Interest Paid", "Finance Costs"],
    "operating_cash_flow": ["Net Cash from Operating Activities", "Cash Flow from Operations"],
    "investing_cash_flow": ["Net Cash from Investing Activities", "Cash Flow from Investing"],
    "financing_cash_flow": ["Net Cash from Financing Activities", "Cash Flow from Financing"],
    "capital_expenditures": ["Capital Expenditures"],
    "property_purchase": ["Purchase of Property, Plant and Equipment"],
}
#: (category, key, numerator, denominator, is_percentage, statements that must exist)
RATIOS = [
    ("liquidity", "current_ratio", "current_assets", "current_liabilities", False, ("balance_sheet",)),
    ("liquidity", "quick_ratio", "quick_assets", "current_liabilities", False, ("balance_sheet",)),
    ("liquidity", "cash_ratio", "cash", "current_liabilities", False, ("balance_sheet",)),
    ("profitability", "gross_margin", "gross_profit", "revenue", True, ("income_statement",)),
    ("profitability", "operating_margin", "operating_income", "revenue", True, ("income_statement",)),
    ("profitability", "net_profit_margin", "net_income", "revenue", True, ("income_statement",)),
    ("profitability", "return_on_assets", "net_income", "total_assets", True, ("income_statement", "balance_sheet")),
    ("profitability", "return_on_equity", "net_income", "total_equity", True, ("income_statement", "balance_sheet")),
    ("solvency", "debt_to_equity", "debt", "total_equity", False, ("balance_sheet",)),
    ("solvency", "debt_ratio", "total_liabilities", "total_assets", True, ("balance_sheet",)),
    ("solvency", "interest_coverage", "earnings_before", "interest", False, ("balance_sheet", "income_statement")),
]
STATEMENT_TYPES = ("balance_sheet", "income_statement", "cash_flow")


def unpivot_table(table: DataFrame, label: str, values: list[str], keys: list[str]) -> DataFrame:
    """Rows (keys, pos, name, raw_value, value) of a statement table with periods as columns.

    The first value column keeps the bare label, later ones add the column's name. Blank labels and cells
    that are blank, '-', 'nan' or no number are skipped; of repeated names the last row wins.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for k, c in enumerate(values)])
    long = table.withColumn("__row", F.monotonically_increasing_id()).select(*keys, "__row", F.col(label).alias("__label"), F.explode(cells).alias("x"))
    raw = F.trim("x.v")
    kept = long.where((F.trim("__label") != "") & ~raw.isin("", "-") & (F.lower(raw) != "nan"))
    clean = F.regexp_replace(F.regexp_replace(raw, r"[$,\s]", ""), r"^\((.*)\)$", "-$1")
    name = F.when(F.col("x.k") == 0, F.col("__label")).otherwise(F.concat(F.col("__label"), F.lit(" ("), F.col("x.c"), F.lit(")")))
    out = kept.select(*keys, name.alias("name"), raw.alias("raw_value"), clean.try_cast("double").alias("value"), F.struct("__row", "x.k").alias("__at")).where("value is not null")
    return out.groupBy(*keys, "name").agg(F.max_by("raw_value", "__at").alias("raw_value"), F.max_by("value", "__at").alias("value"))


def scaled_value(value: Column, factor: Column) -> Column:
    return value * factor


def period_label(period_type: Column, year: Column, quarter: Column, start: Column, end: Column) -> Column:
    """The label of a period without one: FYyyyy, Qn FYyyyy, a date range, or 'Undefined Period'."""
    y = F.concat(F.lit("FY"), year.cast("string"))
    return F.when((period_type == "annual") & year.isNotNull(), y).when((period_type == "quarterly") & year.isNotNull() & quarter.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), y)).when(start.isNotNull() & end.isNotNull(), F.concat(start.cast("string"), F.lit(" to "), end.cast("string"))).otherwise("Undefined Period")


def time_key(end: Column, year: Column, quarter: Column) -> Column:
    """Date that orders statements: the end date, else day 28 of the quarter's last month, else 2000-01-01."""
    month = F.least(F.lit(3) * F.coalesce(F.when(quarter != 0, quarter), F.lit(4)), F.lit(12))
    made = F.when((year >= 1) & (year <= 9999) & (month >= 1), F.make_date(year, month, F.lit(28)))
    return F.coalesce(end, made, F.lit("2000-01-01").cast("date"))


def observation_date(end: Column, period_type: Column, year: Column, quarter: Column) -> Column:
    """Date of a series' point: the end date, Dec 31 of an annual, day 30 of a quarter's last month, else null."""
    return F.coalesce(end, F.when((period_type == "annual") & year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31))).when((period_type == "quarterly") & year.isNotNull() & quarter.between(1, 4), F.make_date(year, 3 * quarter, F.lit(30))))


def latest_statements(statements: DataFrame, company: str = "company", seq: str = "seq") -> DataFrame:
    """The most recent statement of each company and type; on equal dates the latest inserted wins.

    One partial aggregate per group, no sort of a company's history.
    """
    k = time_key(F.col("end_date"), F.col("fiscal_year"), F.col("fiscal_quarter"))
    cols = [c for c in statements.columns if c not in (company, "statement_type")]
    best = statements.groupBy(company, "statement_type").agg(F.max(F.struct(k.alias("__k"), F.col(seq).alias("__s"), F.struct(*cols).alias("r"))).alias("m"))
    return best.select(company, "statement_type", "m.r.*")


def picked(items: list[str]) -> Column:
    """The struct of the first name that is present among a group's aggregated items (its value may be null)."""
    return F.coalesce(*[F.col(f"i_{_slug(n)}") for n in items])


def _slug(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)


def pivot_items(line_items: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a group with a struct (seq, value) for each known item name; the last added of a name wins."""
    names = sorted({n for ns in ITEMS.values() for n in ns})
    aggs = [F.max(F.when(F.col("name") == n, F.struct(F.col(seq).alias("s"), F.col("value").alias("v")))).alias(f"i_{_slug(n)}") for n in names]
    return line_items.where(F.col("name").isin(names)).groupBy(*keys).agg(*aggs)


def measures(pivoted: DataFrame) -> DataFrame:
    """Derived measures as columns (see ITEMS), quick assets and free cash flow."""
    keep = [c for c in pivoted.columns if not c.startswith("i_")]
    base = pivoted.select(*keep, *[picked(ns).getField("v").alias(m) for m, ns in ITEMS.items()], picked(ITEMS["inventory"]).isNotNull().alias("__inv"))
    quick = F.col("current_assets") - F.when(F.col("__inv"), F.col("inventory")).otherwise(F.lit(0.0))
    spent = F.coalesce(F.col("capital_expenditures"), F.col("property_purchase"))
    return base.withColumns({"quick_assets": quick, "free_cash_flow": F.col("operating_cash_flow") - F.abs(spent)}).drop("__inv")


def balance_valid(assets: Column, liabilities: Column, equity: Column) -> Column:
    """Whether assets equal liabilities plus equity to 0.1 % of assets; false if any is null."""
    return F.coalesce(F.abs(assets - (liabilities + equity)) <= 0.001 * assets, F.lit(False))


def ratio_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Long table of ratios from measures and the flags ``has_<statement type>``; a category appears only
    with its statements. Interest coverage has numerator and denominator only if both exist."""
    rows = []
    for cat, key, num, den, pct, need in RATIOS:
        n, d = F.col(num), F.col(den)
        if key == "interest_coverage":
            both = n.isNotNull() & d.isNotNull()
            n, d = F.when(both, n), F.when(both, d)
        have = reduce(lambda a, b: a & b, [F.col(f"has_{s}") for s in need])
        rows.append(F.when(have, F.struct(F.lit(cat).alias("category"), F.lit(key).alias("ratio_key"), F.try_divide(n, d).alias("value"), n.alias("numerator"), d.alias("denominator"), F.lit(pct).alias("is_percentage"), F.lit(not pct).alias("is_multiple"))))
    return wide.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*keys, "r.*")


def latest_ratios(line_items: DataFrame, company: str = "company", seq: str = "seq") -> DataFrame:
    """Ratios of each company's latest statements. Statement types are picked independently, so the date of
    each is kept by the caller if it matters. Input: company, statement_type, end_date, fiscal_year,
    fiscal_quarter, seq, name, value."""
    k = time_key(F.col("end_date"), F.col("fiscal_year"), F.col("fiscal_quarter"))
    # One pass: each type's greatest (date, statement number) and each item's last row; an item counts only if
    # its row is of that latest statement.
    names = sorted({n for ns in ITEMS.values() for n in ns})
    row = lambda *more: F.struct(k.alias("k"), F.col("statement_seq").alias("q"), *more)
    per = line_items.groupBy(company, "statement_type").agg(F.max(row()).alias("m"), *[F.max(F.when(F.col("name") == n, row(F.col(seq).alias("s"), F.col("value").alias("v")))).alias(f"i_{_slug(n)}") for n in names])
    item = lambda c: F.when((F.col(c)["k"] == F.col("m.k")) & (F.col(c)["q"] == F.col("m.q")), F.struct(F.col(c)["s"].alias("s"), F.col(c)["v"].alias("v")))
    own = per.select(company, "statement_type", *[item(f"i_{_slug(n)}").alias(f"i_{_slug(n)}") for n in names])
    flags = [F.max((F.col("statement_type") == s).cast("int")).cast("boolean").alias(f"has_{s}") for s in STATEMENT_TYPES]
    wide = measures(own.groupBy(company).agg(*flags, *[F.max(f"i_{_slug(n)}").alias(f"i_{_slug(n)}") for n in names]))
    return ratio_rows(wide, [company])


def where_filter(conditions: dict, columns: list[str], metadata: str | None = None) -> Column:
    """A metadata filter as a predicate: equality, $eq, $ne, $in, $nin, $gt, $gte, $lt, $lte, $and, $or.
    Names that are no columns are looked up in the ``metadata`` map; unknown operators raise."""
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
    out: Column | None = None

    def both(a: Column | None, b: Column) -> Column:
        return b if a is None else a & b

    for key, cond in (conditions or {}).items():
        if key in ("$and", "$or"):
            parts = [where_filter(x, columns, metadata) for x in cond]
            out = both(out, reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts))
            continue
        if key not in columns and metadata is None:
            raise ValueError(f"no column {key}")
        c = F.col(key) if key in columns else F.col(metadata).getItem(key)
        for op, v in (cond.items() if isinstance(cond, dict) else [("$eq", cond)]):
            if op not in ops:
                raise ValueError(f"unknown operator {op}")
            out = both(out, ops[op](c, str(v) if key not in columns and not isinstance(v, (list, tuple, set)) else v))
    return F.lit(True) if out is None else out


def section_items(sections: DataFrame, line_items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of a section (array of names) in its order; absent names are skipped."""
    return sections.select(*keys, F.posexplode("names").alias("pos", "name")).join(line_items, [*keys, "name"]).orderBy(*keys, "pos")


def last_line_item(line_items: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row an exact name: the last added wins."""
    rest = [c for c in line_items.columns if c not in (*keys, "name")]
    return line_items.groupBy(*keys, "name").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "name", "r.*")


def chunk_count(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return chunks.withColumn("chunk_count", F.count("*").over(Window.partitionBy(doc)))


def of_company(statements: DataFrame, company: str | None, column: str = "company_name") -> DataFrame:
    """Statements of a company, by exact name; an empty or null name filters nothing."""
    return statements.where(F.col(column) == company) if company else statements


def by_type(statements: DataFrame, kind: str | None = None) -> DataFrame:
    """Statements of the three analysed types (other types are dropped), or of one of them."""
    return statements.where(F.col("statement_type").isin(*STATEMENT_TYPES) if kind is None else F.col("statement_type") == kind)


def period_faults(rows: DataFrame, checks: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows with ``fault``: the first column whose value lies outside its range; nulls are allowed."""
    bad = [F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in checks.items()]
    return rows.withColumn("fault", F.coalesce(*bad)).where("fault is not null")


def first_present(line_items: DataFrame, keys: list[str], names: list[str], seq: str = "seq") -> DataFrame:
    """(keys, name, value): the first of ``names`` that a group has as an item, though its value may be null; of a
    repeated name the last added wins."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    last = line_items.where(F.col("name").isin(names)).groupBy(*keys, "name").agg(F.max_by(F.struct("value"), F.col(seq)).alias("v"))
    return last.groupBy(*keys).agg(F.min(F.struct(place.alias("p"), "name", "v")).alias("m")).select(*keys, "m.name", "m.v.value")


def metric_points(measured: DataFrame, items: DataFrame, keys: list[str], metric: str | Column, label: str | None = None) -> DataFrame:
    """(keys, metric, value) of a metric: a column of ``measured`` if it has one of that name, else line items of
    that name, or any expression over ``measured``. Null values are left out with their period."""
    if isinstance(metric, Column):
        out = measured.select(*keys, F.lit(label or "custom_metric").alias("metric"), metric.cast("double").alias("value"))
    elif metric in measured.columns:
        out = measured.select(*keys, F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))
    else:
        out = items.where(F.col("name") == metric).select(*keys, F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))
    return out.where("value is not null")
