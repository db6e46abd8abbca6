"""Queries over statements, with the star schema's sales as the companies' accounts (a nation is a company)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.tagging import format_ratio
from ledgerlens.operators import insights as N
from ledgerlens.operators import statements as S
from ledgerlens.operators import trends as T
from ledgerlens.session import bounded_rows
from ledgerlens.sources.tables import table


def yearly_facts(spark: SparkSession, d: str, quarter: bool = False) -> DataFrame:
    """Sales per nation and year (and quarter): sums are partial before any shuffle of the large table."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    # Exact decimals per line, so sums don't depend on their order.
    price, disc, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    per = li.groupBy("l_orderkey").agg(
        F.sum(price * (F.lit(1).cast("decimal(4,2)") - disc)).alias("revenue"), F.sum(price * F.lit("0.6").cast("decimal(2,1)")).alias("cost"), F.sum(price * tax).alias("expense"),
        F.sum(F.when(F.col("l_returnflag") == "R", price * F.lit("0.02").cast("decimal(3,2)"))).alias("interest"), F.sum("l_quantity").alias("quantity"),
    )
    j = per.join(o, per.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("c_nationkey"), F.year("o_orderdate").alias("fiscal_year"), *([F.quarter("o_orderdate").alias("fiscal_quarter")] if quarter else [])]
    g = j.groupBy(*keys).agg(*[F.coalesce(F.sum(x).cast("double"), F.lit(0.0)).alias(x) for x in ("revenue", "cost", "expense", "interest", "quantity")])
    return g.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "company")


FACTS_SQL = """
facts AS (
  SELECT n_name AS company, c_nationkey AS nk, year(o_orderdate) AS fiscal_year, {q} AS fiscal_quarter,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(0.6 AS DECIMAL(2,1))) AS DOUBLE) AS cost, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))*CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS expense,
    CAST(coalesce(sum(CASE WHEN l_returnflag='R' THEN CAST(l_extendedprice AS DECIMAL(12,2))*CAST(0.02 AS DECIMAL(3,2)) END),0) AS DOUBLE) AS interest, sum(l_quantity) AS quantity
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  GROUP BY ALL)"""
YEAR_SQL, QUARTER_SQL = FACTS_SQL.format(q="NULL"), FACTS_SQL.format(q="quarter(o_orderdate)")


def line_items(spark: SparkSession, d: str) -> DataFrame:
    """Long line items of three statements a nation and year. Long-term debt of even nations is present but null."""
    f = yearly_facts(spark, d)
    bal = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(F.greatest(F.col("c_acctbal").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))).cast("double").alias("pos"), F.sum(F.greatest(-F.col("c_acctbal").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))).cast("double").alias("neg"))
    f = f.join(F.broadcast(bal), "c_nationkey")
    k = (F.col("fiscal_year") - 1990) / 10.0
    ca, cl = F.col("pos") * k, F.col("neg") * k
    gp = F.col("revenue") - F.col("cost")
    oi = gp - F.col("expense")
    ni = oi - F.col("interest")
    b, i, c = "balance_sheet", "income_statement", "cash_flow"
    rows = [
        (b, "Total Current Assets", ca), (b, "Total Current Liabilities", cl), (b, "Inventory", F.col("quantity") * 10.0), (b, "Cash and Cash Equivalents", ca * 0.25), (b, "Total Assets", ca * 3.0), (b, "Total Liabilities", cl * 2.0 + ca),
        (b, "Total Equity", ca * 3.0 - (cl * 2.0 + ca)), (b, "Long-term Debt", F.when(F.col("c_nationkey") % 2 == 1, cl * 0.5)),
        (i, "Revenue", F.col("revenue")), (i, "Gross Profit", gp), (i, "Operating Income", oi), (i, "Interest Expense", F.col("interest")), (i, "Net Income", ni),
        (c, "Net Cash from Operating Activities", ni + F.col("expense")), (c, "Capital Expenditures", -F.col("expense") * 0.5),
    ]
    arr = F.array(*[F.struct(F.lit(t).alias("statement_type"), F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(q).cast("long").alias("seq")) for q, (t, n, v) in enumerate(rows)])
    return f.select("company", F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("end_date"), "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"), F.col("fiscal_year").alias("statement_seq"), F.explode(arr).alias("r")).select("company", "end_date", "fiscal_year", "fiscal_quarter", "statement_seq", "r.*")


ITEMS_SQL = f"""
WITH {YEAR_SQL},
bal AS (SELECT c_nationkey AS nk, CAST(sum(greatest(CAST(c_acctbal AS DECIMAL(12,2)),0)) AS DOUBLE) AS pos, CAST(sum(greatest(-CAST(c_acctbal AS DECIMAL(12,2)),0)) AS DOUBLE) AS neg FROM customer GROUP BY 1),
w AS (SELECT company, fiscal_year, pos*((fiscal_year-1990)/10.0) AS ca, neg*((fiscal_year-1990)/10.0) AS cl, f.nk,
  revenue, revenue-cost AS gp, revenue-cost-expense AS oi, revenue-cost-expense-interest AS ni, interest, expense, quantity
  FROM facts f JOIN bal USING (nk)),
m AS (SELECT company, fiscal_year, ca, cl, CAST(quantity*10 AS DOUBLE) AS inv, ca*0.25 AS cash, ca*3 AS ta, cl*2+ca AS tl, ca*3-(cl*2+ca) AS te,
  CASE WHEN nk%2=1 THEN cl*0.5 END AS debt, revenue, gp, oi, ni, interest, ni+expense AS ocf, -expense*0.5 AS capex FROM w),
last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC)=1)"""


def latest_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = S.latest_ratios(line_items(spark, d))
    return r.select("company", "category", "ratio_key", F.round("value", 6).alias("value"), F.round("numerator", 5).alias("numerator"), F.round("denominator", 5).alias("denominator"), "is_percentage", "is_multiple")


_RATIO_SQL = [("liquidity", "current_ratio", "ca", "cl", False), ("liquidity", "quick_ratio", "ca-inv", "cl", False), ("liquidity", "cash_ratio", "cash", "cl", False), ("profitability", "gross_margin", "gp", "revenue", True), ("profitability", "operating_margin", "oi", "revenue", True), ("profitability", "net_profit_margin", "ni", "revenue", True), ("profitability", "return_on_assets", "ni", "ta", True), ("profitability", "return_on_equity", "ni", "te", True), ("solvency", "debt_to_equity", "debt", "te", False), ("solvency", "debt_ratio", "tl", "ta", True), ("solvency", "interest_coverage", "oi", "interest", False)]
LATEST_RATIOS_SQL = ITEMS_SQL + " UNION ALL ".join(
    f" SELECT company, '{c}' AS category, '{k}' AS ratio_key, round(({n})/nullif({d},0),6) AS value, round({n},5) AS numerator, round({d},5) AS denominator, {str(p).lower()} AS is_percentage, {str(not p).lower()} AS is_multiple FROM last" for c, k, n, d, p in _RATIO_SQL
)


def latest_statement_dates(spark: SparkSession, d: str) -> DataFrame:
    """The latest statement of each company and type in the statements table (end date, else year and
    quarter), repeated rows once."""
    s = table(spark, d, "statements").where("company_name is not null and statement_type is not null").dropDuplicates(["statement_id"])
    x = s.select(F.col("company_name").alias("company"), "statement_type", "statement_id", "end_date", "fiscal_year", "fiscal_quarter")
    out = S.latest_statements(x, seq="statement_id")
    return out.select("company", "statement_type", "statement_id", S.time_key(F.col("end_date"), F.col("fiscal_year"), F.col("fiscal_quarter")).alias("time_key"))


LATEST_DATES_SQL = """
WITH s AS (SELECT DISTINCT company_name AS company, statement_type, statement_id, coalesce(end_date,
  CASE WHEN fiscal_year IS NOT NULL THEN make_date(fiscal_year, least(3*coalesce(nullif(fiscal_quarter,0),4),12), 28) END, DATE '2000-01-01') AS time_key
  FROM statements WHERE company_name IS NOT NULL AND statement_type IS NOT NULL)
SELECT company, statement_type, statement_id, time_key FROM s QUALIFY row_number() OVER (PARTITION BY company, statement_type ORDER BY time_key DESC, statement_id DESC)=1"""


def period_labels(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "statements").dropDuplicates(["statement_id"])
    made = S.period_label(F.lower("period_type"), F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("start_date"), F.col("end_date"))
    return s.select("statement_id", F.coalesce("label", made).alias("label"), S.observation_date(F.col("end_date"), F.lower("period_type"), F.col("fiscal_year"), F.col("fiscal_quarter")).alias("obs_date"))


PERIOD_LABELS_SQL = """
SELECT DISTINCT statement_id, coalesce(label, CASE WHEN lower(period_type)='annual' AND fiscal_year IS NOT NULL THEN 'FY'||fiscal_year
  WHEN lower(period_type)='quarterly' AND fiscal_year IS NOT NULL AND fiscal_quarter IS NOT NULL THEN 'Q'||fiscal_quarter||' FY'||fiscal_year
  WHEN start_date IS NOT NULL AND end_date IS NOT NULL THEN start_date||' to '||end_date ELSE 'Undefined Period' END) AS label,
  coalesce(end_date, CASE WHEN lower(period_type)='annual' AND fiscal_year IS NOT NULL THEN make_date(fiscal_year,12,31)
  WHEN lower(period_type)='quarterly' AND fiscal_year IS NOT NULL AND fiscal_quarter BETWEEN 1 AND 4 THEN make_date(fiscal_year,3*fiscal_quarter,30) END) AS obs_date
FROM statements"""


def _unpivot_years(facts: DataFrame, years: list[int]) -> DataFrame:
    """Cells of odd kinds stand among the years: the second year of nation names with A is a dash, with I blank,
    with E negative in brackets."""
    wide = facts.groupBy("company").pivot("fiscal_year", years).agg(F.round(F.first("revenue"), 0))
    text = wide.select(F.lit("sales").alias("statement"), F.col("company").alias("label"), *[_cell(F.concat(F.lit("$ "), F.format_number(F.col(str(y)), 2)), k).alias(f"c{y}") for k, y in enumerate(years)])
    return S.unpivot_table(text, "label", [f"c{y}" for y in years], ["statement"]).select("statement", "name", "raw_value", F.round("value", 2).alias("value"))


def _cell(money: Column, k: int) -> Column:
    if k != 1:
        return money
    first = F.substring("company", 1, 1)
    return F.when(first == "A", "-").when(first == "I", " ").when(first == "E", F.concat(F.lit("("), money, F.lit(")"))).otherwise(money)


def statement_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """A table with years as columns (revenue per nation) turned into line items, for every year present."""
    f = yearly_facts(spark, d)
    years = bounded_rows(f.where("fiscal_year is not null").select(F.col("fiscal_year").cast("int").alias("y")).distinct(), 1000, "years")
    return _unpivot_years(f, sorted(r["y"] for r in years))


STATEMENT_UNPIVOT_SQL = f"""
WITH {YEAR_SQL}, y AS (SELECT *, min(fiscal_year) OVER () AS y0, '$ '||format('{{:,.2f}}', round(revenue,0)) AS money FROM facts),
z AS (SELECT *, fiscal_year=y0+1 AS odd, left(company,1) AS f FROM y)
SELECT 'sales' AS statement, CASE WHEN fiscal_year=y0 THEN company ELSE company||' (c'||fiscal_year||')' END AS name,
  CASE WHEN odd AND f='E' THEN '('||money||')' ELSE money END AS raw_value, CASE WHEN odd AND f='E' THEN -round(revenue,0) ELSE round(revenue,0) END AS value FROM z WHERE NOT (odd AND f IN ('A','I'))"""


def balance_validation(spark: SparkSession, d: str) -> DataFrame:
    m = S.measures(S.pivot_items(line_items(spark, d).where("statement_type = 'balance_sheet'"), ["company", "fiscal_year"]))
    return m.select("company", "fiscal_year", S.balance_valid(F.col("total_assets"), F.col("total_liabilities"), F.col("total_equity")).alias("valid"), F.round("debt", 5).alias("debt"))


BALANCE_SQL = ITEMS_SQL + " SELECT company, fiscal_year, coalesce(abs(ta-(tl+te))<=0.001*ta,false) AS valid, round(debt,5) AS debt FROM m"


def cash_measures(spark: SparkSession, d: str) -> DataFrame:
    m = S.measures(S.pivot_items(line_items(spark, d).where("statement_type = 'cash_flow'"), ["company", "fiscal_year"]))
    return m.select("company", "fiscal_year", F.round("operating_cash_flow", 5).alias("operating_cash_flow"), F.round("free_cash_flow", 5).alias("free_cash_flow"))


CASH_SQL = ITEMS_SQL + " SELECT company, fiscal_year, round(ocf,5) AS operating_cash_flow, round(ocf-abs(capex),5) AS free_cash_flow FROM m"


def annual_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = yearly_facts(spark, d)
    ms = F.explode(F.create_map(F.lit("revenue"), F.col("revenue"), F.lit("gross_profit"), F.col("revenue") - F.col("cost"))).alias("metric", "value")
    return f.select("company", F.lit("annual").alias("period_type"), "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"), F.col("fiscal_year").alias("seq"), F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("obs_date"), ms)


def quarter_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = yearly_facts(spark, d, quarter=True)
    return f.select("company", F.lit("revenue").alias("metric"), F.lit("quarterly").alias("period_type"), "fiscal_year", "fiscal_quarter", (F.col("fiscal_year") * 4 + F.col("fiscal_quarter")).alias("seq"), F.make_date("fiscal_year", 3 * F.col("fiscal_quarter"), F.lit(30)).alias("obs_date"), F.col("revenue").alias("value"))


K = ["company", "metric"]


def trend_by_company(spark: SparkSession, d: str) -> DataFrame:
    t = T.analyze_trends(annual_metrics(spark, d), K)
    return t.select(*K, "n", F.round("mean", 2).alias("mean"), F.round("std_dev", 2).alias("std_dev"), F.round("slope", 2).alias("slope"), F.round("r_squared", 6).alias("r_squared"), F.round("p_value", 6).alias("p_value"), "is_significant", "direction", F.round("cagr", 6).alias("cagr"))


TREND_SQL = f"""
WITH {YEAR_SQL},
x AS (SELECT company, 'revenue' AS metric, fiscal_year AS seq, revenue AS v, date_diff('day', DATE '1970-01-01', make_date(fiscal_year,12,31)) AS t FROM facts
  UNION ALL SELECT company, 'gross_profit', fiscal_year, revenue-cost, date_diff('day', DATE '1970-01-01', make_date(fiscal_year,12,31)) FROM facts),
g AS (SELECT company, metric, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, regr_slope(v,t)*stddev_pop(t) AS slope, corr(v,t) AS r, arg_min(v,seq) AS a, arg_max(v,seq) AS b FROM x GROUP BY 1,2),
h AS (SELECT *, n-2 AS nu, abs(r)*sqrt((n-2)/(1-r*r)) AS tt FROM g WHERE n>=3),
i AS (SELECT *, atan(tt/sqrt(nu)) AS th FROM h),
k AS (SELECT *, list_sum(list_transform(range(1, CAST(CASE WHEN nu%2=1 THEN (nu-1)//2 ELSE nu//2 END AS BIGINT)+1), lambda q: CASE WHEN nu%2=1 THEN
   cos(th)*pow(cos(th)*cos(th), q-1)*coalesce(list_product(list_transform(range(1,q), lambda z: (2*z)/(2*z+1))),1)
   ELSE pow(cos(th)*cos(th), q-1)*coalesce(list_product(list_transform(range(1,q), lambda z: (2*z-1)/(2*z))),1) END)) AS s FROM i),
p AS (SELECT *, CASE WHEN nu%2=1 THEN 1-(2/pi())*(th+sin(th)*coalesce(s,0)) ELSE 1-sin(th)*coalesce(s,0) END AS pv FROM k)
SELECT company, metric, n, round(mean,2) AS mean, round(sd,2) AS std_dev, round(slope,2) AS slope, round(r*r,6) AS r_squared, round(pv,6) AS p_value, pv<0.05 AS is_significant,
  CASE WHEN sd>0.25*mean THEN 'volatile' WHEN abs(slope)<0.01*mean THEN 'stable' WHEN slope>0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  CASE WHEN a>0 AND b>0 THEN round(pow(b/a,1.0/(n-1))-1,6) END AS cagr FROM p"""


def quarter_seasonality(spark: SparkSession, d: str) -> DataFrame:
    return T.seasonality(quarter_metrics(spark, d), K).select(*K, "fiscal_quarter", F.round("seasonal_factor", 6).alias("seasonal_factor"))


SEASON_SQL = f"""
WITH {QUARTER_SQL}, a AS (SELECT company, count(*) AS n, count(DISTINCT fiscal_quarter) AS q, avg(revenue) AS m FROM facts GROUP BY 1)
SELECT company, 'revenue' AS metric, fiscal_quarter, round(avg(revenue)/any_value(m)-1,6) AS seasonal_factor FROM facts JOIN a USING (company) WHERE n>=8 AND q=4 GROUP BY company, fiscal_quarter"""


def anomalies_z(spark: SparkSession, d: str) -> DataFrame:
    return T.anomalies(quarter_metrics(spark, d), K).select(*K, "seq", F.round("value", 4).alias("value"), F.round("z_score", 6).alias("z_score"))


ANOMALY_SQL = f"""
WITH {QUARTER_SQL}, a AS (SELECT company, count(*) AS n, avg(revenue) AS m, stddev_pop(revenue) AS s FROM facts GROUP BY 1)
SELECT company, 'revenue' AS metric, fiscal_year*4+fiscal_quarter AS seq, round(revenue,4) AS value, round((revenue-m)/s,6) AS z_score FROM facts JOIN a USING (company) WHERE n>=3 AND s>0 AND abs(revenue-m)/s>2"""


def growth_rates(spark: SparkSession, d: str) -> DataFrame:
    return T.growth(annual_metrics(spark, d).where("metric = 'revenue'"), K).select(*K, "seq", F.round("growth", 6).alias("growth"))


GROWTH_SQL = f"WITH {YEAR_SQL} SELECT company, 'revenue' AS metric, fiscal_year AS seq, round(revenue/lag(revenue) OVER (PARTITION BY company ORDER BY fiscal_year)-1,6) AS growth FROM facts"


def _forecast(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        src = annual_metrics(spark, d).where("metric = 'revenue'") if method != "average" else quarter_metrics(spark, d)
        return T.forecast(src, K, 4, method).select(*K, "step", F.round("value", 2).alias("value"), "fiscal_year", "fiscal_quarter", "label")

    return query


_FC = "g AS (SELECT company, count(*) AS n, avg(revenue) AS avgv, regr_slope(revenue,i) AS b, regr_intercept(revenue,i) AS a, min(revenue) AS mn, avg(gr) AS g, arg_max(revenue,i) AS lastv, max(fiscal_year) AS y, arg_max(fiscal_quarter,i) AS q FROM (SELECT *, row_number() OVER w - 1 AS i, revenue/lag(revenue) OVER w AS gr FROM facts WINDOW w AS (PARTITION BY company ORDER BY fiscal_year, fiscal_quarter)) GROUP BY company HAVING count(*)>=3), k AS (SELECT unnest([1,2,3,4]) AS step)"
FORECAST_SQL = {
    "linear": f"WITH {YEAR_SQL}, {_FC} SELECT company, 'revenue' AS metric, step, round(a+b*(n-1+step),2) AS value, y+step AS fiscal_year, CAST(NULL AS INT) AS fiscal_quarter, 'FY'||(y+step) AS label FROM g, k",
    "growth_rate": f"WITH {YEAR_SQL}, {_FC} SELECT company, 'revenue' AS metric, step, round(CASE WHEN mn>0 THEN lastv*pow(g,step) ELSE avgv END,2) AS value, y+step AS fiscal_year, CAST(NULL AS INT) AS fiscal_quarter, 'FY'||(y+step) AS label FROM g, k",
    "average": f"WITH {QUARTER_SQL}, {_FC} SELECT company, 'revenue' AS metric, step, round(avgv,2) AS value, y+(q-1+step)//4 AS fiscal_year, (q-1+step)%4+1 AS fiscal_quarter, 'Q'||((q-1+step)%4+1)||' FY'||(y+(q-1+step)//4) AS label FROM g, k",
}


def formatted_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = S.latest_ratios(line_items(spark, d))
    return r.select("company", "ratio_key", format_ratio(F.round("value", 9), F.col("is_percentage"), F.col("is_multiple")).alias("formatted_value"))


FORMATTED_SQL = f"WITH r AS ({LATEST_RATIOS_SQL.replace('round((', '((').replace(',0),6) AS value', ',0)) AS value')}) SELECT company, ratio_key, CASE WHEN value IS NULL THEN 'N/A' WHEN is_percentage THEN format('{{:.2f}}%', round(value,9)*100) ELSE format('{{:.2f}}x', round(value,9)) END AS formatted_value FROM r"


def ratio_findings(spark: SparkSession, d: str) -> DataFrame:
    f = N.ratio_findings(S.latest_ratios(line_items(spark, d)), N.bounds_table(spark))
    return f.select("company", "ratio_key", "rule_id", "finding")


_BOUND_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in N.BOUNDS)
FINDINGS_SQL = f"WITH r AS ({LATEST_RATIOS_SQL.replace('round((', '((').replace(',0),6) AS value', ',0)) AS value')}), b(rule_id, ratio_key, low, low_in, high, high_in, finding) AS (VALUES {_BOUND_ROWS}) SELECT company, ratio_key, rule_id, finding FROM r JOIN b USING (ratio_key) WHERE (low IS NULL OR value>low OR (low_in AND value=low)) AND (high IS NULL OR value<high OR (high_in AND value=high))"


def scaled_line_items(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "line_items").dropDuplicates(["item_id"])
    return li.select("item_id", S.scaled_value(F.col("value"), F.col("scaling_factor")).alias("scaled_value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (latest_ratios, latest_statement_dates, period_labels, statement_unpivot, balance_validation, cash_measures, trend_by_company, quarter_seasonality, anomalies_z, growth_rates, formatted_ratios, ratio_findings, scaled_line_items)
    return {f.__name__: f for f in fs} | {"forecast_linear": _forecast("linear"), "forecast_growth": _forecast("growth_rate"), "forecast_average": _forecast("average")}


def oracle_sql() -> dict[str, str]:
    return {
        "latest_ratios": LATEST_RATIOS_SQL, "latest_statement_dates": LATEST_DATES_SQL, "period_labels": PERIOD_LABELS_SQL, "statement_unpivot": STATEMENT_UNPIVOT_SQL, "balance_validation": BALANCE_SQL, "cash_measures": CASH_SQL,
        "trend_by_company": TREND_SQL, "quarter_seasonality": SEASON_SQL, "anomalies_z": ANOMALY_SQL, "growth_rates": GROWTH_SQL, "formatted_ratios": FORMATTED_SQL, "ratio_findings": FINDINGS_SQL, "scaled_line_items": "SELECT DISTINCT item_id, value*scaling_factor AS scaled_value FROM line_items",
        "forecast_linear": FORECAST_SQL["linear"], "forecast_growth": FORECAST_SQL["growth_rate"], "forecast_average": FORECAST_SQL["average"],
    }
