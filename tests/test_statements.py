import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.tagging import format_ratio
from ledgerlens.operators import statements as S
from ledgerlens.operators import trends as T

B, I, C = "balance_sheet", "income_statement", "cash_flow"
F1 = [(B, "Cash and Cash Equivalents", 1e6), (B, "Inventory", 6e5), (B, "Total Current Assets", 2.95e6), (B, "Total Assets", 7.7e6), (B, "Total Current Liabilities", 7.5e5), (B, "Long-term Debt", 2e6), (B, "Total Liabilities", 3e6), (B, "Total Equity", 4.7e6), (I, "Revenue", 5e6), (I, "Gross Profit", 2.5e6), (I, "Operating Income", 1e6), (I, "Interest Expense", 1.5e5), (I, "Net Income", 7.5e5), (C, "Net Cash from Operating Activities", 1e6), (C, "Capital Expenditures", -4e5)]
SCHEMA = "company string, statement_type string, end_date date, fiscal_year int, fiscal_quarter int, statement_seq int, seq bigint, name string, value double"


def items(spark, rows, company="A", year=2023, seq=1):
    return spark.createDataFrame([(company, t, None, year, None, seq, k, n, v) for k, (t, n, v) in enumerate(rows)], SCHEMA)


def test_ratios_of_one_company(spark):
    r = {x["ratio_key"]: x["value"] for x in S.latest_ratios(items(spark, F1)).collect()}
    want = {"current_ratio": 2950 / 750, "quick_ratio": 2350 / 750, "cash_ratio": 1000 / 750, "gross_margin": 0.5, "operating_margin": 0.2, "net_profit_margin": 0.15, "return_on_assets": 750 / 7700, "return_on_equity": 750 / 4700, "debt_to_equity": 2000 / 4700, "debt_ratio": 3000 / 7700, "interest_coverage": 1000 / 150}
    assert r == pytest.approx(want)


def test_presence_stops_the_search_and_zero_divides_to_null(spark):
    rows = [(t, n, None if n == "Long-term Debt" else 0.0 if n == "Revenue" else v) for t, n, v in F1]
    r = {x["ratio_key"]: x["value"] for x in S.latest_ratios(items(spark, rows)).collect()}
    assert r["debt_to_equity"] is None and r["gross_margin"] is None and r["current_ratio"] == pytest.approx(2950 / 750)
    only = {x["ratio_key"] for x in S.latest_ratios(items(spark, [x for x in F1 if x[0] == I])).collect()}
    assert only == {"gross_margin", "operating_margin", "net_profit_margin"}
    assert S.latest_ratios(items(spark, [])).count() == 0


def test_latest_inserted_wins_on_one_date(spark):
    a, b = items(spark, F1, seq=1), items(spark, [(I, "Revenue", 9.0), (I, "Gross Profit", 3.0)], seq=2)
    r = {x["ratio_key"]: x["value"] for x in S.latest_ratios(a.unionByName(b)).collect()}
    assert r["gross_margin"] == pytest.approx(1 / 3)


def test_free_cash_flow_and_balance(spark):
    m = S.measures(S.pivot_items(items(spark, F1), ["company"])).first()
    assert m["free_cash_flow"] == 600_000
    ok = spark.range(1).select(S.balance_valid(F.lit(100.0), F.lit(60.0), F.lit(40.05)).alias("a"), S.balance_valid(F.lit(100.0), F.lit(60.0), F.lit(40.2)).alias("b"), S.balance_valid(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("c"), S.balance_valid(F.lit(-5.0), F.lit(-5.0), F.lit(0.0)).alias("d")).first()
    assert tuple(ok) == (True, False, False, False)


def test_unpivot(spark):
    t = spark.createDataFrame([("Revenue", "$ 150,000", "$ 120,000"), ("Loss", "(1,250)", "-"), (" ", "1", "2"), ("Other", "n/a", "nan"), ("Revenue", "7", None), (None, "3", "4")], "label string, c2023 string, `2022` string").withColumn("doc", F.lit(1))
    got = {r["name"]: r["value"] for r in S.unpivot_table(t.coalesce(1), "label", ["c2023", "2022"], ["doc"]).collect()}
    assert got == {"Revenue": 7.0, "Revenue (2022)": 120000.0, "Loss": -1250.0}


def test_time_keys_and_labels(spark):
    d = spark.createDataFrame([("annual", 2023, None), ("quarterly", 2023, 2), ("custom", None, None), ("quarterly", 2023, 7)], "t string, y int, q int")
    n = F.lit(None).cast("date")
    r = d.select(S.time_key(n, F.col("y"), F.col("q")).cast("string").alias("k"), S.observation_date(n, F.col("t"), F.col("y"), F.col("q")).cast("string").alias("o"), S.period_label(F.col("t"), F.col("y"), F.col("q"), n, n).alias("l")).collect()
    assert [tuple(x) for x in r] == [("2023-12-28", "2023-12-31", "FY2023"), ("2023-06-28", "2023-06-30", "Q2 FY2023"), ("2000-01-01", None, "Undefined Period"), ("2023-12-28", None, "Q7 FY2023")]


def test_where_filter(spark):
    d = spark.createDataFrame([("a", {"k": "1"}), ("b", {"k": "2"}), ("c", None)], "id string, metadata map<string,string>")
    f = lambda w: sorted(r["id"] for r in d.where(S.where_filter(w, d.columns, "metadata")).collect())
    assert f({"id": {"$in": ["a", "c"]}}) == ["a", "c"] and f({"k": "2"}) == ["b"] and f({"$or": [{"id": "a"}, {"k": 2}]}) == ["a", "b"] and f({}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        S.where_filter({"id": {"$near": 1}}, d.columns)


def series(spark, values, typ="annual"):
    rows = [("A", "m", k, typ, 2000 + (k if typ == "annual" else k // 4), None if typ == "annual" else k % 4 + 1, v) for k, v in enumerate(values)]
    d = spark.createDataFrame(rows, "company string, metric string, seq int, period_type string, fiscal_year int, fiscal_quarter int, value double")
    return d.withColumn("obs_date", S.observation_date(F.lit(None).cast("date"), F.col("period_type"), F.col("fiscal_year"), F.col("fiscal_quarter")))


K = ["company", "metric"]


def test_trend(spark):
    r = T.analyze_trends(series(spark, [4e6, 4.5e6, 5e6]), K).first()
    assert r["cagr"] == pytest.approx(1.25**0.5 - 1) and r["direction"] == "increasing" and r["is_significant"]
    assert T.analyze_trends(series(spark, [1.0, 2.0]), K).count() == 0
    flat = T.analyze_trends(series(spark, [5.0] * 4), K).first()
    assert flat["direction"] == "stable" and not math.isnan(flat["r_squared"])
    neg = T.analyze_trends(series(spark, [-1.0, -2.0, -3.0]), K).first()
    assert neg["direction"] == "volatile" and neg["cagr"] is None


@pytest.mark.parametrize("v,t", [(1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (10, 2.228), (25, 2.060)])
def test_p_value_at_critical_points(spark, v, t):
    r = t / math.sqrt(v + t * t)
    assert spark.range(1).select(T.p_value(F.lit(r), F.lit(v + 2))).first()[0] == pytest.approx(0.05, abs=2e-4)


def test_seasons_anomalies_forecasts(spark):
    q = series(spark, [1.0, 2.0, 3.0, 2.0] * 2, "quarterly")
    assert {r["fiscal_quarter"]: r["seasonal_factor"] for r in T.seasonality(q, K).collect()} == {1: -0.5, 2: 0.0, 3: 0.5, 4: 0.0}
    assert T.seasonality(q.where("fiscal_quarter < 4"), K).count() == 0
    assert [r["seq"] for r in T.anomalies(series(spark, [1.0] * 9 + [50.0]), K).collect()] == [9]
    assert T.anomalies(series(spark, [1.0] * 9), K).count() == 0
    f = T.forecast(series(spark, [4e6, 4.5e6, 5e6]), K, 1).first()
    assert f["value"] == pytest.approx(5.5e6) and f["label"] == "FY2003"
    g = T.forecast(q, K, 2, "average").orderBy("step").collect()
    assert [r["label"] for r in g] == ["Q1 FY2002", "Q2 FY2002"] and g[0]["value"] == 2.0


def test_formatting(spark):
    d = spark.createDataFrame([(0.125, True, False), (2.675, False, True), (None, False, True), (1.0, False, False)], "v double, p boolean, m boolean")
    assert [r[0] for r in d.select(format_ratio(F.col("v"), F.col("p"), F.col("m"))).collect()] == ["12.50%", "2.67x", "N/A", "1.00"]


def test_findings(spark):
    from ledgerlens.operators import insights as N

    got = {r["rule_id"] for r in N.ratio_findings(S.latest_ratios(items(spark, F1)), N.bounds_table(spark)).collect()}
    assert got == {"current_strong", "quick_good", "margin_strong", "leverage_low", "coverage_strong"}
    edge = spark.createDataFrame([("return_on_equity", 0.0), ("return_on_equity", 0.05), ("current_ratio", 1.5), ("quick_ratio", None)], "ratio_key string, value double")
    assert sorted(r["rule_id"] for r in N.ratio_findings(edge, N.bounds_table(spark)).collect()) == ["current_adequate", "roe_negative"]


def test_document_columns(spark):
    from ledgerlens.operators import insights as N
    from ledgerlens.operators.retrieval import hash_embedding

    p = spark.createDataFrame([("d", "\n\n".join(f"p{k}" for k in range(10)))], "doc_id string, text string")
    t = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, table_index int")
    assert [r["context"].count("p") for r in N.table_context(p, t).orderBy("table_index").collect()] == [7, 7]
    c = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    cache = c.where("text = 'a'").select(F.sha2("text", 256).alias("text_key"), F.array(F.lit(9.0)).alias("embedding"))
    e = {r["text"]: r["embedding"] for r in N.cached_embeddings(c, cache, lambda x: hash_embedding(x, 4)).collect()}
    assert e["a"] == [9.0] and len(e["b"]) == 4 and e[None] == [0.0] * 4
    q = spark.createDataFrame([("give an overview", "x"), ("revenue profit debt", ""), ("hello", "")], "q string, h string").select(N.query_type(F.col("q"), F.col("h"))).collect()
    assert [r[0] for r in q] == ["summarization", "analysis", "query"]
    m = spark.createDataFrame([({"source": "s", "secret": "x"},)], "m map<string,string>").select(N.context_metadata(F.col("m"))).first()[0]
    assert m == '{"source":"s"}'


def test_all_years_are_unpivoted(spark, small):
    import __spark_entry__ as E
    from pyspark.sql import functions as F
    from ledgerlens.plans.statement_plans import yearly_facts

    f = yearly_facts(spark, small).where("revenue is not null")
    second = f.agg(F.min("fiscal_year")).first()[0] + 1
    odd = f.where((F.col("fiscal_year") == second) & F.substring("company", 1, 1).isin("A", "I")).count()
    assert E.queries()["statement_unpivot"](spark, small).count() == f.count() - odd
