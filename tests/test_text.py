from pyspark.sql import functions as F

from ledgerlens.functions import tagging as G
from ledgerlens.operators import chunking as C
from ledgerlens.operators import detect as D
from ledgerlens.operators import quality as Q


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]


def test_category_ties_and_default(spark):
    assert one(spark, "The valuation uses a DCF. Contract and agreement.", D.document_category) == "contract"
    assert one(spark, "nothing here", D.document_category) == "general_financial"
    assert one(spark, None, D.document_category) in (None, "general_financial")


def test_task_routing(spark):
    def route(q):
        return tuple(D.route_tasks(spark.createDataFrame([(q,)], "query string")).select("task", F.round("share", 4), "provider").first())

    assert route("what is the current ratio") == ("non_financial", 1.0, "openai")
    assert route("show me the company") == ("general_financial", 1.0, "openai")
    assert route("company current ratio versus valuation")[0] == "ratio_analysis"
    assert route("compare and analyze the company valuation and current ratio")[0] == "valuation"


def test_periods_and_company(spark):
    p = one(spark, "Three months ended March 31, 2022; Q3 2021.", D.periods)
    assert [(x["period_type"], x["fiscal_year"], x["fiscal_quarter"]) for x in p] == [("annual", 2022, None), ("annual", 2021, None), ("quarterly", 2021, 3)]
    c = one(spark, "Shares of Tonwer Group (NYSE: TWG) fell.", D.company_info)
    assert c["ticker"] == "TWG"
    assert one(spark, "nothing", D.company_info)["name"] == "Unknown Company"


def test_detection(spark):
    assert one(spark, "Consolidated balance sheets", D.statement_title_type) == "balance_sheet"
    assert one(spark, "in 2021", D.has_table) and not one(spark, "in 2021", D.looks_tabular)
    assert one(spark, "Year ended December 31, 2022 was good", D.financial_period) == "Year ended December 31, 2022"
    assert one(spark, "debt and sales", D.expand_query).startswith("debt and sales ")
    assert one(spark, "revenue of $5.2 million", D.metrics) == {"revenue": "5.2 million"}
    assert one(spark, "up 5% in 2021-01-02", D.entities)["percentages"] == ["5%"]


def test_money_units_and_tags():
    assert [G.normalize_money(x) for x in ("$1,234,567.89", "$1.2M", "EUR 5.6 billion", "$1,000")] == ["$1234567.89", "$1200000.00", "EUR5600000000.00", "$1000.00"]
    assert [G.normalize_units(x) for x in ("1.5 million", "2.3 billion", "500 thousand", "10%")] == ["1500000.00", "2300000000.00", "500000.00", "10%"]
    assert G.mark_periods("Year ended December 31, 2022 and Q1 2023") == "[PERIOD]Year ended[/PERIOD] December 31, 2022 and [PERIOD]Q1[/PERIOD] 2023"
    assert G.mark_terms("The Revenue increased while Net Income decreased.") == "The [METRIC]Revenue[/METRIC] increased while [METRIC]Net Income[/METRIC] decreased."
    assert G.mark_tables("a | b\nc | d").count("[ROW]") == 2 and G.mark_tables("a | b\nc | d").count("[TABLE]") == 1
    assert "[CASH_FLOW]" in G.mark_statements("the cash flow statement") and G.process_text("") == ""


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, content string")


def test_paragraph_packing(spark):
    t = "\n\n".join(["a" * 40, "b" * 40, "c" * 120, "d"])
    got = [r["chunk"] for r in C.chunk_paragraphs(docs(spark, t, None, "", "  "), size=90).orderBy("chunk_index").collect()]
    assert got == ["a" * 40 + "\n\n" + "b" * 40, "c" * 120, "d"]


def test_windows_cover_the_text():
    t = "".join(f"Sentence number {k} ends here. " for k in range(200))
    w = C.windows(t, 300, 50)
    assert all(len(x) <= 300 for x in w) and w[0] == t[: len(w[0])] and t.endswith(w[-1])
    assert "".join(w).count("number 7 ") >= 1 and C.windows("") == [] and C.windows("x" * 10, 5, 5)[-1].endswith("x")


def test_sections():
    notes = C.note_sections("Intro\nNOTE 1: Leases apply\nbody\nNote 2. Tax Matters\nmore")
    assert [(a, b) for a, b, _ in notes] == [("0", "Introduction to Notes"), ("1", "Leases apply"), ("2", "Tax Matters")]
    assert C.note_sections("plain") == [("0", "General", "plain")]
    parts = C.statement_sections("x\nBalance sheet\n1\nCash flow\n2")
    assert "".join(p for _, p in parts) == "x\nBalance sheet\n1\nCash flow\n2" and [t for t, _ in parts] == ["unknown", "balance_sheet", "cash_flow"]
    assert [h for h, _ in C.header_sections("pre\nRISK FACTORS\nbody")] == ["", "RISK FACTORS"]
    long = "NOTE 1: Leases\n\n" + "\n\n".join("p" * 300 for _ in range(9))
    assert all(m["chunk"].startswith("NOTE 1") for m in C.note_chunks(long, 1000))


def test_chunk_documents_with_clashing_columns(spark):
    d = docs(spark, "NOTE 1: Leases\ntext", None, "plain text").withColumn("chunk", F.lit("clash")).withColumn("how", F.lit("notes"))
    r = C.chunk_documents(d, by="how").orderBy("doc_id").collect()
    assert [(x["doc_id"], x["chunk_index"], x["section_type"]) for x in r] == [(0, 0, "notes"), (2, 0, "notes")]


def test_table_rows(spark):
    for n, want in ((1, [(1, 0)]), (99, [(1, 98)]), (100, [(1, 99)]), (200, [(1, 99), (100, 199)])):
        t = "\n".join(["h"] + [str(k) for k in range(1, n)])
        r = C.chunk_table_rows(docs(spark, t)).orderBy("chunk_index").collect()
        assert [(x["first_row"], x["last_row"]) for x in r] == want
        assert all(x["chunk"].startswith("h") for x in r)


def test_quality(spark):
    c = spark.createDataFrame([("c1", "d", 1, "notes", ["Debt"], "ab"), ("c2", "d", 2, "cash_flow", [], None), ("c3", None, None, None, None, "")], "chunk_id string, doc_id string, page int, statement_type string, financial_entities array<string>, content string").withColumn("section", F.lit(None).cast("string")).withColumn("contains_table", F.lit(False))
    assert [r["chunk_id"] for r in Q.boundary_violations(c, "doc_id", "page", "statement_type", "section").collect()] == ["c2"]
    assert Q.entity_frequency(c).first()["entity"] == "debt"
    assert {r["entity"]: r["n_chunks"] for r in Q.entity_coverage(c).collect()}["debt"] == 1
    assert Q.collection_stats(c.limit(0), ["statement_type"]).count() == 0
