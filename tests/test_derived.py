"""Parsing of statements, saved indexes, findings over trends, searches and spans, on small fixtures."""

from pyspark.sql import functions as F

from ledgerlens.operators import chunking as C
from ledgerlens.operators import detect as D
from ledgerlens.operators import insights as N
from ledgerlens.operators import parsing as P
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import statements as S
from ledgerlens.sources import indexes

REPORT = """Tonwer Holdings Ltd. annual report, fiscal year ended 2022

Consolidated balance sheet: total assets, current assets and total liabilities follow.

Item | 2022 | 2021
--- | --- | ---
Total assets | $1,200.50 | 1,100.25
Total liabilities | (300.75) | -
Net cash | nan | 40
Total assets | $1,250.50 | 1,100.25

Room list

Room  Level
12    3
"""


def test_tables_statements_and_log(spark):
    docs = spark.createDataFrame([("a", REPORT), ("b", "no table here"), ("c", None), ("d", "")], "doc_id string, content string")
    t = P.extract_tables(docs).orderBy("table_index").collect()
    assert [(r["doc_id"], len(r["rows"]), len(r["header"])) for r in t] == [("a", 4, 3), ("a", 1, 2)]
    st, items, log = P.parse_statements(docs)
    s = st.collect()
    assert len(s) == 1 and s[0]["company_name"] == "Tonwer Holdings Ltd." and s[0]["statement_type"] == "balance_sheet" and s[0]["fiscal_year"] == 2022
    got = {r["name"]: r["value"] for r in items.collect()}
    assert got == {"Total assets": 1250.5, "Total assets (2021)": 1100.25, "Total liabilities": -300.75, "Net cash (2021)": 40.0}
    assert [r["message"] for r in log.collect()] == ["not a financial table"]
    by = {r["doc_id"]: r for r in P.parse_summary(docs, st, log).collect()}
    assert by["a"]["n_statements"] == 1 and not by["a"]["successful"] and by["b"]["confidence"] is None and by["b"]["successful"]
    empty = docs.limit(0)
    assert [x.count() for x in P.parse_statements(empty)] == [0, 0, 0]


def test_index_is_saved_and_loaded(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert indexes.load_index(spark, folder) is None
    d = spark.createDataFrame([("a", 1)], "doc_id string, n int")
    from ledgerlens.operators.topics import chunk_topics, fit_topics

    texts = spark.createDataFrame([(str(k), f"goodwill and revenue {w}") for k, w in enumerate(["fell", "rose", "fell", "rose"])], "chunk_id string, content string")
    m = fit_topics(texts, topics=2)
    indexes.save_index(indexes.Index(d, d, d, m), folder)
    got = indexes.load_index(spark, folder)
    assert got.documents.collect() == d.collect()
    assert chunk_topics(got.model, texts).orderBy("chunk_id").collect() == chunk_topics(m, texts).orderBy("chunk_id").collect()
    indexes.save_index(indexes.Index(d, d, d, None), str(tmp_path / "bare"))
    assert indexes.load_index(spark, str(tmp_path / "bare")).model is None


def test_trend_rules_and_comparisons(spark):
    rows = [("a", "revenue", "stable", True), ("a", "net_income", "increasing", True), ("a", "operating_cash_flow", "decreasing", True), ("b", "net_income", "stable", False), ("b", "operating_cash_flow", "increasing", False), ("c", "net_income", "increasing", True)]
    t = spark.createDataFrame(rows, "company string, metric string, direction string, is_significant boolean")
    got = {(r["company"], r["rule_id"]) for r in N.trend_findings(t, ["company"]).collect()}
    assert got == {("a", "net_income_rising"), ("a", "operating_cash_falling"), ("a", "income_without_revenue"), ("a", "income_without_cash"), ("b", "cash_without_income"), ("c", "net_income_rising")}
    assert N.trend_findings(t.limit(0), ["company"]).count() == 0


def test_search_branches(spark):
    chunks = spark.createDataFrame([("c1", "d1", "growth was 45% here", {"page": "1"}), ("c2", "d1", "debt was paid", {"page": "2"}), ("c3", "d2", "debt was owed", None), ("c4", "d2", None, None)], "chunk_id string, doc_id string, content string, metadata map<string,string>")
    p = R.entity_postings(chunks)
    ids = lambda q, f=None: [r["chunk_id"] for r in R.search(chunks, p, q, f).collect()]
    assert ids("who saw 45% growth") == ["c1"]
    assert ids("debt") == ["c2", "c3"]
    assert ids("debt", {"page": "1"}) == ["c3"] and ids("debt", {"page": "2"}) == ["c2", "c3"]
    assert ids("  ") == [] and ids("nothing like it") == []


def test_spans_regions_sheets_and_points(spark):
    d = spark.createDataFrame([("EBITDA rose; ebitda fell. ROE",), (None,)], "t string")
    s = d.select(D.entity_spans(F.col("t")).alias("s")).collect()
    assert {(x["start"], x["end"], x["text"]) for x in s[0]["s"]} == {(0, 6, "EBITDA"), (13, 19, "ebitda"), (26, 29, "ROE")} and s[1]["s"] is None
    v = F.array(*[F.lit(1.0)] * 10)
    w = d.select(R.weight_regions(F.col("t"), v, {"METRIC": 3.0}).alias("w")).first()["w"]
    assert w[0] > w[1] == w[9] and abs(sum(x * x for x in w) - 1) < 1e-9
    b = spark.createDataFrame([(1, "x\n--- Sheet: One ---\na | b\n--- Sheet: A-B ---\nc\n--- Sheet: Two ---\nd"), (2, None), (3, "plain")], "doc_id int, content string")
    assert [(r["sheet"], r["chunk"].strip()) for r in C.chunk_sheets(b).orderBy("chunk_index").collect()] == [("One", "a | b"), ("Two", "d")]
    m, i = spark.createDataFrame([("a", 2.0, None)], "company string, x double, y double"), spark.createDataFrame([("a", "z", 5.0)], "company string, name string, value double")
    points = [tuple(r) for metric in ("x", "y", "z", F.col("x") * 2) for r in S.metric_points(m, i, ["company"], metric).collect()]
    assert points == [("a", "x", 2.0), ("a", "z", 5.0), ("a", "custom_metric", 4.0)]


def test_first_present_and_faults(spark):
    rows = [("s", "B", 1.0, 1), ("s", "B", 2.0, 2), ("s", "A", None, 3), ("t", "B", 4.0, 1), ("u", "C", 1.0, 1)]
    li = spark.createDataFrame(rows, "statement_id string, name string, value double, seq int")
    assert {tuple(r) for r in S.first_present(li, ["statement_id"], ["A", "B"]).collect()} == {("s", "A", None), ("t", "B", 4.0)}
    d = spark.createDataFrame([(1, 5), (2, 13), (None, 1), (9, 99)], "q int, m int")
    assert {(r["q"], r["fault"]) for r in S.period_faults(d, {"q": (1, 4), "m": (1, 12)}).collect()} == {(2, "m"), (9, "q")}


def test_reduction_equals_the_full_svd(spark):
    import numpy as np

    from ledgerlens.operators import topics as TP

    groups = [["river", "water", "boat", "fish"], ["engine", "wheel", "road", "fuel"], ["bread", "oven", "flour", "yeast"]]
    texts = [" ".join(g[(k + j) % 4] for j in range(3)) + (" extra" if k % 5 == 0 else "") for k in range(60) for g in groups]
    d = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)] + [("n", None), ("e", "")], "chunk_id string, content string")
    m = TP.fit_topics(d, topics=3, dimensions=4)
    at = {w: k for k, w in enumerate(m.terms)}
    x = np.zeros((len(texts), len(at)))
    for row, (i, v) in zip(x, TP._rows(texts, at, m.idf, frozenset())):
        row[i] = v
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(np.sum(m.directions[:, :3] * vt[:3].T, axis=0)), 1, atol=1e-4) or np.allclose(np.linalg.norm(vt[:3] @ m.directions[:, :3], 2), 1, atol=1e-4)
    found = {r["chunk_id"]: r["topic_id"] for r in TP.chunk_topics(m, d).collect()}
    assert len({found[str(k)] for k in range(0, 180, 3)}) == 1 and len({found[str(k)] for k in range(3)}) == 3 and "n" not in found
