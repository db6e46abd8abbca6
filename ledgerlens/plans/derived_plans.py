"""Queries of derived columns, findings over trends, searches, lookups and reports, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.functions.tagging import tag_text
from ledgerlens.operators import chunking as C
from ledgerlens.operators import detect as D
from ledgerlens.operators import insights as N
from ledgerlens.operators import parsing as P
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import statements as S
from ledgerlens.operators import topics as TP
from ledgerlens.operators import trends as T
from ledgerlens.plans.retrieval_plans import POSTINGS_SQL, recorded_postings
from ledgerlens.plans.statement_plans import ITEMS_SQL, LATEST_RATIOS_SQL, _BOUND_ROWS, line_items
from ledgerlens.plans.text_plans import CATEGORY_SQL, CHUNKS_SQL, KEY_INFO_SQL, METRIC_SQL, _re, chunks_once
from ledgerlens.sources.tables import table
from ledgerlens.streaming import ingest as I


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).where("content is not null").select("chunk_id", "content")


# ---- trends of all metrics, and findings -------------------------------------------------------------------
METRICS = {"revenue": "revenue", "gross_profit": "gp", "operating_income": "oi", "net_income": "ni", "total_assets": "ta", "total_liabilities": "tl", "total_equity": "te", "operating_cash_flow": "ocf", "free_cash_flow": "ocf-abs(capex)"}


def metric_series(spark: SparkSession, d: str) -> DataFrame:
    """The nine metrics of every nation and year, as dated points."""
    m = S.measures(S.pivot_items(line_items(spark, d), ["company", "fiscal_year"]))
    ms = F.explode(F.create_map(*[x for k in METRICS for x in (F.lit(k), F.col(k))])).alias("metric", "value")
    return m.select("company", F.lit("annual").alias("period_type"), "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"), F.col("fiscal_year").alias("seq"), F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("obs_date"), ms).where("value is not null")


def trend_metrics(spark: SparkSession, d: str) -> DataFrame:
    # The made balances lie exactly on the usual bound of volatility, so another bound is taken.
    t = T.analyze_trends(metric_series(spark, d), ["company", "metric"], volatile=0.2)
    return t.select("company", "metric", "n", F.round("mean", 2).alias("mean"), F.round("slope", 1).alias("slope"), F.round("r_squared", 5).alias("r_squared"), F.round("p_value", 5).alias("p_value"), "is_significant", "direction")


_SERIES = "x AS (" + " UNION ALL ".join(f"SELECT company, '{k}' AS metric, fiscal_year AS seq, {e} AS v, date_diff('day', DATE '1970-01-01', make_date(fiscal_year,12,31)) AS t FROM m" for k, e in METRICS.items()) + """),
g AS (SELECT company, metric, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, regr_slope(v,t)*stddev_pop(t) AS slope, corr(v,t) AS r FROM x WHERE v IS NOT NULL GROUP BY 1,2),
h AS (SELECT *, n-2 AS nu, abs(r)*sqrt((n-2)/greatest(1-r*r,1e-18)) AS tt FROM g WHERE n>=3),
i AS (SELECT *, atan(tt/sqrt(nu)) AS th FROM h),
k AS (SELECT *, list_sum(list_transform(range(1, CAST(CASE WHEN nu%2=1 THEN (nu-1)//2 ELSE nu//2 END AS BIGINT)+1), lambda q: CASE WHEN nu%2=1 THEN
   cos(th)*pow(cos(th)*cos(th), q-1)*coalesce(list_product(list_transform(range(1,q), lambda z: (2*z)/(2*z+1))),1)
   ELSE pow(cos(th)*cos(th), q-1)*coalesce(list_product(list_transform(range(1,q), lambda z: (2*z-1)/(2*z))),1) END)) AS s FROM i),
p AS (SELECT *, CASE WHEN nu%2=1 THEN 1-(2/pi())*(th+sin(th)*coalesce(s,0)) ELSE 1-sin(th)*coalesce(s,0) END AS pv FROM k),
trends AS (SELECT company, metric, n, round(mean,2) AS mean, round(slope,1) AS slope, round(r*r,5) AS r_squared, round(abs(pv),5) AS p_value, pv<0.05 AS is_significant,
  CASE WHEN sd>VOLATILE*mean THEN 'volatile' WHEN abs(slope)<0.01*mean THEN 'stable' WHEN slope>0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM p)"""
TREND_METRICS_SQL = f"{ITEMS_SQL}, {_SERIES} SELECT * FROM trends".replace("VOLATILE", "0.2")


def trend_findings(spark: SparkSession, d: str) -> DataFrame:
    return N.trend_findings(T.analyze_trends(metric_series(spark, d), ["company", "metric"]), ["company"])


_RULES = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in N.TREND_RULES)
_TREND_FINDINGS = f"""rules(rule_id, metric, direction, finding) AS (VALUES {_RULES}),
side AS (SELECT company, max(CASE WHEN metric='revenue' THEN direction END) AS rd, max(CASE WHEN metric='net_income' THEN direction END) AS nd, bool_or(metric='net_income' AND is_significant) AS ns, max(CASE WHEN metric='operating_cash_flow' THEN direction END) AS od FROM trends GROUP BY 1),
tf AS (SELECT company, rule_id, finding FROM trends JOIN rules USING (metric, direction) WHERE is_significant
  UNION ALL SELECT company, 'income_without_revenue', 'strength' FROM side WHERE nd='increasing' AND ns AND rd<>'increasing'
  UNION ALL SELECT company, 'income_without_cash', 'risk' FROM side WHERE nd='increasing' AND od<>'increasing'
  UNION ALL SELECT company, 'cash_without_income', 'opportunity' FROM side WHERE nd<>'increasing' AND od='increasing')"""
TREND_FINDINGS_SQL = f"{ITEMS_SQL}, {_SERIES}, {_TREND_FINDINGS} SELECT * FROM tf".replace("VOLATILE", "0.25")


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    li = line_items(spark, d)
    return N.all_findings(S.latest_ratios(li), N.bounds_table(spark), T.analyze_trends(metric_series(spark, d), ["company", "metric"]), ["company"])


ALL_FINDINGS_SQL = f"""SELECT company, 'trend' AS source, rule_id, finding FROM ({TREND_FINDINGS_SQL})
UNION ALL SELECT company, 'ratio', rule_id, finding FROM (WITH r AS ({LATEST_RATIOS_SQL.replace('round((', '((').replace(',0),6) AS value', ',0)) AS value')}), b(rule_id, ratio_key, low, low_in, high, high_in, finding) AS (VALUES {_BOUND_ROWS}) SELECT company, rule_id, finding FROM r JOIN b USING (ratio_key) WHERE (low IS NULL OR value>low OR (low_in AND value=low)) AND (high IS NULL OR value<high OR (high_in AND value=high)))"""


# ---- statements and line items -----------------------------------------------------------------------------
FALLBACK = ["Profit for the period", "Operating profit", "Profit before tax", "Gross profit"]


def line_item_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first of several profit items that each income statement has."""
    li = table(spark, d, "line_items").where("statement_type = 'income_statement'").withColumn("seq", F.struct("loaded_at", "item_id", "value"))
    return S.first_present(li, ["statement_id"], FALLBACK).select("statement_id", "name", F.round("value", 6).alias("value"))


FALLBACK_SQL = f"""WITH l AS (SELECT statement_id, name, value, list_position([{', '.join(repr(n) for n in FALLBACK)}], name) AS p FROM line_items WHERE statement_type='income_statement' AND name IN ({', '.join(repr(n) for n in FALLBACK)})
  QUALIFY row_number() OVER (PARTITION BY statement_id, name ORDER BY loaded_at DESC, item_id DESC, value DESC NULLS LAST)=1)
SELECT statement_id, name, round(value,6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY p)=1"""


def last_items(spark: SparkSession, d: str) -> DataFrame:
    """One row a statement and exact name: the item added last."""
    li = table(spark, d, "line_items").where("name is not null").select("statement_id", "name", "item_id", "value", F.struct("loaded_at", "item_id", "value").alias("seq"))
    return S.last_line_item(li, ["statement_id"]).select("statement_id", "name", "item_id", "value")


LAST_ITEMS_SQL = "SELECT statement_id, name, item_id, value FROM line_items WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY statement_id, name ORDER BY loaded_at DESC, item_id DESC, value DESC NULLS LAST)=1"


def section_items(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of each section of the list, in the list's order, that the statements have by exact name."""
    acc = table(spark, d, "accounts").groupBy(F.col("statement").alias("statement_type"), "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("account_id", "account"))), lambda x: x["account"]).alias("names"))
    li = table(spark, d, "line_items").where("name is not null").groupBy("statement_type", "name").agg(F.count("*").alias("n_items"))
    return S.section_items(acc, li, ["statement_type"]).groupBy("statement_type", "pos", "name").agg(F.sum("n_items").alias("n_items"))


SECTION_SQL = "WITH a AS (SELECT statement AS statement_type, account AS name, CAST(row_number() OVER (PARTITION BY statement, section ORDER BY account_id) - 1 AS INT) AS pos FROM accounts), n AS (SELECT statement_type, name, count(*) AS n_items FROM line_items WHERE name IS NOT NULL GROUP BY 1,2) SELECT statement_type, pos, name, sum(n_items) AS n_items FROM a JOIN n USING (statement_type, name) GROUP BY 1,2,3"


def company_statements(spark: SparkSession, d: str) -> DataFrame:
    """The three analysed types of the company with most statements: count and mean confidence a type."""
    s = table(spark, d, "statements").dropDuplicates(["statement_id"])
    top = s.where("company_name is not null").groupBy("company_name").count().orderBy(F.desc("count"), "company_name").first()
    own = S.by_type(S.of_company(s, top["company_name"] if top else None))
    return own.groupBy("company_name", "statement_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence"))


COMPANY_SQL = "WITH s AS (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY extraction_date)=1), t AS (SELECT company_name FROM s WHERE company_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, company_name LIMIT 1) SELECT company_name, statement_type, count(*) AS n, round(avg(confidence_score),6) AS confidence FROM s JOIN t USING (company_name) WHERE statement_type IN ('balance_sheet','income_statement','cash_flow') GROUP BY 1,2"


def period_faults(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose month lies outside the first half of the year, by the range check."""
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"), F.quarter("o_orderdate").alias("quarter"))
    return S.period_faults(o, {"month": (1, 6), "quarter": (1, 4)}).select("o_orderkey", "month", "fault")


FAULTS_SQL = "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month, 'month' AS fault FROM orders WHERE month(o_orderdate) NOT BETWEEN 1 AND 6"


def metric_accessor(spark: SparkSession, d: str) -> DataFrame:
    """A series by property, by item name and by an expression of its own."""
    li = line_items(spark, d)
    m, k = S.measures(S.pivot_items(li, ["company", "fiscal_year"])), ["company", "fiscal_year"]
    parts = [S.metric_points(m, li, k, "net_income"), S.metric_points(m, li, k, "Interest Expense"), S.metric_points(m, li, k, F.col("net_income") / F.col("revenue"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*k, "metric", F.round("value", 5).alias("value"))


ACCESSOR_SQL = ITEMS_SQL + " SELECT company, fiscal_year, 'net_income' AS metric, round(ni,5) AS value FROM m UNION ALL SELECT company, fiscal_year, 'Interest Expense', round(interest,5) FROM m UNION ALL SELECT company, fiscal_year, 'custom_metric', round(ni/revenue,5) FROM m"


# ---- chunks: metadata, contexts, names ---------------------------------------------------------------------
def metadata_passed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that pass metadata filters; keys a chunk lacks pass."""
    return chunks_once(spark, d).where(R.metadata_pass({"page": "7", "section": "summary"})).select("chunk_id")


PASSED_SQL = f"WITH {CHUNKS_SQL} SELECT chunk_id FROM c WHERE coalesce(metadata['page']='7', NOT coalesce(list_contains(map_keys(metadata),'page'),false)) AND coalesce(metadata['section']='summary', NOT coalesce(list_contains(map_keys(metadata),'section'),false))"


def prompt_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata keys that a prompt may hold, read back from their JSON."""
    j = chunks_once(spark, d).where("metadata is not null").select("chunk_id", N.context_metadata(F.col("metadata")).alias("j"))
    return j.select("chunk_id", F.explode(F.from_json("j", "map<string,string>")).alias("key", "value"))


PROMPT_SQL = f"WITH {CHUNKS_SQL}, e AS (SELECT chunk_id, unnest(map_entries(metadata)) AS e FROM c WHERE metadata IS NOT NULL) SELECT chunk_id, e.key AS key, e.value AS value FROM e WHERE e.key IN ({', '.join(repr(k) for k in V.CONTEXT_KEYS)}) AND e.value IS NOT NULL"


def query_types(spark: SparkSession, d: str) -> DataFrame:
    """Kind of a question on each chunk's statement type with the chunk as its hit."""
    q = F.concat(F.lit("Give me an overview of "), F.coalesce("statement_type", F.lit("this")))
    c = chunks_once(spark, d).where("content is not null").withColumn("q", F.when(F.col("contains_table"), "What are the numbers?").otherwise(q))
    return c.select("chunk_id", N.query_type(F.col("q"), F.col("content")).alias("query_type"))


_Q = "CASE WHEN contains_table THEN 'What are the numbers?' ELSE 'Give me an overview of '||coalesce(statement_type,'this') END"
QUERY_TYPE_SQL = f"WITH {CHUNKS_SQL}, q AS (SELECT chunk_id, content, {_Q} AS q FROM c WHERE content IS NOT NULL), n AS (SELECT *, " + "+".join(f"CAST(contains(lower(q||' '||content), '{t}') AS INT)" for t in V.CHUNK_TERMS) + " AS n FROM q) SELECT chunk_id, CASE WHEN n>2 OR contains(lower(q),'financial analysis') THEN 'analysis' WHEN regexp_matches(lower(q),'summar|overview|key points|main findings') OR length(content)>10000 THEN 'summarization' ELSE 'query' END AS query_type FROM n"


def table_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Text around three tables of each document."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    t = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("table_index"))
    return N.table_context(docs, t).select("doc_id", "table_index", F.md5("context").alias("digest"))


CONTEXT_SQL = "WITH p AS (SELECT doc_id, string_split(text, chr(10)||chr(10)) AS p FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, p, unnest([0,1,2]) AS table_index, greatest(len(p)//3, 1) AS k FROM p) SELECT doc_id, CAST(table_index AS INT) AS table_index, md5(array_to_string(p[greatest(table_index*k-2,0)+1 : least((table_index+1)*k+2, len(p))], chr(10)||chr(10))) AS digest FROM t"


def company_names(spark: SparkSession, d: str) -> DataFrame:
    i = D.company_info(F.col("content"))
    return _texts(spark, d).select("chunk_id", i["name"].alias("name"), i["ticker"].alias("ticker"))


COMPANY_NAMES_SQL = f"WITH {CHUNKS_SQL}, x AS (SELECT chunk_id, nullif(regexp_extract(content, '{_re(V.COMPANY_LISTED)}', 2),'') AS ticker, trim(regexp_extract(content, '{_re(V.COMPANY_LISTED)}', 1)) AS n1, nullif(trim(regexp_extract(content, '{_re(V.COMPANY_SUFFIX)}', 1)),'') AS n2 FROM c WHERE content IS NOT NULL) SELECT chunk_id, coalesce(CASE WHEN ticker IS NOT NULL THEN n1 ELSE n2 END, 'Unknown Company') AS name, ticker FROM x"


def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that question patterns find in each chunk, with their number."""
    return _texts(spark, d).select("chunk_id", F.explode(D.query_entities(F.col("content"))).alias("kind", "found")).select("chunk_id", "kind", F.size("found").alias("n"), F.get("found", 0).alias("first"))


QUESTION_SQL = f"WITH {CHUNKS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS kind, regexp_extract_all(content, '{_re(p)}') AS f FROM c WHERE content IS NOT NULL" for k, p in V.QUERY_ENTITY_PATTERNS.items()) + ") SELECT chunk_id, kind, len(f) AS n, f[1] AS first FROM m WHERE len(f)>0"


def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Account names with the synonyms of their words."""
    a = table(spark, d, "accounts").select("account_id", "account")
    return a.select("account_id", D.expand_query(F.col("account")).alias("expanded"))


_REV: dict[str, str] = {}
for _c, _ss in V.SYNONYMS.items():
    _REV.update({s.lower(): _c for s in _ss})
_MORE = "map {" + ", ".join(f"'{s}': '{' '.join(V.SYNONYMS[c])}'" for s, c in _REV.items()) + "}"
EXPANDED_SQL = f"WITH t AS (SELECT account_id, account, list_filter(list_transform(string_split_regex(lower(trim(account)), '\\s+'), lambda w: {_MORE}[w]), lambda w: w IS NOT NULL) AS x FROM accounts) SELECT account_id, CASE WHEN len(x)>0 THEN account||' '||array_to_string(x,' ') ELSE account END AS expanded FROM t"


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """All that is found in each chunk: category, key information and metrics."""
    return _texts(spark, d).select("chunk_id", F.explode(D.document_metadata(F.col("content"))).alias("kind", "found")).select("chunk_id", "kind", F.size("found").alias("n"), F.get("found", 0).alias("first"))


def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary terms in each chunk with their places."""
    return _texts(spark, d).select("chunk_id", F.explode(D.entity_spans(F.col("content"))).alias("s")).select("chunk_id", "s.entity_type", "s.start", "s.end", "s.text")


_SPAN_TERMS = ", ".join(f"('{tag}','{_re(t.lower())}')" for tag, ts in V.FINANCIAL_TERMS.items() for t in ts)
SPANS_SQL = f"""WITH {CHUNKS_SQL}, t(entity_type, term) AS (VALUES {_SPAN_TERMS}),
s AS (SELECT chunk_id, content, entity_type, term, string_split(lower(content), term) AS cut FROM c, t WHERE content IS NOT NULL AND contains(lower(content), term)),
k AS (SELECT *, unnest(range(1, len(cut))) AS k FROM s),
a AS (SELECT chunk_id, content, entity_type, term, CAST(length(array_to_string(cut[1:k], '')) + (k-1)*length(term) AS INT) AS a FROM k)
SELECT chunk_id, entity_type, a AS start, CAST(a+length(term) AS INT) AS "end", substr(content, a+1, length(term)) AS text FROM a"""


def tagged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and cells that the table tags set apart, a chunk."""
    t = _texts(spark, d).select("chunk_id", tag_text(F.col("content"), "tables").alias("t"))
    return t.select("chunk_id", F.regexp_count("t", F.lit(r"\[ROW\]")).alias("n_rows"), F.regexp_count("t", F.lit(r"\[CELL\]")).alias("n_cells")).where("n_rows > 0")


TAGGED_SQL = f"""WITH {CHUNKS_SQL}, l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS l FROM c WHERE content IS NOT NULL),
s AS (SELECT chunk_id, trim(l, ' '||chr(9)||chr(13)) AS l, CASE WHEN contains(trim(l,' |'),'|') THEN '|' WHEN contains(trim(l,' ,'),',') THEN ',' END AS sep FROM l)
SELECT chunk_id, count(*) AS n_rows, sum(len(string_split(l, sep))) AS n_cells FROM s WHERE sep IS NOT NULL AND l<>'' GROUP BY 1"""


def tagged_titles(spark: SparkSession, d: str) -> DataFrame:
    """Statement titles of each account section and document by their tag."""
    a = table(spark, d, "accounts").select(F.concat_ws(" ", F.col("account_id").cast("string"), F.translate("statement", "_", " "), F.lit("and"), F.translate(F.upper("statement"), "_", " "), F.lit("statement")).alias("t"), F.col("account_id").cast("bigint").alias("id"))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("text").alias("t"), F.col("doc_id").alias("id"))
    t = a.unionByName(docs).select("id", tag_text(F.col("t"), "statements").alias("t"))
    return t.select("id", F.explode(F.regexp_extract_all("t", F.lit(r"\[/([A-Z_]+)\]"), F.lit(1))).alias("tag")).groupBy("id", "tag").agg(F.count("*").alias("n"))


TITLES_SQL = f"""WITH a AS (SELECT CAST(account_id AS BIGINT) AS id, account_id||' '||replace(statement,'_',' ')||' and '||replace(upper(statement),'_',' ')||' statement' AS t FROM accounts UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, regexp_replace(lower(unnest(regexp_extract_all(t, '(?i){_re(V.STATEMENT_TITLES)}'))), '\\s+', ' ', 'g') AS t FROM a)
SELECT id, CASE WHEN contains(t,'balance sheet') OR contains(t,'financial position') THEN 'BALANCE_SHEET' WHEN contains(t,'income statement') OR contains(t,'profit and loss') OR contains(t,'operations') THEN 'INCOME_STATEMENT' WHEN contains(t,'cash flow') THEN 'CASH_FLOW' WHEN contains(t,'changes in equity') THEN 'EQUITY_STATEMENT' WHEN contains(t,'comprehensive income') THEN 'COMPREHENSIVE_INCOME' ELSE 'STATEMENT' END AS tag, count(*) AS n FROM t GROUP BY 1,2"""


def tagged_terms(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary terms of each chunk, whole words, the longest first, counted by tag."""
    t = _texts(spark, d).select("chunk_id", tag_text(F.col("content"), "terms").alias("t"))
    return t.select("chunk_id", F.explode(F.regexp_extract_all("t", F.lit(r"\[/(METRIC|RATIO|STATEMENT|REGULATION)\]"), F.lit(1))).alias("tag")).groupBy("chunk_id", "tag").agg(F.count("*").alias("n"))


_LONGEST = sorted(((t, tag) for tag, ts in V.FINANCIAL_TERMS.items() for t in ts), key=lambda x: (-len(x[0]), x[0]))
_TAG_OF = "CASE " + " ".join(f"WHEN t='{_re(t.lower())}' THEN '{tag}'" for t, tag in _LONGEST) + " END"
_ALTS = "|".join(t.replace("'", "''").replace("-", "\\-").replace("/", "/") for t, _ in _LONGEST)
TERMS_SQL = f"""WITH {CHUNKS_SQL}, t AS (SELECT chunk_id, lower(unnest(regexp_extract_all(content, '(?i)\\b({_ALTS})\\b', 1))) AS t FROM c WHERE content IS NOT NULL)
SELECT chunk_id, {_TAG_OF} AS tag, count(*) AS n FROM t GROUP BY 1,2"""


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_count(chunks_once(spark, d).where("doc_id is not null")).select("chunk_id", "chunk_count")


COUNTS_SQL = f"WITH {CHUNKS_SQL} SELECT chunk_id, count(*) OVER (PARTITION BY doc_id) AS chunk_count FROM c WHERE doc_id IS NOT NULL"


def topic_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each recorded topic with their share of its chunks."""
    return TP.topic_documents(chunks_once(spark, d).where("topic_id is not null")).select("topic_id", "doc_id", "n", F.round("share", 8).alias("share"))


TOPIC_SHARES_SQL = f"WITH {CHUNKS_SQL} SELECT topic_id, doc_id, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY topic_id),8) AS share FROM c WHERE topic_id IS NOT NULL GROUP BY 1,2"


def sheet_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers rendered as workbooks, a sheet a nation, cut by their markers."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lines = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), "\n").alias("t"))
    books = lines.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "t"))), lambda x: F.concat(F.lit("--- Sheet: "), x["n_name"], F.lit(" ---\n"), x["t"], F.lit("\n"))), "").alias("content"))
    return C.chunk_sheets(books, doc="n_regionkey").select("n_regionkey", "chunk_index", "sheet", F.regexp_count("chunk", F.lit(r"\d+")).alias("n_lines"))


SHEETS_SQL = "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)-1 AS INT) AS chunk_index, n_name AS sheet, count(*) AS n_lines FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY n_regionkey, n_name"


def parsed_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements parsed from all chunks: tables found, and what the log says of the others."""
    docs = _texts(spark, d).withColumnRenamed("chunk_id", "doc_id")
    s, _, log = P.parse_statements(docs)
    return P.parse_summary(docs, s, log).select("doc_id", "n_statements", F.round("confidence", 6).alias("confidence"), "n_messages", "successful")


# ---- retrieval and vectors ---------------------------------------------------------------------------------
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """A question answered in one plan: entities, else keywords, then metadata, then the first ten."""
    return R.search(chunks_once(spark, d), recorded_postings(spark, d), "working capital and goodwill", {"page": "7"}, 10)


_SEARCH_TERMS = ["working", "capital", "and", "goodwill"]
SEARCH_SQL = f"WITH {CHUNKS_SQL}, h AS (SELECT chunk_id, " + "+".join(f"CAST(contains(lower(content),'{t}') AS BIGINT)" for t in _SEARCH_TERMS) + " AS matches FROM c WHERE content IS NOT NULL AND coalesce(metadata['page']='7', NOT coalesce(list_contains(map_keys(metadata),'page'),false))) SELECT chunk_id, matches FROM h WHERE matches>0 ORDER BY matches DESC, chunk_id LIMIT 10"


def batch_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector and the next one by id, strong above 0.6, per label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    p = e.select("vec_id", "label", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return R.pair_similarity(p).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.avg(F.col("strong").cast("int")), 6).alias("strong_share"))


SIMILARITY_SQL = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON b.vec_id=a.vec_id+1) SELECT label, count(*) AS n, round(avg(s),6) AS mean_similarity, round(avg(CAST(s>0.6 AS INT)),6) AS strong_share FROM p GROUP BY 1"


def hybrid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Index hits first (four rows of a label), then the nearest vectors that are not among them, ten in all."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    first = e.orderBy("vec_id").select("embedding").first()
    hits = e.where("label = 3").orderBy("vec_id").limit(4).select("vec_id")
    near = R.vector_topk(e, list(first[0]) if first else [], 14)
    return R.hybrid_merge(hits, near, 10, "vec_id").select("vec_id", "origin", F.round("distance", 6).alias("distance"))


HYBRID_SQL = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id FROM e WHERE label=3 ORDER BY vec_id LIMIT 4), n AS (SELECT vec_id, 1-list_cosine_similarity(v, qv) AS d FROM e, q ORDER BY d, vec_id LIMIT 14) SELECT vec_id, origin, round(d,6) AS distance FROM (SELECT vec_id, 'index' AS origin, 0.0 AS d, 0 AS o FROM h UNION ALL SELECT vec_id, 'vector', d, 1 FROM n WHERE vec_id NOT IN (SELECT vec_id FROM h)) ORDER BY o, d, vec_id LIMIT 10"


def weighted_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's term weight on a plain vector, then its regions, then cut to width."""
    v = F.array(*[F.lit(float(k + 1)) for k in range(20)])
    t = _texts(spark, d)
    w = t.select("chunk_id", "content", R.apply_term_weight(F.col("content"), v).alias("w"))
    r = w.select("chunk_id", "w", R.weight_regions(F.col("content"), v, {"METRIC": 1.5, "RATIO": 2.0}).alias("r"))
    return r.select("chunk_id", F.round(F.get("w", 19), 6).alias("weighted"), F.round(F.get("r", 0), 8).alias("region_0"), F.round(F.get("r", 2), 8).alias("region_1"), F.round(F.get(R.fit_width(F.col("w"), 4), 3), 8).alias("fitted"))


def _held(tag: str) -> str:
    return "least(10*(" + "+".join(f"(length(lower(content))-length(replace(lower(content),'{_re(t.lower())}','')))" for t in V.FINANCIAL_TERMS[tag]) + ")/nullif(length(content),0),1)"


_TW = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(content),'{t}') THEN {w} END" for t, w in V.TERM_WEIGHTS.items()) + "], lambda x: x IS NOT NULL)"
WEIGHTED_SQL = f"""WITH {CHUNKS_SQL}, t AS (SELECT chunk_id, {_TW} AS ws, 1+0.5*coalesce({_held('METRIC')},0) AS s0, 1+1.0*coalesce({_held('RATIO')},0) AS s1 FROM c WHERE content IS NOT NULL),
n AS (SELECT *, sqrt(s0*s0*5 + s1*s1*25 + {sum((k + 1) ** 2 for k in range(4, 20))}) AS n FROM t)
SELECT chunk_id, round(20*CASE WHEN len(ws)>0 THEN 0.7+0.3*list_avg(ws) ELSE 1 END,6) AS weighted, round(s0/n,8) AS region_0, round(3*s1/n,8) AS region_1, round(4/sqrt(30),8) AS fitted FROM n"""

LAYER, BIAS = [[0.5, -0.25, 1.0, 0.0], [0.1, 0.2, 0.3, 0.4]], [0.05, -0.1]


def projected_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding is not null")
    p = R.project(F.slice(F.col("embedding").cast("array<double>"), 1, 4), LAYER, BIAS)
    return e.select("vec_id", F.round(F.get(p, 0), 8).alias("p0"), F.round(F.get(p, 1), 8).alias("p1"))


PROJECTED_SQL = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, " + ", ".join("round(tanh(" + "+".join(f"{w}*v[{k + 1}]" for k, w in enumerate(row)) + f"+({b})),8) AS p{j}" for j, (row, b) in enumerate(zip(LAYER, BIAS))) + " FROM e"


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Entity contexts encoded through a cache that holds those of metrics; the stand-in encoder counts signs."""
    e = table(spark, d, "entities").where("context is not null").select("entity_id", "entity_type", "context").distinct()
    encode = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    cache = e.where("entity_type = 'financial_metric'").select(F.sha2("context", 256).alias("text_key"), F.array(F.length("context").cast("double"), F.lit(0.0)).alias("embedding")).dropDuplicates(["text_key"])
    return N.cached_embeddings(e, cache, encode, "context").select("entity_id", "context", F.get("embedding", 0).alias("n_chars"), F.get("embedding", 1).alias("fresh"))


CACHE_SQL = "WITH e AS (SELECT DISTINCT entity_id, entity_type, context FROM entities WHERE context IS NOT NULL) SELECT entity_id, context, CAST(length(context) AS DOUBLE) AS n_chars, CASE WHEN context IN (SELECT context FROM e WHERE entity_type='financial_metric') THEN 0.0 ELSE 1.0 END AS fresh FROM e"


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The prompt's context of the twenty longest chunks, cut at its limit."""
    h = _texts(spark, d).orderBy(F.desc(F.length("content")), "chunk_id").limit(20)
    h = h.withColumn("rank", F.struct(-F.length("content"), F.col("chunk_id")))
    return R.context_prompt(h, limit=2000).select(F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


PROMPT_CONTEXT_SQL = f"WITH {CHUNKS_SQL}, h AS (SELECT chunk_id, content FROM c WHERE content IS NOT NULL ORDER BY length(content) DESC, chunk_id LIMIT 20), j AS (SELECT string_agg(content, chr(10)||chr(10) ORDER BY length(content) DESC, chunk_id) AS t FROM h), k AS (SELECT CASE WHEN length(t)>2000 THEN substr(t,1,2000)||chr(10)||chr(10)||'[Context truncated]' ELSE t END AS t FROM j) SELECT length(t) AS n_chars, md5(t) AS digest FROM k"


def events_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of two hours every hour, by the operator that streams use."""
    e = table(spark, d, "events").where("ts is not null")
    w = I.windowed_counts(e, "ts", "event_type", "value", "2 hours", "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


WINDOWED_SQL = "WITH e AS (SELECT event_type, value, date_trunc('hour', ts) AS h FROM events WHERE ts IS NOT NULL), w AS (SELECT event_type, value, h - unnest([0,1]) * INTERVAL 1 HOUR AS s FROM e) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM w GROUP BY 1,2"


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user by the operator that streams use."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    s = I.session_counts(e, "ts", "user_id", "30 minutes")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


USER_SESSIONS_SQL = "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"

METADATA_SQL = f"SELECT chunk_id, 'doc_category' AS kind, 1 AS n, category AS first FROM ({CATEGORY_SQL}) UNION ALL SELECT chunk_id, metric, 1, amount FROM ({METRIC_SQL}) UNION ALL SELECT chunk_id, kind, n, first FROM ({KEY_INFO_SQL})"

QUERIES = {
    trend_metrics: TREND_METRICS_SQL, trend_findings: TREND_FINDINGS_SQL, all_findings: ALL_FINDINGS_SQL, line_item_fallback: FALLBACK_SQL, last_items: LAST_ITEMS_SQL, section_items: SECTION_SQL, company_statements: COMPANY_SQL, period_faults: FAULTS_SQL, metric_accessor: ACCESSOR_SQL,
    metadata_passed: PASSED_SQL, prompt_metadata: PROMPT_SQL, query_types: QUERY_TYPE_SQL, table_contexts: CONTEXT_SQL, company_names: COMPANY_NAMES_SQL, question_entities: QUESTION_SQL, expanded_queries: EXPANDED_SQL, document_metadata: METADATA_SQL, entity_spans: SPANS_SQL,
    tagged_tables: TAGGED_SQL, tagged_titles: TITLES_SQL, tagged_terms: TERMS_SQL, chunk_counts: COUNTS_SQL, topic_shares: TOPIC_SHARES_SQL, sheet_chunks: SHEETS_SQL, parsed_statements: None, chunk_search: SEARCH_SQL, batch_similarity: SIMILARITY_SQL, hybrid_vectors: HYBRID_SQL,
    weighted_vectors: WEIGHTED_SQL, projected_vectors: PROJECTED_SQL, embedding_cache: CACHE_SQL, prompt_context: PROMPT_CONTEXT_SQL, events_windowed: WINDOWED_SQL, user_sessions: USER_SESSIONS_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in QUERIES.items() if sql}
