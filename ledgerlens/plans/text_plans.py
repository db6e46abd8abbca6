"""Queries over chunks, documents and uploads: detection, segmentation, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.functions.tagging import tag_text
from ledgerlens.operators import chunking as C
from ledgerlens.operators import detect as D
from ledgerlens.operators import quality as Q
from ledgerlens.operators.statements import where_filter
from ledgerlens.sources.tables import table


def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with repeated rows once."""
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


CHUNKS_SQL = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at)=1)"


def _re(p: str) -> str:
    return p.replace("'", "''")


def category_argmax(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).where("content is not null").select("chunk_id", D.document_category(F.col("content")).alias("category"))


CATEGORY_SQL = f"WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, [" + ", ".join("(" + "+".join(f"len(regexp_extract_all(content, '(?i)\\b{_re(w)}\\b'))" for w in ws) + ")" for ws in V.CATEGORY_INDICATORS.values()) + f"] AS n FROM c WHERE content IS NOT NULL) SELECT chunk_id, CASE WHEN list_max(n)=0 THEN 'general_financial' ELSE [{', '.join(repr(k) for k in V.CATEGORY_INDICATORS)}][list_position(n, list_max(n))] END AS category FROM s"


def statement_keyword_type(spark: SparkSession, d: str) -> DataFrame:
    kind, conf = D.statement_keywords(F.col("content"))
    return chunks_once(spark, d).where("content is not null").select("chunk_id", kind.alias("statement_kind"), F.round(conf, 6).alias("confidence"))


_KW = {t: "(" + "+".join(f"CAST(contains(lower(content), '{_re(w)}') AS INT)" for w in ws) + ")" for t, ws in V.STATEMENT_KEYWORDS.items()}
KEYWORD_SQL = f"WITH {CHUNKS_SQL}, s AS (SELECT chunk_id, {_KW['balance_sheet']} AS b, {_KW['income_statement']} AS i, {_KW['cash_flow']} AS f FROM c WHERE content IS NOT NULL), k AS (SELECT *, CASE WHEN greatest(b,i,f)=0 THEN 'unknown' WHEN b>=i AND b>=f THEN 'balance_sheet' WHEN i>=f THEN 'income_statement' ELSE 'cash_flow' END AS statement_kind FROM s) SELECT chunk_id, statement_kind, round(CASE statement_kind WHEN 'balance_sheet' THEN b/13.0 WHEN 'income_statement' THEN i/14.0 WHEN 'cash_flow' THEN f/9.0 ELSE 0 END,6) AS confidence FROM k"


def chunk_detection(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return chunks_once(spark, d).where("content is not null").select("chunk_id", D.statement_title_type(c).alias("title_type"), D.has_table(c).alias("has_table"), F.concat_ws(",", D.chunk_terms(c)).alias("terms"), D.financial_period(c).alias("period"))


_TITLE = "CASE " + " ".join(f"WHEN regexp_matches(content, '{_re(p)}') THEN '{t}'" for t, p in V.STATEMENT_PATTERNS.items()) + " ELSE 'unknown' END"
_TERM_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '(?i)\\b{t}\\b') THEN '{t}' END" for t in V.CHUNK_TERMS) + "], lambda x: x IS NOT NULL)"
_PERIOD = "coalesce(" + ", ".join(f"nullif(regexp_extract(content, '{_re(p)}', 0), '')" for p in V.PERIOD_PATTERNS) + ")"
DETECT_SQL = f"WITH {CHUNKS_SQL} SELECT chunk_id, {_TITLE} AS title_type, regexp_matches(content, '{V.TABLE_PATTERN}') AS has_table, array_to_string({_TERM_LIST}, ',') AS terms, {_PERIOD} AS period FROM c WHERE content IS NOT NULL"


def metric_amounts(spark: SparkSession, d: str) -> DataFrame:
    return chunks_once(spark, d).where("content is not null").select("chunk_id", F.explode(D.metrics(F.col("content"))).alias("metric", "amount"))


METRIC_SQL = f"WITH {CHUNKS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS metric, regexp_extract(content, '{_re(p)}', 1) AS amount FROM c WHERE content IS NOT NULL" for k, p in V.METRIC_PATTERNS.items()) + ") SELECT * FROM m WHERE amount<>''"


def key_info(spark: SparkSession, d: str) -> DataFrame:
    """Number and first of the finds of every kind in each chunk, potential companies included."""
    k = chunks_once(spark, d).where("content is not null").select("chunk_id", F.explode(D.key_info(F.col("content"))).alias("kind", "found"))
    return k.select("chunk_id", "kind", F.size("found").alias("n"), F.get("found", 0).alias("first"))


_KIND = {"companies": "potential_companies"}
KEY_INFO_SQL = f"WITH {CHUNKS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT chunk_id, '{_KIND.get(k, k)}' AS kind, list_distinct(regexp_extract_all(content, '{_re(V.ENTITY_PATTERNS[k])}')[1:10]) AS f, regexp_extract_all(content, '{_re(V.ENTITY_PATTERNS[k])}')[1] AS first FROM c WHERE content IS NOT NULL" for k in ("companies", "monetary_values", "dates", "percentages")) + ") SELECT chunk_id, kind, len(f) AS n, first FROM m WHERE len(f)>0"


def text_periods(spark: SparkSession, d: str) -> DataFrame:
    p = chunks_once(spark, d).where("content is not null").select("chunk_id", F.posexplode(D.periods(F.col("content"))).alias("pos", "p"))
    return p.select("chunk_id", "pos", "p.period_type", *[F.coalesce(F.col(f"p.{c}").cast("string"), F.lit("")).alias(c) for c in ("fiscal_year", "fiscal_quarter", "end_date")])


def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Money and units of entity values in plain numbers."""
    e = table(spark, d, "entities").where("value is not null").select("entity_id", "value").distinct()
    return e.select("entity_id", tag_text(F.col("value"), "money").alias("money"), tag_text(F.col("value"), "units").alias("units"))


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content")).where("content is not null")
    return C.chunk_paragraphs(docs).select("doc_id", "chunk_index", "chunk_id", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.lit("windows").alias("how"))
    return C.chunk_documents(docs, by="how").select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def chunk_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "doc_type")
    docs = docs.withColumn("how", C.strategy(F.col("doc_type"), F.when(F.col("content").rlike("(?i)notes? \\d"), "notes").when(F.col("content").rlike("(?m)^[A-Z][A-Z ]+[A-Z]$"), "management_discussion")))
    return C.chunk_documents(docs, by="how").select("doc_id", "how", "chunk_index", "section_type", "title", "statement_type", "contains_table", "financial_period", F.length("chunk").alias("n_chars"))


def table_row_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parts rendered as a table per brand, cut in pieces of 100 lines under their header."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.concat_ws("\n", F.lit("partkey,size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: F.concat(x["p_partkey"].cast("string"), F.lit(","), x["p_size"].cast("string"))), "\n")).alias("content"))
    return C.chunk_table_rows(p, doc="p_brand").select("p_brand", "chunk_index", "first_row", "last_row", F.size(F.split("chunk", "\n")).alias("n_lines"), F.md5("chunk").alias("digest"))


TABLE_ROWS_SQL = """
WITH p AS (SELECT p_brand, p_partkey||','||p_size AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_size) AS i FROM part),
g AS (SELECT p_brand, i//100 AS chunk_index, min(i) AS a, max(i) AS b, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS t FROM p GROUP BY 1,2)
SELECT p_brand, CAST(chunk_index AS INT) AS chunk_index, greatest(chunk_index*100,1) AS first_row, b AS last_row, k+1 AS n_lines, md5('partkey,size'||chr(10)||t) AS digest FROM g"""


def where_filtered(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.where(where_filter({"lang": {"$in": ["en", "de"]}, "source": {"$ne": "news_wire"}, "$or": [{"doc_type": "annual_report"}, {"n_chars": {"$gte": 1000}}]}, t.columns)).select("doc_id", "lang", "source", "doc_type")


WHERE_SQL = "SELECT doc_id, lang, source, doc_type FROM documents WHERE lang IN ('en','de') AND source<>'news_wire' AND (doc_type='annual_report' OR n_chars>=1000)"


def metadata_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d)
    return c.where(where_filter({"page": {"$ne": "7"}, "statement_type": "notes"}, c.columns, "metadata")).select("chunk_id", F.col("metadata")["page"].alias("page"))


METADATA_SQL = f"WITH {CHUNKS_SQL} SELECT chunk_id, metadata['page'] AS page FROM c WHERE metadata['page']<>'7' AND statement_type='notes'"


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.collection_stats(chunks_once(spark, d), ["statement_type"])


STATS_SQL = f"WITH {CHUNKS_SQL} SELECT statement_type, count(*) AS n_chunks, count(DISTINCT nullif(doc_id,'')) AS n_docs, sum(CAST(contains_table AS INT)) AS n_tables, round(avg(length(content)),4) AS mean_chars FROM c GROUP BY 1"


def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return Q.type_shares(chunks_once(spark, d))


SHARES_SQL = f"WITH {CHUNKS_SQL} SELECT statement_type, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS percent FROM c GROUP BY 1"


def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    return Q.entity_frequency(chunks_once(spark, d))


FREQUENCY_SQL = f"WITH {CHUNKS_SQL}, e AS (SELECT lower(unnest(financial_entities)) AS entity FROM c) SELECT entity, count(*) AS n FROM e WHERE entity IS NOT NULL GROUP BY 1 ORDER BY n DESC, entity LIMIT 15"


def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_once(spark, d).where("content is not null")
    return Q.entity_coverage(c.withColumn("found", D.chunk_terms(F.col("content"))), "found")


COVERAGE_SQL = f"WITH {CHUNKS_SQL}, w AS (SELECT unnest([{', '.join(repr(e) for e in V.EXPECTED_ENTITIES)}]) AS entity), n AS (SELECT entity, (SELECT count(*) FROM c WHERE regexp_matches(content, '(?i)\\b'||entity||'\\b')) AS n_chunks FROM w) SELECT entity, n_chunks, round(100.0*avg(CAST(n_chunks>0 AS INT)) OVER (),4) AS coverage_percent FROM n"


def chunk_consistency(spark: SparkSession, d: str) -> DataFrame:
    return Q.chunk_consistency(chunks_once(spark, d), ["topic_id"])


CONSISTENCY_SQL = f"WITH {CHUNKS_SQL} SELECT topic_id, count(*) AS n, round(avg(length(content)),4) AS mean_chars, round(100.0*avg(CAST(coalesce(len(financial_entities),0)>0 AS INT)),4) AS with_entities_percent, round(avg(coalesce(len(financial_entities),0)),4) AS mean_entities, bool_and(statement_type IS NOT NULL) AS all_typed FROM c GROUP BY 1"


def boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    """Type changes between successive chunks of a document; those with the same period stand for one section."""
    c = chunks_once(spark, d).withColumn("page", F.col("metadata")["page"].cast("int")).withColumn("section", F.col("financial_period"))
    # Successive chunks of a document stand for successive pages.
    return Q.boundary_violations(c.drop("page").withColumnRenamed("chunk_index", "page"), "doc_id", "page", "statement_type", "section").select("doc_id", "chunk_id", "page", "prev_kind", F.col("statement_type").alias("kind"))


BOUNDARY_SQL = f"WITH {CHUNKS_SQL}, p AS (SELECT doc_id, chunk_id, chunk_index AS page, statement_type AS kind, lag(chunk_index) OVER w AS pp, lag(statement_type) OVER w AS prev_kind, coalesce(financial_period,'')=coalesce(lag(financial_period) OVER w,'') AS same FROM c WHERE chunk_index IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)) SELECT doc_id, chunk_id, page, prev_kind, kind FROM p WHERE page-pp=1 AND kind<>prev_kind AND same"


def chunk_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the metadata of their upload, chunk keys last, and the number of chunks of the document."""
    u = table(spark, d, "upload_requests").groupBy("doc_id").agg(F.max_by("file_name", "uploaded_at").alias("file_name"), F.max_by("document_type", "uploaded_at").alias("document_type"))
    c = chunks_once(spark, d)
    n = c.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return c.join(u, "doc_id", "left").join(n, "doc_id", "left").select("chunk_id", "doc_id", "chunk_count", F.coalesce(F.col("metadata")["filename"], "file_name").alias("filename"), "document_type")


ENRICH_SQL = f"WITH {CHUNKS_SQL}, u AS (SELECT doc_id, arg_max(file_name, uploaded_at) AS file_name, arg_max(document_type, uploaded_at) AS document_type FROM upload_requests GROUP BY 1), n AS (SELECT doc_id, count(*) AS chunk_count FROM c GROUP BY 1) SELECT chunk_id, c.doc_id, chunk_count, coalesce(metadata['filename'], file_name) AS filename, document_type FROM c LEFT JOIN u USING (doc_id) LEFT JOIN n USING (doc_id)"


def task_routing(spark: SparkSession, d: str) -> DataFrame:
    """Questions on each chunk's statement type and period, routed to a task."""
    q = chunks_once(spark, d).select("chunk_id", F.concat(F.lit("Can you explain the company "), F.translate(F.coalesce("statement_type", F.lit("statement")), "_", " "), F.lit(" and its "), F.coalesce(F.get("financial_entities", 0), F.lit("valuation")), F.lit("?")).alias("q"))
    return D.route_tasks(q, "q").select("chunk_id", "task", F.round("share", 6).alias("share"), "provider")


def _counted(ps: list[str]) -> str:
    return "(" + "+".join(f"len(regexp_extract_all(q, '(?i){_re(p)}'))" for p in ps) + ")"


_TASKS = list(V.TASK_PATTERNS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ROUTING_SQL = f"""WITH {CHUNKS_SQL}, q AS (SELECT chunk_id, 'Can you explain the company '||replace(coalesce(statement_type,'statement'),'_',' ')||' and its '||coalesce(financial_entities[1],'valuation')||'?' AS q FROM c),
n AS (SELECT chunk_id, [{', '.join(_counted(ps) for ps in V.TASK_PATTERNS.values())}] AS n, {'+'.join(f"CAST(regexp_matches(q, '(?i){_re(p)}') AS INT)" for p in V.COMPLEX_PATTERNS)} AS hits, {' OR '.join(f"regexp_matches(q, '(?i){_re(p)}')" for p in V.CONTEXT_PATTERNS)} AS ctx FROM q),
s AS (SELECT *, list_sum(n) AS total, list_transform(n, lambda x: coalesce(x/nullif(list_sum(n),0),0)) AS s FROM n),
k AS (SELECT *, list_max(s) AS top, coalesce(CASE WHEN hits>=2 THEN list_filter([{', '.join(str(_TASKS.index(t) + 1) for t in V.COMPLEX_TASKS)}], lambda j: s[j]>0 AND s[j]>=0.5*list_max(s))[1] END, list_position(s, list_max(s))) AS k FROM s),
t AS (SELECT *, NOT ctx OR total=0 AS plain, CASE WHEN NOT ctx THEN 'non_financial' WHEN total=0 THEN 'general_financial' ELSE {_LIST(_TASKS)}[k] END AS task, CASE WHEN NOT ctx OR total=0 THEN 1.0 ELSE s[k] END AS share FROM k),
p AS (SELECT *, {_LIST(V.TASK_PROVIDER.values())}[list_position({_LIST(V.TASK_PROVIDER)}, task)] AS p FROM t)
SELECT chunk_id, task, round(share,6) AS share, CASE WHEN NOT plain AND (share<0.4 OR len(list_filter(range(1,{len(_TASKS) + 1}), lambda j: s[j]>=0.25 AND {_LIST(V.TASK_PROVIDER[t] for t in _TASKS)}[j]<>p))>0) THEN 'hybrid' ELSE p END AS provider FROM p"""
_YEARS = "list_transform(list_filter(list_transform(regexp_extract_all(content, '" + _re(V.PERIOD_YEAR) + "', 1), lambda x: CAST(x AS INT)), lambda y: y BETWEEN 1900 AND 2100), lambda y: {'t': 'annual', 'y': y, 'q': NULL::INT, 'e': NULL::DATE})"
_QUARTERS = "list_transform(list_filter(list_zip(regexp_extract_all(content, '" + _re(V.PERIOD_QUARTER) + "', 1), regexp_extract_all(content, '" + _re(V.PERIOD_QUARTER) + "', 2)), lambda z: CAST(z[1] AS INT) BETWEEN 1 AND 4 AND CAST(z[2] AS INT) BETWEEN 1900 AND 2100), lambda z: {'t': 'quarterly', 'y': CAST(z[2] AS INT), 'q': CAST(z[1] AS INT), 'e': NULL::DATE})"
_ENDS = "list_transform(list_filter(list_transform(regexp_extract_all(content, '" + _re(V.PERIOD_MONTHS) + "', 1), lambda x: CAST(try_strptime(x, '%B %d, %Y') AS DATE)), lambda e: e IS NOT NULL), lambda e: {'t': CASE WHEN regexp_matches(content,'three months|3 months') THEN 'quarterly' WHEN regexp_matches(content,'six months|6 months') THEN 'semi_annual' WHEN regexp_matches(content,'twelve months|12 months') THEN 'annual' ELSE 'custom' END, 'y': NULL::INT, 'q': NULL::INT, 'e': e})"
PERIODS_SQL = f"WITH {CHUNKS_SQL}, p AS (SELECT chunk_id, list_concat(list_concat({_YEARS}, {_QUARTERS}), {_ENDS}) AS p FROM c WHERE content IS NOT NULL), u AS (SELECT chunk_id, unnest(range(1, len(p)+1)) AS i, p FROM p) SELECT chunk_id, CAST(i-1 AS INT) AS pos, p[i].t AS period_type, coalesce(CAST(p[i].y AS VARCHAR), '') AS fiscal_year, coalesce(CAST(p[i].q AS VARCHAR), '') AS fiscal_quarter, coalesce(CAST(p[i].e AS VARCHAR), '') AS end_date FROM u"
PARAGRAPHS_SQL = """WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x)<>'') AS s FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, s, 1 AS i, CAST(length(s[1]) AS BIGINT) AS len, 0 AS no FROM s WHERE len(s)>0
  UNION ALL SELECT doc_id, s, i+1, CASE WHEN len>0 AND len+length(s[i+1])>1000 THEN length(s[i+1]) ELSE len+length(s[i+1]) END, CASE WHEN len>0 AND len+length(s[i+1])>1000 THEN no+1 ELSE no END FROM r WHERE i<len(s)),
c AS (SELECT doc_id, no, string_agg(s[i], chr(10)||chr(10) ORDER BY i) AS t FROM r GROUP BY 1,2)
SELECT doc_id, CAST(no AS INT) AS chunk_index, doc_id||'_chunk_'||no AS chunk_id, length(t) AS n_chars, md5(t) AS digest FROM c"""
WINDOWS_SQL = """WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, t, n, CAST(0 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM d WHERE n>0
  UNION ALL SELECT doc_id, t, n, CASE WHEN b<0 THEN a ELSE greatest(b-200, a+1) END,
    (SELECT CASE WHEN least(x+1000,n)<n AND contains(substr(t,x+1,1000),'.') AND x+1000-strpos(reverse(substr(t,x+1,1000)),'.')>x+500 THEN x+1000-strpos(reverse(substr(t,x+1,1000)),'.')+1 ELSE least(x+1000,n) END FROM (SELECT CASE WHEN b<0 THEN a ELSE greatest(b-200, a+1) END AS x))
  FROM r WHERE b<n),
w AS (SELECT doc_id, a, substr(t, a+1, b-a) AS w FROM r WHERE b>=0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a)-1 AS INT) AS chunk_index, length(w) AS n_chars, md5(w) AS digest FROM w WHERE regexp_matches(w,'\\S')"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (category_argmax, statement_keyword_type, chunk_detection, metric_amounts, key_info, text_periods, text_normalized, chunk_paragraphs, chunk_windows, chunk_by_strategy, table_row_chunks, where_filtered, metadata_filtered, collection_stats, type_shares, entity_frequency, entity_coverage, chunk_consistency, boundary_violations, chunk_enrichment, task_routing)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "category_argmax": CATEGORY_SQL, "statement_keyword_type": KEYWORD_SQL, "chunk_detection": DETECT_SQL, "metric_amounts": METRIC_SQL, "key_info": KEY_INFO_SQL, "table_row_chunks": TABLE_ROWS_SQL, "where_filtered": WHERE_SQL, "metadata_filtered": METADATA_SQL, "collection_stats": STATS_SQL,
        "type_shares": SHARES_SQL, "entity_frequency": FREQUENCY_SQL, "entity_coverage": COVERAGE_SQL, "chunk_consistency": CONSISTENCY_SQL, "boundary_violations": BOUNDARY_SQL, "chunk_enrichment": ENRICH_SQL, "task_routing": ROUTING_SQL, "text_periods": PERIODS_SQL, "chunk_paragraphs": PARAGRAPHS_SQL, "chunk_windows": WINDOWS_SQL,
    }
