"""Queries of the inverted index, vector search, topics and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import topics as TP
from ledgerlens.plans.text_plans import CHUNKS_SQL, chunks_once
from ledgerlens.sources.tables import table


def posting_index(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every ASCII word."""
    return R.token_postings(table(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("n_docs"))


POSTING_SQL = "SELECT token, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) GROUP BY 1"


def entity_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and documents of every entity of every type, companies included."""
    return R.entity_postings(chunks_once(spark, d)).groupBy("entity_type", "entity_key").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


_ENTITIES = " UNION ALL ".join(f"SELECT '{t}' AS entity_type, lower(unnest(regexp_extract_all(content, '{p}'))) AS entity_key, doc_id, chunk_id FROM c" for t, p in V.ENTITY_PATTERNS.items())
ENTITY_SQL = f"WITH {CHUNKS_SQL}, p AS (SELECT DISTINCT * FROM ({_ENTITIES})) SELECT entity_type, entity_key, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY 1,2"


def recorded_postings(spark: SparkSession, d: str) -> DataFrame:
    """(entity_type, entity_key, doc_id, chunk_id) of the entities table."""
    e = table(spark, d, "entities").where("value is not null and chunk_id is not null").select("entity_type", F.lower("value").alias("entity_key"), "chunk_id").distinct()
    return e.join(chunks_once(spark, d).select("chunk_id", "doc_id"), "chunk_id").where("doc_id is not null")


POSTINGS_SQL = CHUNKS_SQL + ", p AS (SELECT DISTINCT entity_type, lower(value) AS entity_key, chunk_id, doc_id FROM entities JOIN c USING (chunk_id) WHERE value IS NOT NULL AND doc_id IS NOT NULL)"


def related_documents(spark: SparkSession, d: str) -> DataFrame:
    """Five related documents of every upload whose number is divisible by 20."""
    p = recorded_postings(spark, d)
    of = p.select("doc_id").distinct().where(F.regexp_extract("doc_id", r"(\d+)", 1).cast("bigint") % 20 == 0)
    return R.related_documents(p, of, 5)


RELATED_SQL = f"WITH {POSTINGS_SQL}, q AS (SELECT DISTINCT doc_id AS query_doc, entity_type, entity_key FROM p WHERE CAST(regexp_extract(doc_id,'(\\d+)',1) AS BIGINT)%20=0), s AS (SELECT query_doc, p.doc_id, count(*) AS score FROM q JOIN p USING (entity_type, entity_key) WHERE p.doc_id<>query_doc GROUP BY 1,2) SELECT query_doc, doc_id, score, row_number() OVER (PARTITION BY query_doc ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank<=5"

WANTED = [("financial_term", "Goodwill"), ("financial_term", "working capital"), ("risk_indicator", "weaker pricing")]


def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return R.entity_search(recorded_postings(spark, d), spark.createDataFrame(WANTED, "entity_type string, entity_key string"), 10)


SEARCH_SQL = f"WITH {POSTINGS_SQL} SELECT chunk_id, doc_id, count(*) AS matches FROM p WHERE (entity_type, entity_key) IN (" + ", ".join(f"('{t}','{k.lower()}')" for t, k in WANTED) + ") GROUP BY 1,2 ORDER BY matches DESC, chunk_id LIMIT 10"


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_search(chunks_once(spark, d).where("content is not null"), "debt and sales", 10).select("chunk_id", "matches")


_TERMS = sorted({"debt", "and", "sales", "liability", *V.SYNONYMS["liability"], "revenue", *V.SYNONYMS["revenue"]})
KEYWORD_SQL = f"WITH {CHUNKS_SQL} SELECT chunk_id, " + "+".join(f"CAST(contains(lower(content),'{t}') AS INT)" for t in _TERMS) + " AS matches FROM c WHERE content IS NOT NULL AND matches>0 ORDER BY matches DESC, chunk_id LIMIT 10"


def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and documents per recorded topic."""
    c = chunks_once(spark, d).where("topic_id is not null")
    return c.groupBy("topic_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


TOPIC_SQL = f"WITH {CHUNKS_SQL} SELECT topic_id, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM c WHERE topic_id IS NOT NULL GROUP BY 1"


def document_index(spark: SparkSession, d: str) -> DataFrame:
    return R.document_index(chunks_once(spark, d)).select("doc_id", F.concat_ws(",", "chunk_ids").alias("chunk_ids"), "n_chunks")


INDEX_SQL = f"WITH {CHUNKS_SQL} SELECT doc_id, array_to_string(list_sort(list(chunk_id)), ',') AS chunk_ids, count(DISTINCT chunk_id) AS n_chunks FROM c GROUP BY 1"


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of the first vector."""
    e = table(spark, d, "embeddings")
    first = e.where("embedding is not null").orderBy("vec_id").select("embedding").first()
    return R.vector_topk(e, list(first[0]) if first else [], 10).select("vec_id", F.round("distance", 6).alias("distance"))


VECTOR_SQL = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) SELECT vec_id, round(1-list_cosine_similarity(CAST(embedding AS DOUBLE[]), v),6) AS distance FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY 1-list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), vec_id LIMIT 10"


def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 20, against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return R.vector_join_topk(e, q, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


NEIGHBOUR_SQL = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS c FROM e q, e WHERE q.vec_id%20=0) SELECT query_id, vec_id, round(c,6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c,12) DESC, vec_id) AS rank FROM s QUALIFY rank<=5"


def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of the neighbours (not oneself) with the query's label, per label."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    n = R.vector_join_topk(e, q, 4).where("query_id <> vec_id")
    lab = e.select("vec_id", "label")
    j = n.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    return j.groupBy("want").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("want")).cast("int")), 6).alias("accuracy")).withColumnRenamed("want", "label")


ACCURACY_SQL = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS want, e.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v),12) DESC, e.vec_id) AS rank FROM e q, e WHERE q.vec_id%20=0 QUALIFY rank<=4) SELECT want AS label, count(*) AS n, round(avg(CAST(label=want AS INT)),6) AS accuracy FROM s WHERE query_id<>vec_id GROUP BY 1"


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Index hits first, then nearest chunks by hashed vectors of their text, ten in all."""
    c = chunks_once(spark, d).where("content is not null")
    hits = R.entity_search(recorded_postings(spark, d), spark.createDataFrame(WANTED, "entity_type string, entity_key string"), 4)
    v = c.select("chunk_id", R.hash_embedding(F.col("content")).alias("v"))
    q = spark.range(1).select(R.hash_embedding(F.lit("goodwill and working capital fell on weaker pricing")).alias("v")).first()[0]
    near = R.vector_topk(v, list(q), 14, "v", "chunk_id")
    return R.hybrid_merge(hits, near, 10).select("chunk_id", "origin", F.round("distance", 6).alias("distance"))


def topics_fitted(spark: SparkSession, d: str) -> DataFrame:
    return TP.topic_terms(chunks_once(spark, d).where("content is not null").select("chunk_id", "content"), 10)


def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


EVENTS_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2"


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: events at most 30 minutes apart."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("most_events"))


SESSIONS_SQL = "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1,2) SELECT user_id, count(*) AS n_sessions, max(n) AS most_events FROM c GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (posting_index, entity_index, related_documents, entity_search, keyword_search, topic_summary, document_index, vector_topk, vector_neighbours, label_accuracy, hybrid_retrieve, topics_fitted, events_hourly, event_sessions)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"posting_index": POSTING_SQL, "entity_index": ENTITY_SQL, "related_documents": RELATED_SQL, "entity_search": SEARCH_SQL, "keyword_search": KEYWORD_SQL, "topic_summary": TOPIC_SQL, "document_index": INDEX_SQL, "vector_topk": VECTOR_SQL, "vector_neighbours": NEIGHBOUR_SQL, "label_accuracy": ACCURACY_SQL, "events_hourly": EVENTS_SQL, "event_sessions": SESSIONS_SQL}
