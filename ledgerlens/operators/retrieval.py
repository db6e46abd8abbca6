"""Inverted index, vector search and their combination, as tables and joins.

Defined results: null entities, keys and vectors are never matched; ties go to the smaller id; an empty
query or index gives no rows; repeated postings count once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.operators import detect
from ledgerlens.session import broadcast_if_small

SMALL_SIDE = 100_000


def entity_postings(chunks: DataFrame, text: str = "content", doc: str = "doc_id", chunk: str = "chunk_id") -> DataFrame:
    """(entity_type, entity_key, doc_id, chunk_id), one row an entity and chunk, keys in lower case."""
    e = chunks.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(chunk).alias("chunk_id"), F.explode(detect.entities(F.col(text))).alias("entity_type", "es"))
    return e.select("doc_id", "chunk_id", "entity_type", F.explode("es").alias("x")).select("entity_type", F.lower("x").alias("entity_key"), "doc_id", "chunk_id").distinct()


def token_postings(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(token, doc_id) of the distinct ASCII words of each document."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0)))
    return docs.where(F.col(text).isNotNull()).select(F.explode(w).alias("token"), F.col(doc).alias("doc_id"))


def document_index(chunks: DataFrame) -> DataFrame:
    """One row a document: its chunk ids, the first chunk's metadata, its number of chunks."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.min_by("metadata", "chunk_index").alias("metadata"), F.countDistinct("chunk_id").alias("n_chunks"))


def related_documents(postings: DataFrame, of: DataFrame, most: int = 5) -> DataFrame:
    """(query_doc, doc_id, score): other documents by the number of (entity, chunk) pairs they share with the
    query documents ``of`` (doc_id), the best ``most`` of each.

    The query side is a stated set; its entities are distinct per document, and counts are summed before
    the ranking shuffle. A hot entity splits under adaptive skew handling, and no pair list is kept.
    """
    q = postings.join(of.select(F.col("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("query_doc"), "entity_type", "entity_key").distinct()
    # Chunks of a document with the same entity are summed first, so the join meets one row a document.
    per = postings.select("entity_type", "entity_key", "doc_id", "chunk_id").distinct().groupBy("entity_type", "entity_key", "doc_id").agg(F.count("*").alias("n"))
    hits = broadcast_if_small(q, SMALL_SIDE).join(per, ["entity_type", "entity_key"]).where("doc_id <> query_doc").groupBy("query_doc", "doc_id").agg(F.sum("n").alias("score"))
    w = Window.partitionBy("query_doc").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_doc", "doc_id", "score", "rank")


def entity_search(postings: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """Chunks that hold any wanted (entity_type, entity_key): chunk_id, doc_id, matches, best first."""
    w = wanted.select("entity_type", F.lower("entity_key").alias("entity_key")).distinct()
    hit = postings.join(broadcast_if_small(w, SMALL_SIDE), ["entity_type", "entity_key"], "left_semi")
    return hit.groupBy("chunk_id", "doc_id").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "chunk_id").limit(most)


def keyword_search(chunks: DataFrame, query: str, most: int = 10, literal: bool = False, text: str = "content") -> DataFrame:
    """Chunks by how many words of the query, expanded by synonyms, they contain. ``literal``: the rule that
    any known synonym in the query matches every chunk."""
    words = {w for w in query.lower().split() if w}
    rev = {s: c for c, ss in V.SYNONYMS.items() for s in ss}
    known = [w for w in sorted(words) if w in rev]
    if literal:
        return (chunks if known else chunks.limit(0)).withColumn("matches", F.lit(len(known))).orderBy("chunk_id").limit(most)
    terms = sorted(words | {s for w in known for s in [rev[w], *V.SYNONYMS[rev[w]]]})
    if not terms:
        return chunks.limit(0).withColumn("matches", F.lit(0))
    low = F.lower(F.col(text))
    n = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return chunks.withColumn("matches", n).where("matches > 0").orderBy(F.desc("matches"), "chunk_id").limit(most)


def metadata_pass(filters: dict[str, str], metadata: str = "metadata") -> Column:
    """Keeps a row when every filter key that its metadata holds is equal; absent keys pass."""
    c = F.lit(True)
    m = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    for k, v in filters.items():
        c = c & F.coalesce(m[F.lit(k)] == F.lit(v), ~F.map_contains_key(m, F.lit(k)))
    return c


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where a norm is 0, null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def vector_topk(items: DataFrame, query: list[float], k: int = 5, vec: str = "embedding", key: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest of one query vector: an exact scan that keeps k rows a task, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = (1 - cosine(F.col(vec), q)) if metric == "cosine" else l2(F.col(vec), q)
    return items.where(F.col(vec).isNotNull()).withColumn("distance", d).orderBy("distance", key).limit(max(k, 0))


def vector_join_topk(items: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", key: str = "vec_id", block: int = 256) -> DataFrame:
    """(query_id, key, similarity, rank) of the ``k`` most similar items of each query vector (query_id,
    query_vec): a stated query set in blocks against all rows.

    Items are packed into blocks where they lie; each meets each block of queries once, and k rows a query
    leave the task. Neither side passes through the driver, and what is shuffled for the ranking is bounded
    by item blocks x queries x k, never by pairs.
    """
    kt, qt = items.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    src = items.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    q = queries.where("query_id is not null and query_vec is not null").select(F.col("query_id").alias("q"), F.col("query_vec").cast("array<double>").alias("v"))
    parts = max(1, -(-q.count() // block))
    qb = q.groupBy(F.pmod(F.xxhash64("q"), F.lit(parts)).alias("b")).agg(F.collect_list("q").alias("qs"), F.collect_list("v").alias("qv"))

    def pack(batches):
        for p in batches:
            for a in range(0, len(p), block):
                x = p.iloc[a : a + block]
                yield pd.DataFrame({"ks": [list(x["k"])], "kv": [[list(v) for v in x["v"]]]})

    def unit(rows) -> np.ndarray:
        m = np.array([np.asarray(v, dtype=np.float64) for v in rows])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches):
        for p in batches:
            made = []
            for ks, kv, qs, qv in zip(p["ks"], p["kv"], p["qs"], p["qv"]):
                keys, s = np.asarray(ks), unit(qv) @ unit(kv).T
                for one, row in zip(qs, s):
                    made += [(one, keys[t], float(row[t])) for t in np.lexsort((keys, -np.round(row, 12)))[:k]]
            yield pd.DataFrame(made, columns=["query_id", key, "similarity"])

    ib = src.mapInPandas(pack, f"ks array<{kt}>, kv array<array<double>>")
    out = ib.crossJoin(broadcast_if_small(qb, 64)).select("ks", "kv", "qs", "qv").mapInPandas(run, f"query_id {qt}, {key} {kt}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_merge(index_hits: DataFrame, vector_hits: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """Index hits first (distance 0), then the nearest vector hits not among them, up to ``n`` in all."""
    a = index_hits.select(key, F.lit(0.0).alias("distance"), F.lit("index").alias("origin"))
    b = vector_hits.join(F.broadcast(index_hits.select(key).limit(n)), key, "left_anti").select(key, F.col("distance").cast("double"), F.lit("vector").alias("origin"))
    both = a.unionByName(b)
    return both.orderBy(F.when(F.col("origin") == "index", 0).otherwise(1), "distance", key).limit(max(n, 0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, though the body uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    """A vector at unit length; zeros stay."""
    return let(v, lambda a: let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)))


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic unit vector of a text's words by signed feature hashing, in Arrow batches: the
    offline stand-in for a learned encoder. Null and empty text give zeros."""
    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        import xxhash

        memo: dict[str, tuple[int, float]] = {}
        out = []
        for t in s:
            v = np.zeros(width)
            for w in re.findall(r"[^\W_]+", t.lower()) if isinstance(t, str) else []:
                if w not in memo:
                    h = xxhash.xxh64_intdigest(w.encode())
                    memo[w] = (h % width, 1.0 if (h >> 40) & 1 else -1.0)
                at, sign = memo[w]
                v[at] += sign
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).tolist())
        return pd.Series(out)

    return embed(text)


def fit_width(v: Column, width: int = 768) -> Column:
    """A vector cut or padded with zeros to ``width`` and scaled to unit length (zeros stay)."""
    return unit(F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width))


def term_weight(text: Column) -> Column:
    """Mean weight of the weighted terms a text contains; null if none."""
    low = F.lower(text)
    ws = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(w)) for t, w in V.TERM_WEIGHTS.items()]))
    return F.when(F.size(ws) > 0, F.aggregate(ws, F.lit(0.0), lambda s, x: s + x) / F.size(ws))


def apply_term_weight(text: Column, v: Column) -> Column:
    """The vector scaled by 0.7 + 0.3 times the text's term weight; unchanged without terms."""
    return let(term_weight(text), lambda w: F.when(w.isNotNull(), F.transform(v, lambda x: x * (0.7 + 0.3 * w))).otherwise(v))


def project(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """tanh(W v + b), the projection layer as expressions over literal weights."""
    return F.array(*[F.tanh(dot(v, F.array(*[F.lit(float(x)) for x in row])) + F.lit(float(b))) for row, b in zip(weights, bias)])


def context_prompt(hits: DataFrame, text: str = "content", order: str = "rank", limit: int = 15_000) -> DataFrame:
    """One row: contexts joined by blank lines in rank order, cut at ``limit`` characters with a notice."""
    joined = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]))
    return hits.agg(joined.alias("c")).select(F.when(F.length("c") > limit, F.concat(F.substring("c", 1, limit), F.lit("\n\n[Context truncated]"))).otherwise(F.col("c")).alias("context"))


def search(chunks: DataFrame, postings: DataFrame, query: str, filters: dict[str, str] | None = None, most: int = 10) -> DataFrame:
    """chunk_id, matches of a question in one plan: chunks that hold its entities, or, if none does, its keywords;
    then the metadata filters, then the first ``most``. An empty question has no hits."""
    spark = chunks.sparkSession
    if not query or not query.strip():
        return chunks.limit(0).select("chunk_id", F.lit(0).cast("bigint").alias("matches"))
    asked = spark.range(1).select(F.explode(detect.entities(F.lit(query))).alias("entity_type", "es")).select("entity_type", F.explode("es").alias("entity_key"))
    w = asked.select("entity_type", F.lower("entity_key").alias("entity_key")).distinct()
    hits = postings.join(broadcast_if_small(w, SMALL_SIDE), ["entity_type", "entity_key"], "left_semi").groupBy("chunk_id").agg(F.count("*").alias("matches"))
    low = F.lower(F.col("content"))
    rev = {s: c for c, ss in V.SYNONYMS.items() for s in ss}
    words = {x for x in query.lower().split() if x}
    terms = sorted(words | {s for x in words if x in rev for s in [rev[x], *V.SYNONYMS[rev[x]]]})
    n = sum((F.contains(low, F.lit(t)).cast("bigint") for t in terms), F.lit(0).cast("bigint"))
    # The keyword branch yields rows only where the entity branch has none: its count is one row.
    none = hits.agg(F.count("*").alias("n_hits")).where("n_hits = 0")
    kw = chunks.where(F.col("content").isNotNull()).select("chunk_id", n.alias("matches")).where("matches > 0").join(F.broadcast(none)).select("chunk_id", "matches")
    found = hits.unionByName(kw)
    kept = found.join(chunks.where(metadata_pass(filters or {})).select("chunk_id").distinct(), "chunk_id", "left_semi")
    return kept.orderBy(F.desc("matches"), "chunk_id").limit(max(most, 0))


def pair_similarity(pairs: DataFrame, a: str = "a", b: str = "b", strong: float = 0.6) -> DataFrame:
    """``pairs`` of vectors with similarity and whether it is strong; null vectors give null and are not strong."""
    s = cosine(F.col(a), F.col(b))
    return pairs.withColumn("similarity", s).withColumn("strong", F.coalesce(F.col("similarity") > strong, F.lit(False)))


def _scaled_part(v: Column, part: int, size: Column, scale: Column) -> Column:
    return F.transform(v, lambda x, i: F.when((i >= part * size) & (i < (part + 1) * size), x * scale).otherwise(x))


def weight_regions(text: Column, v: Column, weights: dict[str, float], regions: int = 10) -> Column:
    """The vector with one of ``regions`` equal parts per entity type scaled by how much of the text its terms
    cover: 1 + (weight - 1) * min(10 * coverage, 1), then at unit length. Types take the parts in their order."""
    low, out = F.lower(text), v
    for k, (tag, w) in enumerate(weights.items()):
        held = sum((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit(""))) for t in V.FINANCIAL_TERMS.get(tag, [])), F.lit(0))
        scale = 1 + (w - 1) * F.least(10 * F.coalesce(F.try_divide(held, F.length(low)), F.lit(0.0)), F.lit(1.0))
        size = F.floor(F.size(v) / regions)
        out = _scaled_part(out, k % regions, size, scale)
    return unit(out)
