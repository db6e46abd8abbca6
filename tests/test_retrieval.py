import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as R
from ledgerlens.operators import topics as TP


def test_related_documents(spark):
    p = spark.createDataFrame([("t", "x", "a", "1"), ("t", "x", "b", "2"), ("t", "x", "b", "3"), ("t", "y", "a", "1"), ("t", "y", "c", "4"), ("t", "x", "b", "2")], "entity_type string, entity_key string, doc_id string, chunk_id string")
    r = R.related_documents(p, spark.createDataFrame([("a",), ("zz",)], "doc_id string"), 5).orderBy("rank").collect()
    assert [(x["doc_id"], x["score"]) for x in r] == [("b", 2), ("c", 1)]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).round(3)
    m[7] = 0
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(999, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.vector_join_topk(e, q, 3, block=7).collect()}
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for k in range(0, 300, 20):
        want = np.lexsort((np.arange(300), -np.round(u @ u[k], 5)))[:3]
        assert [got[(k, r)] for r in (1, 2, 3)][0] == want[0]
    one = R.vector_topk(e, rows[0][1], 3).collect()
    assert one[0]["vec_id"] == 0 and abs(one[0]["distance"]) < 1e-6
    assert R.vector_topk(e, rows[0][1], 0).count() == 0
    assert R.vector_join_topk(e, q.limit(0), 3).count() == 0


def test_embedding_helpers(spark):
    r = spark.createDataFrame([("revenue and risk",), ("",), (None,)], "t string").select(R.hash_embedding(F.col("t"), 16).alias("v"), R.term_weight(F.col("t")).alias("w"), R.fit_width(R.hash_embedding(F.col("t"), 16), 20).alias("f")).collect()
    assert abs(sum(x * x for x in r[0]["v"]) - 1) < 1e-9 and sum(map(abs, r[1]["v"])) == 0 and r[0]["w"] == 1.5 and r[1]["w"] is None and len(r[2]["f"]) == 20
    p = spark.range(1).select(R.project(F.array(F.lit(1.0), F.lit(2.0)), [[1.0, 0.0], [0.0, 0.5]], [0.0, 0.0])).first()[0]
    assert np.allclose(p, np.tanh([1.0, 1.0]))


def test_search_and_merge(spark):
    c = spark.createDataFrame([("1", "the debt grew"), ("2", "sales fell"), ("3", "weather")], "chunk_id string, content string")
    assert [r["chunk_id"] for r in R.keyword_search(c, "liability").collect()] == []
    assert [r["chunk_id"] for r in R.keyword_search(c, "obligation").collect()] == ["1"]
    assert R.keyword_search(c, "debt", literal=True).count() == 3 and R.keyword_search(c, "").count() == 0
    v = spark.createDataFrame([("1", 0.1), ("3", 0.2)], "chunk_id string, distance double")
    m = R.hybrid_merge(c.where("chunk_id = '1'"), v, 5).collect()
    assert [(r["chunk_id"], r["origin"]) for r in m] == [("1", "index"), ("3", "vector")]
    meta = spark.createDataFrame([("1", {"a": "x"}), ("2", {"b": "y"}), ("3", None)], "id string, metadata map<string,string>")
    assert sorted(r["id"] for r in meta.where(R.metadata_pass({"a": "z"})).collect()) == ["2", "3"]
    ctx = R.context_prompt(c.withColumn("rank", F.col("chunk_id").cast("int")), limit=10).first()[0]
    assert ctx.startswith("the debt g") and "truncated" in ctx


def test_topics(spark):
    t = spark.createDataFrame([(str(k), "apple orchard fruit harvest" if k % 2 else "engine wheel motor brake") for k in range(40)], "chunk_id string, content string")
    r = TP.topic_terms(t, 4, topics=2).collect()
    assert sorted(x["n_chunks"] for x in r) == [20, 20] and any("apple" in x["terms"] for x in r)
    assert TP.topic_terms(t.limit(0)).count() == 0


def test_companies_are_in_the_whole_index(spark, small):
    import re

    import __spark_entry__ as E
    from ledgerlens.functions import vocabulary as V

    texts = {r["chunk_id"]: r["content"] for r in spark.read.parquet(f"{small}/chunks.parquet").where("content is not null").select("chunk_id", "content").collect()}
    q = E.queries()
    for name, column, kind in (("entity_index", "entity_type", "companies"), ("key_info", "kind", "potential_companies")):
        assert q[name](spark, small).where(F.col(column) == kind).count() > 0
    found = {c: len(dict.fromkeys(m[:10])) for c, t in texts.items() if (m := re.findall(V.ENTITY_PATTERNS["companies"], t, re.A))}
    assert {r["chunk_id"]: r["n"] for r in q["key_info"](spark, small).where("kind = 'potential_companies'").collect()} == found
