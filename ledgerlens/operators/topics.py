"""Topics of a collection: TF-IDF of up to 5,000 terms, 50 dimensions by SVD, k-means; fitted once a collection.

The SVD is a randomised one: a few passes sum X'XQ over all texts, a matrix of terms by dimensions however many
texts there are. Texts are assigned in one Arrow stage; the fitted model is two small tables.

Defined results: empty and null texts carry no topic; a text without a term of the model gets the topic whose
centre is nearest to zero; fewer texts than topics give fewer topics; an empty input gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, spread

TERMS, DIMENSIONS, TOPICS, SEED = 5000, 50, 10, 42
#: Directions beyond DIMENSIONS, and passes, that make the randomised SVD accurate.
EXTRA, PASSES = 10, 4
_WORD = re.compile(r"[^\W\d_]{3,}")


class TopicModel(NamedTuple):
    """terms with their idf, the terms' directions (terms x dimensions), the centres (topics x dimensions)."""

    terms: list[str]
    idf: np.ndarray
    directions: np.ndarray
    centres: np.ndarray

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        t = [(k, w, float(i), [float(x) for x in d]) for k, (w, i, d) in enumerate(zip(self.terms, self.idf, self.directions))]
        c = [(k, [float(x) for x in v]) for k, v in enumerate(self.centres)]
        return spark.createDataFrame(t, "term_no int, term string, idf double, direction array<double>"), spark.createDataFrame(c, "topic_id int, centre array<double>")

    @staticmethod
    def from_tables(terms: DataFrame, centres: DataFrame) -> TopicModel:
        t = sorted(bounded_rows(terms, TERMS, "terms of the topics"), key=lambda r: r["term_no"])
        c = sorted(bounded_rows(centres, TERMS, "topics"), key=lambda r: r["topic_id"])
        return TopicModel([r["term"] for r in t], np.array([r["idf"] for r in t]), np.array([r["direction"] for r in t]), np.array([r["centre"] for r in c]))


def _rows(texts: pd.Series, at: dict[str, int], idf: np.ndarray, stop: frozenset[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, unit TF-IDF weights) of each text."""
    out = []
    for t in texts:
        n = Counter(w for w in _WORD.findall(t.lower()) if w in at and w not in stop) if isinstance(t, str) else {}
        i = np.fromiter((at[w] for w in n), np.int64, len(n))
        x = np.fromiter(n.values(), float, len(n)) * idf[i]
        length = np.linalg.norm(x)
        out.append((i, x / length if length else x))
    return out


def fit_topics(chunks: DataFrame, text: str = "content", topics: int = TOPICS, dimensions: int = DIMENSIONS) -> TopicModel:
    """The model of all non-null texts: no sample, no cap on texts."""
    spark = chunks.sparkSession
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    src = chunks.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).persist()
    try:
        words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}{3,}"), F.lit(0)))
        df = src.select(F.explode(words).alias("w")).where(~F.col("w").isin(list(stop))).groupBy("w").agg(F.count("*").alias("df")).where("df >= 2")
        kept = df.orderBy(F.desc("df"), "w").limit(TERMS).collect()
        terms = [r["w"] for r in kept]
        n = src.count()
        idf = np.log((n + 1) / (np.array([r["df"] for r in kept], float) + 1))
        at = {w: k for k, w in enumerate(terms)}
        width = min(dimensions, len(terms))
        rng = np.random.default_rng(SEED)
        q = np.linalg.qr(rng.normal(size=(len(terms), min(width + EXTRA, len(terms)))))[0] if terms else np.zeros((0, 0))
        values = np.zeros(0)
        for _ in range(PASSES if terms else 0):
            z = _gram(src, at, idf, stop, q)
            values, turn = np.linalg.eigh(q.T @ z)
            basis = q @ turn[:, ::-1]
            q = np.linalg.qr(z)[0]
        directions = basis[:, :width] if terms else np.zeros((0, 0))
        # A sign that does not depend on the solver: the largest entry of each direction is positive.
        if directions.size:
            directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
        if not directions.size:
            return TopicModel(terms, idf, directions, np.zeros((1, 0)))
        low = _project(src, TopicModel(terms, idf, directions, np.zeros((1, width))), "t", stop)
        points = low.select(array_to_vector("v").alias("features")).persist()
        model = KMeans(k=topics, seed=SEED, maxIter=20).fit(points)
        points.unpersist()
        return TopicModel(terms, idf, directions, np.array(model.clusterCenters()))
    finally:
        src.unpersist()


def _gram(src: DataFrame, at: dict[str, int], idf: np.ndarray, stop: frozenset[str], q: np.ndarray) -> np.ndarray:
    """X'XQ over all texts: each task sums its own, and the sums of each term meet in an aggregate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.zeros_like(q)
        for p in batches:
            for i, x in _rows(p["t"], at, idf, stop):
                z[i] += np.outer(x, x @ q[i])
        yield pd.DataFrame({"k": np.arange(len(z)), "z": list(z)})

    width = q.shape[1]
    sums = spread(src).mapInPandas(run, "k int, z array<double>").groupBy("k").agg(F.array(*[F.sum(F.get("z", j)) for j in range(width)]).alias("z"))
    out = np.zeros_like(q)
    for r in bounded_rows(sums, TERMS, "terms of the topics"):
        out[r["k"]] = r["z"]
    return out


def _project(texts: DataFrame, model: TopicModel, text: str, stop: frozenset[str], nearest: bool = False) -> DataFrame:
    keep = [c for c in texts.columns if c not in ("topic_id", "v")]
    at = {w: k for k, w in enumerate(model.terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            v = np.array([x @ model.directions[i] for i, x in _rows(p[text], at, model.idf, stop)]).reshape(len(p), -1)
            p = p[keep].copy()
            if nearest:
                p["topic_id"] = ((v[:, None, :] - model.centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1).astype("int32")
            else:
                p["v"] = list(v)
            yield p

    own = texts.select(*keep)
    return own.mapInPandas(run, own.schema.simpleString()[7:-1] + (",topic_id:int" if nearest else ",v:array<double>"))


def chunk_topics(model: TopicModel, chunks: DataFrame, text: str = "content") -> DataFrame:
    stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    return _project(chunks.where(F.col(text).isNotNull()), model, text, stop, nearest=True)


def topic_terms(chunks: DataFrame, most: int = 10, text: str = "content", topics: int = TOPICS) -> DataFrame:
    """(topic_id, terms, n_chunks): the ``most`` weightiest terms of each centre, mapped back to terms."""
    spark = chunks.sparkSession
    schema = "topic_id int, terms string, n_chunks bigint"
    if chunks.where(F.length(F.trim(F.col(text))) > 0).limit(2).count() < 2:
        return spark.createDataFrame([], schema)
    m = fit_topics(chunks, text, topics)
    back = m.centres @ m.directions.T
    rows = [(k, ", ".join(m.terms[i] for i in sorted(range(len(c)), key=lambda i: (-round(c[i], 9), m.terms[i]))[:most])) for k, c in enumerate(back)]
    n = chunk_topics(m, chunks, text).groupBy("topic_id").agg(F.count("*").alias("n_chunks"))
    return spark.createDataFrame(rows, "topic_id int, terms string").join(n, "topic_id", "left").select("topic_id", "terms", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def topic_documents(assigned: DataFrame) -> DataFrame:
    """Documents of each topic with the number of their chunks in it."""
    g = assigned.groupBy("topic_id", "doc_id").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("topic_id")))
