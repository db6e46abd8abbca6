"""Records of several sources combined to target shares of the total size in tokens.

Capped water-filling: a source that cannot reach its share within its repeats is clamped there and its
excess goes to the others in proportion, until nothing is clamped anew. Each source then gives every
record a whole number of repeats, and a seeded part of its records one more.

Defined results: null, blank and unknown sources are in no target and are left out; a target without
records reaches share 0; null and empty texts have 0 tokens and are never chosen; repeated target rows
count once; empty inputs give empty records. Shares that don't sum to one are scaled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import bounded_rows, broadcast_if_small, shared_checkpoint, spread

# Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1 << 14
MOST_SOURCES = 100_000
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 200_000


def source_key(c: Column) -> Column:
    """One spelling of a source label: case, blanks and hyphens don't matter."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(c)), r"[\s\-_]+", "_"), F.lit(""))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` of the tokenizer at ``path`` (a rank file of the driver, sent to every executor).

    Long texts are encoded in parts that end where a match of the pre-tokenisation pattern ends; no token spans
    two matches, so the count is that of the whole text at any length.
    """
    schema = docs.schema.simpleString()[7:-1] + ",n_tokens:bigint"
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        piece = regex.compile(PATTERN)

        def size(t: object) -> int:
            if not isinstance(t, str):
                return 0
            if len(t) <= PART_CHARS:
                return len(enc.encode_ordinary(t))
            n = at = 0
            for m in piece.finditer(t):
                # A part that ended with a blank would read its last blanks otherwise than the whole text does.
                if m.end() - at >= PART_CHARS and not t[m.end() - 1].isspace():
                    n += len(enc.encode_ordinary(t[at : m.end()]))
                    at = m.end()
            return n + len(enc.encode_ordinary(t[at:]))

        for p in batches:
            p["n_tokens"] = [size(t) for t in p[text]]
            yield p

    return docs.mapInPandas(run, schema)


def water_fill(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens each source gives to a mixture of ``total`` tokens: shares clamped at size x repeats, the
    excess redistributed in proportion to the targets of those not clamped."""
    cap = {s: float(sizes.get(s, 0)) * max(0, r) for s, (_, r) in targets.items()}
    give = dict.fromkeys(targets, 0.0)
    free = {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}
    left = min(total, sum(cap[s] for s in free))
    while free and left > 1e-9:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if left * targets[s][0] / weight >= cap[s] - 1e-9}
        if not over:
            for s in free:
                give[s] = left * targets[s][0] / weight
            break
        for s in over:
            give[s] = cap[s]
            left -= cap[s]
        free -= over
    return give


def plan_mixture(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row a target source: size, tokens wanted and given, repeats. Only per-source sums travel."""
    spark = sized.sparkSession
    t = targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").alias("w"), F.col("max_repeats").alias("r")).where("s is not null").groupBy("s").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    want = {x["s"]: (max(0.0, x["w"] or 0.0), x["r"] or 0) for x in bounded_rows(t, MOST_SOURCES, "mixture targets")}
    norm = sum(w for w, _ in want.values()) or 1.0
    want = {s: (w / norm, r) for s, (w, r) in want.items()}
    sums = sized.join(broadcast_if_small(t.select(F.col("s").alias("source_key")), MOST_SOURCES), "source_key", "left_semi").groupBy("source_key").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    have = {x["source_key"]: (int(x["n"] or 0), x["k"]) for x in bounded_rows(sums, MOST_SOURCES, "sources")}
    sizes = {s: n for s, (n, _) in have.items()}
    total = float(total if total is not None else sum(sizes.values()))
    give = water_fill(sizes, want, total)
    rows = [(s, w, r, have.get(s, (0, 0))[1], sizes.get(s, 0), w * total, give[s], give[s] / sizes[s] if sizes.get(s) else 0.0) for s, (w, r) in sorted(want.items())]
    return spark.createDataFrame(rows, "source_key string, target_share double, max_repeats int, n_records bigint, n_tokens_available bigint, tokens_wanted double, tokens_given double, repeats double")


def mix_records(docs: DataFrame, targets: DataFrame, path: str, doc_id: str = "doc_id", total: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(chosen records with n_tokens and repeats, report of the shares really reached).

    A source's extra part is cut in seeded hash order: sums over BUCKETS hash ranges find the range of the
    cut, and only records of that one range are ordered, so no source is sorted as a whole.
    """
    sized = count_tokens(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col("source"), F.col("text"))).withColumn("source_key", source_key(F.col("source"))), path).drop("text").where("n_tokens > 0 and source_key is not null")
    sized = shared_checkpoint(sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")).withColumn("ord", F.xxhash64(F.lit(seed + 1), "doc_id")))
    plan = plan_mixture(sized, targets, total)
    p = plan.select("source_key", F.floor("repeats").cast("int").alias("whole"), ((F.col("repeats") - F.floor("repeats")) * F.col("n_tokens_available")).alias("extra"))
    own = sized.join(broadcast_if_small(p, MOST_SOURCES), "source_key")
    per = own.groupBy("source_key", "bucket").agg(F.sum("n_tokens").alias("bt"), F.first("extra").alias("bx"))
    w = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("bt").over(w), F.lit(0))).select("source_key", "bucket", "before", (F.col("before") + F.col("bt") <= F.col("bx")).alias("within"), ((F.col("before") < F.col("bx")) & (F.col("before") + F.col("bt") > F.col("bx"))).alias("cut"))
    own = own.join(before, ["source_key", "bucket"])
    edge = own.where("cut").withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source_key", "bucket").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("more", (F.col("upto") <= F.col("extra")).cast("int")).drop("upto")
    rest = own.where("not cut").withColumn("more", F.col("within").cast("int"))
    chosen = rest.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("more")).where("repeats > 0").select("doc_id", "source_key", "n_tokens", "repeats")
    used = chosen.groupBy("source_key").agg(F.count("*").alias("records_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    every = Window.partitionBy(F.lit(1))  # over the report's rows, one a target
    report = plan.join(used, "source_key", "left").withColumn("all_tokens", F.sum("tokens_used").over(every)).select("source_key", "target_share", "max_repeats", "n_records", "n_tokens_available", F.coalesce("records_used", F.lit(0)).alias("records_used"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
    return chosen, report
