"""Detection and extraction from text as column expressions: labels, counts, matches.

Defined results: null text gives null labels or empty arrays where noted; ties go to the entry declared
first. Case-insensitive patterns use Unicode case folding where letters may be accented.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V


def _lit(p: str) -> Column:
    return F.lit(p)


def first_best(scores: dict[str, Column], default: str) -> Column:
    """The name with the highest score, the first declared on ties; ``default`` if all are zero."""
    rows = F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-k).alias("o"), F.lit(n).alias("n")) for k, (n, s) in enumerate(scores.items())])
    top = F.array_max(rows)
    return F.when(top["s"] > 0, top["n"]).otherwise(F.lit(default))


def document_category(text: Column) -> Column:
    """Category whose indicator phrases occur most as whole words, else general_financial."""
    scores = {}
    for cat, words in V.CATEGORY_INDICATORS.items():
        # A plain search first: the pattern runs only on texts that hold the phrase.
        scores[cat] = reduce(lambda a, b: a + b, [F.when(F.contains(F.lower(text), F.lit(w.lower())), F.regexp_count(text, _lit(r"(?iu)\b" + re.escape(w).replace(r"\ ", " ") + r"\b"))).otherwise(0) for w in words])
    return first_best(scores, "general_financial")


def statement_keywords(text: Column) -> tuple[Column, Column]:
    """(type, confidence): most distinct keywords contained, ties to the first type; confidence is the share
    of the type's keywords."""
    low = F.lower(text)
    counts = {t: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in ws]) for t, ws in V.STATEMENT_KEYWORDS.items()}
    kind = first_best(counts, "unknown")
    conf = F.lit(0.0)
    for t, ws in V.STATEMENT_KEYWORDS.items():
        conf = F.when(kind == t, counts[t] / F.lit(float(len(ws)))).otherwise(conf)
    return kind, conf


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike("(?i)" + p) for p in patterns])


def route_tasks(queries: DataFrame, query: str = "query", override: str | None = None) -> DataFrame:
    """``queries`` with task, share (of the chosen task) and provider of each question.

    A question without a context word is non_financial; one without any task match general_financial;
    complex questions may be turned to a complex task with at least half the best share. The shares are one
    array column, so no expression grows with the number of tasks.
    """
    q = F.col(query)
    names = list(V.TASK_PATTERNS)
    counts = F.array(*[reduce(lambda a, b: a + b, [F.regexp_count(q, _lit("(?i)" + p)) for p in ps]) for ps in V.TASK_PATTERNS.values()])
    hits = reduce(lambda a, b: a + b, [q.rlike("(?i)" + p).cast("int") for p in V.COMPLEX_PATTERNS])
    d = queries.withColumns({"__c": counts, "__hits": hits, "__context": any_match(q, V.CONTEXT_PATTERNS)})
    d = d.withColumn("__total", F.aggregate("__c", F.lit(0), lambda s, x: s + x))
    d = d.withColumn("__s", F.transform("__c", lambda x: F.coalesce(F.try_divide(x, F.col("__total")), F.lit(0.0))))
    d = d.withColumn("__top", F.array_max("__s"))
    order = F.array(*[F.lit(names.index(t) + 1) for t in V.COMPLEX_TASKS])
    complex_k = F.when(F.col("__hits") >= 2, F.try_element_at(F.filter(order, lambda k: (F.element_at("__s", k) > 0) & (F.element_at("__s", k) >= 0.5 * F.col("__top"))), F.lit(1)))
    d = d.withColumn("__k", F.coalesce(complex_k, F.array_position("__s", F.col("__top")).cast("int")))
    plain = ~F.col("__context") | (F.col("__total") == 0)
    d = d.withColumns({"task": F.when(~F.col("__context"), "non_financial").when(F.col("__total") == 0, "general_financial").otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__k"))), "share": F.when(plain, F.lit(1.0)).otherwise(F.element_at("__s", F.col("__k")))})
    kinds = F.create_map(*[F.lit(x) for t, p in V.TASK_PROVIDER.items() for x in (t, p)])
    d = d.withColumn("__p", kinds[F.col("task")])
    rival = F.exists(F.arrays_zip(F.col("__s").alias("s"), F.array(*[F.lit(V.TASK_PROVIDER[n]) for n in names]).alias("p")), lambda x: (x["s"] >= 0.25) & (x["p"] != F.col("__p")))
    d = d.withColumn("provider", F.lit(override) if override else F.when(~plain & ((F.col("share") < 0.4) | rival), "hybrid").otherwise(F.col("__p")))
    return d.drop("__c", "__hits", "__context", "__total", "__s", "__top", "__k", "__p")


def statement_title_type(text: Column) -> Column:
    """First statement pattern found, in order of precedence, else unknown."""
    out = F.lit("unknown")
    for t, p in reversed(V.STATEMENT_PATTERNS.items()):
        out = F.when(text.rlike(p), F.lit(t)).otherwise(out)
    return out


def financial_period(text: Column) -> Column:
    """The first period phrase, by order of the patterns; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in V.PERIOD_PATTERNS])


def has_table(text: Column) -> Column:
    """The literal rule: three digits in a row or spread over separators count as a table."""
    return text.rlike(V.TABLE_PATTERN)


def looks_tabular(text: Column) -> Column:
    """The stricter rule: two lines with at least two numeric cells set apart by blanks or bars."""
    return F.regexp_count(text, F.lit(r"(?m)^.*\S(?:\s{2,}|\s*\|\s*)[($€£-]*\d[\d.,]*\)?(?:\s{2,}|\s*\|\s*)[($€£-]*\d[\d.,]*\)?.*$")) >= 2


def chunk_terms(text: Column) -> Column:
    """Which of the chunk terms occur as whole words, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t)) & text.rlike(rf"(?i)\b{re.escape(t).replace(chr(92) + ' ', ' ')}\b"), F.lit(t)) for t in V.CHUNK_TERMS]))


def entities(text: Column, literal_percent: bool = False) -> Column:
    """Map of entity type to the distinct matches of its pattern; types without a match are left out."""
    pats = dict(V.ENTITY_PATTERNS)
    if literal_percent:
        pats["percentages"] = V.LITERAL_PERCENT
    pairs = [(F.lit(t), F.array_distinct(F.regexp_extract_all(text, _lit(p), F.lit(0)))) for t, p in pats.items()]
    return F.map_filter(F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: F.size(v) > 0)


def key_info(text: Column) -> Column:
    """Companies, amounts, dates and percentages: the first ten matches, then distinct; empty ones left out."""
    names = {"companies": "potential_companies", "monetary_values": "monetary_values", "dates": "dates", "percentages": "percentages"}
    pairs = [(F.lit(n), F.array_distinct(F.slice(F.regexp_extract_all(text, _lit(V.ENTITY_PATTERNS[k]), F.lit(0)), 1, 10))) for k, n in names.items()]
    return F.map_filter(F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: F.size(v) > 0)


def metrics(text: Column) -> Column:
    """Map of metric to the first amount named after it."""
    pairs = [(F.lit(k), F.regexp_extract(text, p, 1)) for k, p in V.METRIC_PATTERNS.items()]
    return F.map_filter(F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v != "")


def query_entities(query: Column) -> Column:
    pairs = [(F.lit(k), F.regexp_extract_all(query, _lit(p), F.lit(0))) for k, p in V.QUERY_ENTITY_PATTERNS.items()]
    return F.map_filter(F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: F.size(v) > 0)


def periods(text: Column) -> Column:
    """Array of (period_type, fiscal_year, fiscal_quarter, end_date): years 1900 to 2100, then quarters,
    then 'n months ended <date>' typed by the phrases anywhere in the text."""
    kind = "struct<period_type:string,fiscal_year:int,fiscal_quarter:int,end_date:date>"
    none = F.lit(None)

    def row(t, y, q, e) -> Column:
        return F.struct(t.alias("period_type"), y.cast("int").alias("fiscal_year"), q.cast("int").alias("fiscal_quarter"), e.cast("date").alias("end_date")).cast(kind)

    ys = F.filter(F.transform(F.regexp_extract_all(text, F.lit(V.PERIOD_YEAR), F.lit(1)), lambda x: x.cast("int")), lambda y: y.between(1900, 2100))
    years = F.transform(ys, lambda y: row(F.lit("annual"), y, none, none))
    qp = V.PERIOD_QUARTER
    qs = F.arrays_zip(F.regexp_extract_all(text, F.lit(qp), F.lit(1)).alias("q"), F.regexp_extract_all(text, F.lit(qp), F.lit(2)).alias("y"))
    quarters = F.transform(F.filter(qs, lambda x: x["q"].cast("int").between(1, 4) & x["y"].cast("int").between(1900, 2100)), lambda x: row(F.lit("quarterly"), x["y"], x["q"], none))
    mp = V.PERIOD_MONTHS
    typ = F.when(text.rlike("three months|3 months"), "quarterly").when(text.rlike("six months|6 months"), "semi_annual").when(text.rlike("twelve months|12 months"), "annual").otherwise("custom")
    ends = F.filter(F.transform(F.regexp_extract_all(text, F.lit(mp), F.lit(1)), lambda x: F.try_to_timestamp(x, F.lit("MMMM d, yyyy")).cast("date")), lambda d: d.isNotNull())
    return F.concat(years, quarters, F.transform(ends, lambda d: row(typ, none, none, d)))


def company_info(text: Column) -> Column:
    """struct(name, ticker): a name with a legal suffix, overridden by a name with an exchange ticker."""
    suffix, listed = V.COMPANY_SUFFIX, V.COMPANY_LISTED
    t = F.nullif(F.regexp_extract(text, listed, 2), F.lit(""))
    n = F.when(t.isNotNull(), F.trim(F.regexp_extract(text, listed, 1))).otherwise(F.nullif(F.trim(F.regexp_extract(text, suffix, 1)), F.lit("")))
    return F.struct(F.coalesce(n, F.lit("Unknown Company")).alias("name"), t.alias("ticker"))


def expand_query(query: Column) -> Column:
    """The query with all synonyms of the canonical term of each token that is a synonym."""
    rev: dict[str, str] = {}
    for canon, syns in V.SYNONYMS.items():
        rev.update({s.lower(): canon for s in syns})
    more = F.create_map(*[F.lit(x) for s, c in rev.items() for x in (s, " ".join(V.SYNONYMS[c]))])
    extra = F.array_compact(F.transform(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: more[t]))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.concat_ws(" ", extra))).otherwise(query)


def document_metadata(text: Column) -> Column:
    """Map of what is found in a text: its category, key information and metrics, each as an array; of equal keys
    the later one wins."""
    return F.map_concat(F.create_map(F.lit("doc_category"), F.array(document_category(text))), key_info(text), F.transform_values(metrics(text), lambda k, v: F.array(v)))


def entity_spans(text: Column) -> Column:
    """Array of (entity_type, start, end, text) of dictionary terms wherever they stand, whole words or not, in
    order of type, term and place; null text gives null."""
    kind = "struct<entity_type:string,start:int,end:int,text:string>"
    low = F.lower(text)

    def found(tag: str, term: str) -> Column:
        cut, n = F.split(low, re.escape(term.lower())), len(term)

        # What lies before the k-th find: the first k pieces and the finds between them.
        def place(k: Column) -> Column:
            return F.length(F.array_join(F.slice(cut, 1, k), "")) + (k - 1) * n

        def span(k: Column) -> Column:
            s = place(k)
            return F.struct(F.lit(tag).alias("entity_type"), s.cast("int").alias("start"), (s + n).cast("int").alias("end"), F.substring(text, s + 1, F.lit(n)).alias("text")).cast(kind)

        return F.when(F.contains(low, F.lit(term.lower())), F.transform(F.sequence(F.lit(1), F.size(cut) - 1), span)).otherwise(F.array().cast(f"array<{kind}>"))

    return F.when(text.isNotNull(), F.flatten(F.array(*[found(tag, t) for tag, ts in V.FINANCIAL_TERMS.items() for t in ts])))
