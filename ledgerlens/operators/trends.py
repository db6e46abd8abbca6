"""Series over time: trend tests, seasonality, anomalies, growth and forecasts, all as aggregates.

Defined results: fewer than three values give no trend, anomaly or forecast; a constant series has no
anomalies; series with equal dates have a null slope; a non-positive end gives no compound growth; null
values are left out with their period. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a regression slope with n - 2 degrees of freedom: the finite sum of Student's t for
    whole degrees; 0 for a perfect fit, null below three points."""
    v = (n - 2).cast("int")
    t = F.abs(r) * F.sqrt(F.try_divide(v.cast("double"), 1 - r * r))
    th = F.atan(F.try_divide(t, F.sqrt(v.cast("double"))))
    c2, s, c = F.cos(th) * F.cos(th), F.sin(th), F.cos(th)

    def series(first: Column, terms: Column, step) -> Column:
        acc = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
        return F.when(terms < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), terms), acc, lambda a, k: F.struct((a["t"] * c2 * step(k)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"]))

    odd = 1 - (F.lit(2.0) / F.pi()) * (th + s * series(c, ((v - 1) / 2).cast("int"), lambda k: (2 * k) / (2 * k + 1)))
    even = 1 - s * series(F.lit(1.0), (v / 2).cast("int"), lambda k: (2 * k - 1) / (2 * k))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.abs(r) >= 1 - 1e-15, F.lit(0.0)).when(v % 2 == 1, odd).otherwise(even)


def analyze_trends(metrics: DataFrame, keys: list[str], stable: float = 0.01, volatile: float = 0.25, alpha: float = 0.05) -> DataFrame:
    """One row a series (keys; columns seq, obs_date, value): mean, population deviation, range, slope per
    deviation of time, r squared, p, direction, compound growth. Null where fewer than three values."""
    m = metrics.where("value is not null")
    x = F.coalesce(F.unix_date("obs_date").cast("double"), F.col("seq").cast("double"))
    y = F.col("value")
    g = m.withColumn("__x", x).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std_dev"), F.min(y).alias("min_value"), F.max(y).alias("max_value"),
        F.regr_slope(y, F.col("__x")).alias("__b"), F.stddev_pop("__x").alias("__sx"), F.try_divide(F.covar_pop(y, F.col("__x")), F.stddev_pop(y) * F.stddev_pop("__x")).alias("__r"), F.min_by("value", "seq").alias("__first"), F.max_by("value", "seq").alias("__last"),
    ).where("n >= 3")
    r = F.when(F.col("std_dev") == 0, F.lit(0.0)).otherwise(F.col("__r"))
    out = g.withColumns({"slope": F.col("__b") * F.col("__sx"), "r_squared": r * r, "__rr": r})
    p = F.when(F.col("__b").isNull(), F.lit(None).cast("double")).otherwise(p_value(F.col("__rr"), F.col("n")))
    d = F.when(F.col("std_dev") > volatile * F.col("mean"), "volatile").when(F.abs("slope") < stable * F.col("mean"), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    cagr = F.when((F.col("__first") > 0) & (F.col("__last") > 0), F.pow(F.col("__last") / F.col("__first"), 1.0 / (F.col("n") - 1)) - 1)
    out = out.withColumns({"p_value": p, "direction": d, "cagr": cagr})
    return out.withColumn("is_significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))).select(*keys, "n", "mean", "std_dev", "min_value", "max_value", "slope", "r_squared", "p_value", "is_significant", "direction", "cagr")


def seasonality(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Quarterly factors mean(quarter) / mean - 1 of series with at least eight dated quarterly values that
    show all four quarters; other series give no rows."""
    m = metrics.where("value is not null and obs_date is not null")
    q = m.groupBy(*keys, "fiscal_quarter").agg(F.sum("value").alias("s"), F.count("*").alias("c"), F.sum((F.col("period_type") != "quarterly").cast("int")).alias("o"))
    w = Window.partitionBy(*keys)
    q = q.withColumns({"__n": F.sum("c").over(w), "__s": F.sum("s").over(w), "__o": F.sum("o").over(w), "__q": F.sum(F.col("fiscal_quarter").between(1, 4).cast("int")).over(w)})
    return q.where("__n >= 8 and __q = 4 and __o = 0").select(*keys, "fiscal_quarter", (F.try_divide(F.col("s") / F.col("c"), F.col("__s") / F.col("__n")) - 1).alias("seasonal_factor"))


def anomalies(metrics: DataFrame, keys: list[str], z: float = 2.0) -> DataFrame:
    """Values more than ``z`` population deviations off their series' mean. The statistics join back on the
    series key, so a long series is never sorted or held in one window."""
    m = metrics.where("value is not null")
    st = m.groupBy(*keys).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"), F.count("*").alias("__n")).where("__n >= 3 and __s > 0")
    return m.join(st, keys).where(F.abs(F.col("value") - F.col("__m")) / F.col("__s") > z).select(*keys, "seq", "value", ((F.col("value") - F.col("__m")) / F.col("__s")).alias("z_score"))


def growth(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Growth from each value to the next in order."""
    w = Window.partitionBy(*keys).orderBy("seq")
    m = metrics.where("value is not null").withColumn("previous", F.lag("value").over(w))
    return m.select(*keys, "seq", "value", "previous", (F.try_divide(F.col("value"), F.col("previous")) - 1).alias("growth"))


def forecast(metrics: DataFrame, keys: list[str], periods: int = 4, method: str = "linear") -> DataFrame:
    """``periods`` further values by 'linear' (least squares on position), 'growth_rate' (mean growth; the
    mean if a value isn't positive) or 'average', with the years and quarters they fall in."""
    if method not in ("linear", "growth_rate", "average"):
        raise ValueError(method)
    m = metrics.where("value is not null")
    w = Window.partitionBy(*keys).orderBy("seq")
    m = m.withColumns({"__i": (F.row_number().over(w) - 1).cast("double"), "__p": F.lag("value").over(w)})
    g = m.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.avg("value").alias("__avg"), F.regr_slope("value", "__i").alias("__b"), F.regr_intercept("value", "__i").alias("__a"), F.min("value").alias("__min"),
        F.avg(F.try_divide("value", "__p")).alias("__g"), F.max_by("value", "seq").alias("__last"), F.max_by(F.struct("period_type", "fiscal_year", "fiscal_quarter"), "seq").alias("__per"),
    ).where("__n >= 3")
    k = F.col("step")
    value = {"linear": F.col("__a") + F.col("__b") * (F.col("__n") - 1 + k), "average": F.col("__avg"), "growth_rate": F.when(F.col("__min") > 0, F.col("__last") * F.pow(F.col("__g"), k)).otherwise(F.col("__avg"))}[method]
    q0 = F.col("__per.fiscal_quarter") - 1 + k
    quarterly, annual = F.col("__per.period_type") == "quarterly", F.col("__per.period_type") == "annual"
    year = F.when(annual, F.col("__per.fiscal_year") + k).when(quarterly, F.col("__per.fiscal_year") + F.floor(q0 / 4).cast("int"))
    quarter = F.when(quarterly, F.pmod(q0, F.lit(4)) + 1)
    label = F.when(annual, F.concat(F.lit("FY"), year.cast("string"))).when(quarterly, F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" FY"), year.cast("string"))).otherwise(F.concat(F.lit("Period +"), k.cast("string"), F.lit(" (Forecast)")))
    return g.select(*keys, "__n", "__avg", "__a", "__b", "__min", "__g", "__last", "__per", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")).select(*keys, "step", value.alias("value"), year.cast("int").alias("fiscal_year"), quarter.cast("int").alias("fiscal_quarter"), label.alias("label"))
