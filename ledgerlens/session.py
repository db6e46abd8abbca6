"""Session defaults, checkpoints in shared storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that help every plan; a value the cluster has set itself is kept.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``master`` only for local use."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent, one machine alone (a local master, as in tests) uses a temporary folder; a
    cluster raises, for a folder of one machine is no use to the others.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerlens-"))
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that must be small (a catalog, a model, a stated query set).

    At most ``most`` + 1 rows travel; more than ``most`` raises, nothing is cut.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; use the join form instead")
    return rows


def broadcast_if_small(df: DataFrame, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only if at most ``most`` rows of together at most ``most_bytes`` (as JSON) are counted;
    else the plain side of a shuffled join."""
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= most and size["b"] <= most_bytes else df


_KEPT: dict[str, object] = {}


def kept(token: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, once a Python worker and token (one model of one query), so that later tasks of the
    worker find its tables and caches; the last two are kept."""
    if token not in _KEPT:
        while len(_KEPT) > 1:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[token] = make()
    return _KEPT[token]


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition a small input before a Python stage, so few or small files still use every core.

    An input that Catalyst sizes at a scan partition or more for every core already has enough partitions:
    it is left as it lies, so a large corpus is never shuffled for this. With no columns rows go round
    robin, so no key can make one partition heavy.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not cols and _bytes(df) >= n * _bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")):
        return df
    return df.repartition(n, *cols) if cols else df.repartition(n)


def _bytes(df: DataFrame) -> int:
    """Catalyst's size of a plan's output; 0 where the session gives no access to it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return 0


def _bytes_of(text: str) -> int:
    """Bytes of a setting such as 134217728b, 128m or 1g."""
    t = text.strip().lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(t[-1:], 1)
    return int(t.rstrip("kmgt") or 0) * scale
