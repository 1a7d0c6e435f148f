"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Applied only where the session leaves them at their default.
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_roots: dict[str, str] = {}
_owners: list[list[str]] = []


def build_session(
    app_name: str = "larder", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with adaptive execution, a UTC clock and Arrow transfer."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in _SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def configure(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution and skew splitting unless the user chose otherwise."""
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _SQL_DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            root = tempfile.mkdtemp(prefix="larder-")
        context.setCheckpointDir(root)
        _roots[app] = root
    return _roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark)}/larder/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several passes follow: the written table outlives lost
    executors, is read with column pruning and carries a known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _owners:
        _owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_into(paths: list[str]) -> Iterator[None]:
    """Tables that are stored inside the block are noted in ``paths``, for ``remove_stored``."""
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.pop()


def remove_stored(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def use_all_cores(df: DataFrame, key: str, rows_per_task: int, most: int | None = None) -> DataFrame:
    """Shuffle a scan by ``key`` if its few files would leave cores idle.

    For heavy row work over few files. A scan with a partition per core passes
    as it is, unread, so large inputs are never counted or shuffled here. With
    ``most``, for stored tables, tasks get at most about so many rows.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= cores and most is None:
        return df
    rows = df.count()
    tasks = max(min(cores, -(-rows // rows_per_task)), -(-rows // most) if most else 0)
    return df.repartition(tasks, key) if tasks > parts else df


MAX_SMALL_ROWS = 20_000


def small_table(df: DataFrame) -> DataFrame:
    """A summary table as a broadcast literal relation if it is small, else stored.

    For tables with one row per group, cut point or parameter. The size is
    checked first, so nothing that grows with the panel is broadcast.
    """
    rows = df.limit(MAX_SMALL_ROWS + 1).toArrow()
    if rows.num_rows > MAX_SMALL_ROWS:
        return materialise(df, "summary")
    return F.broadcast(df.sparkSession.createDataFrame(rows))
