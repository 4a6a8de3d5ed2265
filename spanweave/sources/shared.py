"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session, which has one machine, may leave it unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found and not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/spanweave-shared"


def settle(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and read it back, by the given session or its own.

    What follows starts from a table: short plans, no work done twice, nothing lost with an executor. A table that was
    settled is returned as it is. ``sweep`` removes these tables.
    """
    if getattr(df, "_settled", False):
        return df
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = (spark or df.sparkSession).read.schema(df.schema).parquet(path)
    out._settled = True
    return out


def dealt(df: DataFrame) -> DataFrame:
    """Rows of files dealt out to all cores where the files are fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt by a column, before slow work on each: a fixed number of partitions is kept however few bytes they hold."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new table's place under the shared folder."""
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


#: Tables that were settled since the innermost ``settled_within`` began.
_OWN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("own", default=None)


@contextlib.contextmanager
def settled_within(spark: SparkSession):
    """Remove at the end what is settled inside: for work that leaves nothing lazy, such as a stream's batch."""
    token = _OWN.set([])
    try:
        yield
    finally:
        for p in _OWN.get():
            _remove(spark, p)
        _OWN.reset(token)


def _remove(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> bool:
    """Remove every settled table of the shared folder; call it when no result that reads one is still wanted."""
    return _remove(spark, f"{shared_dir(spark)}/spanweave")
