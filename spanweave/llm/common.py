"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found and not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/spanweave-shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 1000):
    """Arrow batches in slices of at most ``rows`` rows, so that few texts are Python objects at once (Spark itself
    bounds a batch by bytes). Empty batches go."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Bytes of input, as Spark's scans state them, for a bucket that one task holds.
BUCKET = 24 << 20


def buckets(docs: DataFrame) -> int:
    """Buckets to deal out what a table holds: the session's shuffle partitions, or more where the tables that it is read
    from are so large that a bucket would outgrow a task."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # beyond that Spark doesn't know it
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET), 1 << 20))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, null text as empty; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    """The inverse of ``pack``, whatever the size: the frame carries it."""
    return zstandard.ZstdDecompressor().decompress(data)
