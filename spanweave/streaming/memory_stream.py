"""Documents that arrive as files while the memory grows, which is keyed state: a batch touches what its texts name.

One stateful operator holds two kinds of keys: ids that were rewritten, and heads, the first code points of an alias, with
the aliases that begin so. A batch's documents ask for their ids and for the heads in their texts. What they get back, the
aliases that may stand in them, is the memory that the batch runs on; Spark's state store reads and writes those keys
alone. New entities are appended to a log, and the log is the operator's second source: what a batch has learnt is state
before the next batch asks. A filter of fixed size has a bit for each head that the memory holds, so texts don't ask for heads
that nothing begins with: each key that is asked for is a call of Python.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import memory
from ..plans import pipeline
from ..sources import files
from ..sources.shared import settle, settled_within

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER, _SHUFFLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: What goes into the state and what comes out: a document's text, or an alias as JSON (null: a head that is asked for).
_IN, _OUT = "key string, kind string, value string", "kind string, id string, value string"
ENTITIES = "key string, canonical_id string, type string, canonical_text string, aliases array<string>, pseudonym string"
COUNTERS = "type string, base long, next long"
#: Code points of a head: five, or three, two, one where an alias is as short.
_SIZES = (5, 3, 2, 1)
#: Heads that a task gathers before it hands them on.
_HEADS = 500_000
#: Bits of the filter, half a megabyte. A head whose bit another has set is asked for in vain.
_BITS = 1 << 22


def start(spark: SparkSession, source: DataFrame, root: str, keep: int = 3, partitions: int | None = None) -> StreamingQuery:
    """Rewrite arriving documents (doc_id, text) under ``root``: redacted/batch=N, entities/batch=N, edges/batch=N.

    Of rows that share a doc_id in a batch the one of the smallest text counts, whatever the order they come in; an id
    that an earlier batch has rewritten is passed over (null is one id). A batch that is run again after a failure starts
    from the same state and counters, and overwrites its own output. ``entities`` holds those that a batch was the first
    to name, ``edges`` (key, doc_id) whatever it named; ``counters`` has the next numbers of each type, of which the last
    ``keep`` stay. Nothing else is rewritten but the filter of heads (``heads``), whose size is fixed: a batch's reads and
    writes follow its own texts, not the memory. Only batches write to ``entities`` once the query has been started.

    The query runs on until it is stopped; ``drain`` lets it finish what has arrived. It keeps its state in RocksDB, in
    ``partitions`` stores (two for a core, at most spark.sql.shuffle.partitions), whose number stays with ``root``.
    """
    fs = _Folders(spark)
    log = f"{root}/entities"
    fs.make(log)
    if fs.empty(log):
        fs.write(_filter_at(root, 0), bytes(_BITS // 8))
    changes = spark.readStream.schema(ENTITIES).option("recursiveFileLookup", True).parquet(log)
    id_kind = source.schema["doc_id"].dataType.simpleString()
    asked = source.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = asked.select(F.concat(F.lit("d"), F.coalesce(F.concat(F.lit("="), "id"), F.lit(""))).alias("key"), F.lit("doc").alias("kind"), F.col("text").alias("value"))
    aliases = changes.select("key", "type", "canonical_text", "pseudonym", F.explode("aliases").alias("alias")).where("alias <> ''")
    size = F.coalesce(*[F.when(F.length("alias") >= k, k) for k in _SIZES])
    learnt = aliases.select(F.concat(F.lit("h"), F.col("alias").substr(F.lit(1), size)).alias("key"), F.lit("alias").alias("kind"), F.to_json(F.struct("key", "type", "canonical_text", "pseudonym", "alias")).alias("value"))
    rows = docs.unionByName(asked.select("text").mapInArrow(lambda batches: _heads(batches, root), _IN)).unionByName(learnt)
    found = rows.groupBy("key").applyInPandasWithState(_step, _OUT, "value string", "append", GroupStateTimeout.NoTimeout)

    def batch(rows: DataFrame, number: int) -> None:
        with settled_within(spark):
            # a stream's own session plans every shuffle in as many tasks as its state has stores, or more; the caller's adapts
            rows = settle(rows, "arrived", spark)
            held = _filter(_filter_at(root, number))
            if held is None:  # of a log from before, once
                held = _with_heads(np.zeros(_BITS // 8, dtype=np.uint8), spark.read.schema(ENTITIES).option("recursiveFileLookup", True).parquet(log))
            own = rows.where("kind = 'doc'").select(F.col("id").cast(id_kind).alias("doc_id"), F.col("value").alias("text"))
            if own.isEmpty():  # only changes of the batch before
                fs.write(_filter_at(root, number + 1), held.tobytes())
                return
            last = fs.latest(f"{root}/counters", number)
            counters = spark.read.schema(COUNTERS).parquet(last) if last else spark.createDataFrame([], COUNTERS)
            result = pipeline.run_with_memory(own, _touched(rows), counters=counters)
            out = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number:06d}")
            out(result.redacted, "redacted")
            added = settle(memory.additions(result.entities, counters), "added")
            fs.write(_filter_at(root, number + 1), _with_heads(held, added).tobytes())  # before the log has them
            out(added.drop("was"), "entities")
            out(_edges(result, added), "edges")
            out(memory.counted(added, counters), "counters")
            fs.prune(f"{root}/counters", number - keep)
            fs.prune(f"{root}/heads", number - keep)

    stores = partitions or min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get(_SHUFFLE)))
    settings = {_PROVIDER: _ROCKS, _SHUFFLE: str(stores)}  # a query keeps those that it was started with
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return found.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(root, "checkpoint")).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def drain(query: StreamingQuery) -> None:
    """Let a query finish what has arrived, what it has learnt from it included, and stop it."""
    query.processAllAvailable()
    query.stop()


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The whole memory as one table, each entity with its documents: an export, which no batch needs."""
    logged = lambda name, kind: spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{root}/{name}")
    named = logged("edges", "key string, doc_id string").distinct().groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return logged("entities", ENTITIES).join(named, "key", "left").select(*[f.split(" ")[0] for f in files.MEMORY.split(", ")])


def _filter_at(root: str, number: int) -> str:
    """The filter that a batch's texts are held against: one file for each, so none is read that is older."""
    return f"{root}/heads/batch={number:06d}"


def _filter(path: str) -> np.ndarray | None:
    """A filter's bytes; None where there is none to read, as in a root from before or a folder that workers don't see."""
    try:
        files, at = arrow_fs.FileSystem.from_uri(path)
        with files.open_input_stream(at) as f:
            data = f.read()
    except (OSError, ValueError):  # Arrow's own errors are among these
        return None
    return np.frombuffer(data, dtype=np.uint8) if len(data) == _BITS // 8 else None


def _bit(head: str) -> int:
    return zlib.crc32(head.encode()) % _BITS


def _bits(batches):
    """The distinct bits of a task's aliases."""
    seen: set[int] = set()
    for b in batches:
        for aliases in b.column(0).to_pylist():
            seen.update(_bit(a[: next(k for k in _SIZES if len(a) >= k)]) for a in aliases or () if a)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["bit"])


def _with_heads(held: np.ndarray, entities: DataFrame) -> np.ndarray:
    """A filter with the heads of entities' aliases; the driver gets at most ``_BITS`` numbers."""
    found = entities.select("aliases").mapInArrow(_bits, "bit long").distinct().toArrow().column("bit").to_numpy()
    out = held.copy()
    np.bitwise_or.at(out, found >> 3, np.left_shift(1, found & 7).astype(np.uint8))
    return out


def _heads(batches, root: str):
    """Every distinct head in a task's texts that the filter of its batch has, once for each ``_HEADS`` of them."""
    seen: set[str] = set()
    number = TaskContext.get().getLocalProperty("streaming.sql.batchId")
    held = _filter(_filter_at(root, int(number))) if number else None
    bits = None if held is None else held.tobytes()

    def there(head):
        at = _bit(head)
        return bits[at >> 3] >> (at & 7) & 1

    def out():
        keys = [f"h{h}" for h in seen if bits is None or there(h)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(["look"] * len(keys), pa.string()), pa.nulls(len(keys), pa.string())], names=["key", "kind", "value"])

    for b in batches:
        for t in b.column(0).to_pylist():
            for k in _SIZES:
                seen.update(t[i : i + k] for i in range(len(t) - k + 1))
            if len(seen) >= _HEADS:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _step(key, frames, state):
    """One key in one batch: a document's id is new or not; a head's aliases grow first, and are told if they were asked for."""
    learnt, texts, asked = [], [], False
    for frame in frames:
        for kind, value in zip(frame["kind"], frame["value"]):
            if kind == "alias":
                learnt.append(value)
            elif kind == "doc":
                texts.append(value)
            else:
                asked = True
    name = key[0]
    if name.startswith("d"):
        if not state.exists:
            state.update(("",))
            yield pd.DataFrame({"kind": ["doc"], "id": [name[2:] if name[1:] else None], "value": [min(texts)]})
        return
    known = state.get[0].split("\n") if state.exists else []
    if learnt:  # JSON has no line end inside
        known = list(dict.fromkeys(known + sorted(learnt)))
        state.update(("\n".join(known),))
    if asked and known:
        yield pd.DataFrame({"kind": ["alias"] * len(known), "id": [name[1:]] * len(known), "value": known})


def _touched(rows: DataFrame) -> DataFrame:
    """The memory as far as a batch's texts can name it."""
    one = F.from_json("value", "key string, type string, canonical_text string, pseudonym string, alias string").alias("e")
    found = rows.where("kind = 'alias'").select(one).select("e.*").distinct()
    grouped = found.groupBy("key", "type", "canonical_text", "pseudonym").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return settle(grouped.select("key", F.col("key").alias("canonical_id"), "type", "canonical_text", "aliases", F.expr("cast(array() as array<string>)").alias("doc_ids"), "pseudonym"), "touched")


def _edges(result: pipeline.Run, added: DataFrame) -> DataFrame:
    """(key, doc_id) of every entity that a batch's texts name, under the key that it has in the memory."""
    named = result.mentions.select("canonical_id", F.col("doc_id").cast("string").alias("doc_id"))
    keys = added.select("key", F.explode("was").alias("canonical_id"))
    return named.join(keys, "canonical_id", "left").select(F.coalesce("key", "canonical_id").alias("key"), "doc_id").distinct()


class _Folders:
    """The few calls on folders that a batch makes, on whatever file system holds them."""

    def __init__(self, spark: SparkSession):
        self.path, self.conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _at(self, where: str):
        path = self.path(where)
        return path.getFileSystem(self.conf), path

    def make(self, where: str) -> None:
        fs, path = self._at(where)
        fs.mkdirs(path)

    def empty(self, where: str) -> bool:
        fs, path = self._at(where)
        return not fs.listStatus(path)

    def write(self, where: str, data: bytes) -> None:
        fs, path = self._at(where)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def _batches(self, where: str) -> list[tuple[int, str]]:
        fs, path = self._at(where)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n.removeprefix("batch=")), f"{where}/{n}") for n in names if n.startswith("batch="))

    def latest(self, where: str, before: int) -> str | None:
        """The last batch's folder before a number."""
        return next((p for n, p in reversed(self._batches(where)) if n < before), None)

    def prune(self, where: str, before: int) -> None:
        for _, p in [(n, p) for n, p in self._batches(where)[:-1] if n < before]:
            fs, path = self._at(p)
            fs.delete(path, True)


def documents(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files with doc_id and text."""
    stream = spark.readStream.schema("doc_id long, text string")
    return (stream.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else stream).parquet(path)


def uploads(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "docx", "pdf"), most: int = 50 << 20) -> DataFrame:
    """A stream of files that are dropped into a folder (path, length, content), of the given suffixes and at most 50 MB."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return rows.where(F.col("length") <= most).select("path", "length", "content")
