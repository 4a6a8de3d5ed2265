"""Detection: patterns, model answers, and spans from a model's offsets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..sources.shared import fresh_path, settle
from .spans import outside


def _span_id(prefix: str, *columns) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("#", *columns), 256), 1, 8))


def _gate(kind: str) -> Column:
    """A cheap test that a text without a match of this kind often fails."""
    return F.contains(F.col("text"), F.lit("@")) if kind == "EMAIL" else F.col("text").rlike("[0-9]")


def scan_pattern(docs: DataFrame, kind: str, pattern: str, order: int = 0) -> DataFrame:
    """Spans of one pattern. Its matches are computed once per document and only where a cheap test lets it."""
    # no filter: one would be moved before rows are dealt to all cores, and the texts made there
    found = docs.select("doc_id", F.explode(F.when(_gate(kind), text.match_spans(F.col("text"), pattern))).alias("m"))
    return found.select("doc_id", F.lit(kind).alias("type"), "m.text", "m.start", "m.end", F.lit("regex").alias("source"), F.lit(0.95).alias("confidence"), F.lit(order).cast("bigint").alias("ord"))


def detect_patterns(docs: DataFrame, scan=None, contained: bool = False) -> DataFrame:
    """Union of all patterns over (doc_id, text), read in one pass; contained spans of the same type go unless asked for.

    Matches of one pattern never overlap, so only types that several patterns look for are searched for containment,
    and that within a document's own arrays: nothing is shuffled.
    """
    scan = scan or patterns.SCAN
    kinds: dict[str, list[int]] = {}
    for i, (kind, _) in enumerate(scan):
        kinds.setdefault(kind, []).append(i)
    none = F.expr(f"cast(array() as {text.SPAN})")
    # tests are columns, made once, and no filter: one would be moved before rows are dealt to all cores, and the texts made there
    tested = docs.select("doc_id", "text", *[_gate(kind).alias(f"_{kind}") for kind in ("EMAIL", "OTHER")])
    spans = [F.when(F.col("_EMAIL" if kind == "EMAIL" else "_OTHER"), text.match_spans(F.col("text"), p)).otherwise(none) for kind, p in scan]
    found = tested.select("doc_id", *[h.alias(f"h{i}") for i, h in enumerate(spans)])

    def hits_of(i: int) -> Column:
        hits = F.col(f"h{i}")
        for j in kinds[scan[i][0]]:
            if j != i and not contained:
                hits = outside(hits, F.col(f"h{j}"))
        return F.transform(hits, lambda m: F.struct(F.lit(scan[i][0]).alias("type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(i).cast("bigint").alias("ord")))

    rows = found.select("doc_id", F.explode(F.concat(*[hits_of(i) for i in range(len(scan))])).alias("m"))
    return rows.select("doc_id", "m.type", "m.text", "m.start", "m.end", F.lit("regex").alias("source"), F.lit(0.95).alias("confidence"), "m.ord")


def with_span_ids(spans: DataFrame) -> DataFrame:
    """Deterministic span_id from what identifies a span."""
    return spans.withColumn("span_id", _span_id("sp-", "doc_id", "type", "start", "end", "source"))


def find_in_chunk(chunk, surface) -> Column:
    """Offset of a surface in a chunk: as it stands, else its words with any white space between; -1 if nowhere."""
    direct = F.instr(chunk, surface).cast("bigint") - 1
    words = F.transform(F.filter(F.split(surface, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1"))
    loose = F.array_join(words, r"\s*")
    head = F.element_at(F.split(chunk, loose, 2), 1)
    return F.when(direct >= 0, direct).when(F.size(words) == 0, F.lit(-1).cast("bigint")).when(F.regexp_like(chunk, loose), F.length(head).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


_ITEM = "array<struct<type:string,text:string,char_start:string,char_end:string>>"


def parse_answer(answer) -> Column:
    """A model's answer as an array of (type, text, char_start, char_end): fenced, in prose, or wrapped in an object, under
    a usual key or else the first one that holds a list."""
    bare = text.strip(F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    keys = [F.get_json_object(bare, f"$.{k}") for k in ("results", "spans", "data", "pii", "items")]
    lists = [F.when(k.startswith("["), k) for k in keys]
    values = F.map_values(F.from_json(bare, "map<string,string>"))
    other = F.get(F.filter(values, lambda v: F.ltrim(v).startswith("[")), F.lit(0))
    first = F.regexp_extract(bare, r"(?s)\[.*?\]", 0)
    source = F.when(bare.startswith("["), bare).when(bare.startswith("{"), F.coalesce(*lists, other)).otherwise(first)
    items = F.from_json(source, _ITEM)
    kept = F.filter(items, lambda x: x["text"].isNotNull() & (text.strip(x["text"]) != ""))
    tidy = F.transform(kept, lambda x: F.struct(text.normalize_type(x["type"]).alias("type"), x["text"].alias("text"), F.coalesce(x["char_start"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("char_start"), F.coalesce(x["char_end"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("char_end")))
    return F.coalesce(tidy, F.expr("cast(array() as array<struct<type:string,text:string,char_start:bigint,char_end:bigint>>)"))


def answer_content(body) -> Column:
    """The text in a model server's response, whatever its shape; a body that is not JSON gives its first line."""
    paths = ["$.choices[0].message.content", "$.response", "$.message.content", "$.content", "$.error"]
    return F.coalesce(*[F.get_json_object(body, p) for p in paths], F.split_part(body, F.lit("\n"), F.lit(1)))


def spans_from_answers(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text, char_start, answer) to document spans; a text that the chunk does not hold is dropped."""
    items = chunks.select("chunk_id", "doc_id", "text", "char_start", F.posexplode(parse_answer(F.col("answer"))).alias("i", "a"))
    placed = items.withColumn("at", find_in_chunk(F.col("text"), F.col("a.text"))).where("at >= 0")
    start = F.col("char_start") + F.col("at")
    return placed.select("doc_id", F.col("a.type").alias("type"), F.col("a.text").alias("text"), start.alias("start"), (start + F.length("a.text")).alias("end"), F.lit("llm").alias("source"), F.lit(0.85).alias("confidence"), F.col("i").cast("bigint").alias("ord"), "chunk_id")


_ANSWERS = "digest string, answer string, error string"


def detect_model(chunks: DataFrame, detector: Callable[[list[str]], list[str]], store: str | None = None, together: int = 16) -> DataFrame:
    """Chunks (chunk_id, doc_id, text, char_start) with ``answer`` and ``error``; every distinct text is asked for once.

    ``detector`` maps texts to answers and is called on the executors, with ``together`` texts at most. Where it raises a
    RuntimeError its texts are asked for one by one, and one that fails keeps its error and no answer. Answers and errors
    are appended to the table ``store`` (by default one of this run's), and what it holds is not asked for again.
    """
    spark = chunks.sparkSession
    store = store or fresh_path(spark, "answers")
    base = chunks.select("chunk_id", "doc_id", "text", "char_start").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    base = settle(base, "chunks")
    texts = base.groupBy("digest").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def asked(some: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = detector(some)
            if len(answers) != len(some):
                raise RuntimeError(f"{len(answers)} answers to {len(some)} texts")
            return [(a, None) for a in answers]
        except RuntimeError as e:
            return [(None, str(e))] if len(some) == 1 else [x for t in some for x in asked([t])]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, together):
                part = b.slice(at, together)
                found = asked(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.string()) for x in zip(*found))], names=["digest", "answer", "error"])

    known = answers_of(spark, store)
    fresh = texts if known is None else texts.join(known.select("digest"), "digest", "left_anti")
    # calls are slow: each core takes its share, whatever the tables' files
    dealt = fresh.repartition(spark.sparkContext.defaultParallelism, "digest")
    dealt.select("digest", "text").mapInArrow(run, _ANSWERS).write.mode("append").parquet(store)
    return base.join(answers_of(spark, store), "digest").drop("digest")


def answers_of(spark: SparkSession, store: str) -> DataFrame | None:
    """A table of answers; None where there is none yet."""
    try:
        return spark.read.schema(_ANSWERS).parquet(store)
    except AnalysisException:
        return None
