"""Whole runs: patterns to rewritten texts, alone or on top of a memory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, detect, memory, pseudonyms, redact, resolve
from ..operators.spans import dedup_by_region
from ..sources.shared import settle


@dataclass
class Run:
    """Results of a run: spans and entities are settled, the rest is lazy. edges: (canonical_id, doc_id) rows of the entities
    that the run named; no entity's documents gather in one array."""

    spans: DataFrame
    entities: DataFrame
    surfaces: DataFrame
    redacted: DataFrame
    edges: DataFrame

    @property
    def exported(self) -> DataFrame:
        """Entities with their documents as an array, for sinks whose format has it so."""
        return resolve.with_documents(self.entities, self.edges)

    @property
    def mentions(self) -> DataFrame:
        """(canonical_id, doc_id) rows by the surface map, so that known entities are among them."""
        mapped = self.surfaces.select(F.col("surface").alias("_s"), "canonical_id")
        rows = self.spans.select("doc_id", F.explode(F.array_distinct(F.array("text", text.strip(F.col("text"))))).alias("_s"))
        return rows.join(mapped, "_s").select("canonical_id", "doc_id").distinct()


def run(docs: DataFrame, spans: DataFrame | None = None) -> Run:
    """Resolve spans (of the patterns, if none are given), name entities and rewrite every document."""
    found = settle(dedup_by_region(spans if spans is not None else detect.detect_patterns(docs)), "kept-spans")
    fresh, edges = resolve.resolved(found)
    named = settle(pseudonyms.assign(fresh), "entities")
    surfaces = pseudonyms.surface_map(named)
    return Run(found, named, surfaces, redact.redact(docs, found, surfaces), edges)


def model_spans(pages: DataFrame, spans: DataFrame, known: DataFrame, detector: Callable, answers: str | None = None) -> DataFrame:
    """What a model finds in the gated chunks of documents that hold an unknown span; the other documents are not shown to it."""
    wanted = memory.unknown(spans, known).select("doc_id").distinct()
    chunks = chunking.gate(chunking.chunk(pages)).join(wanted, "doc_id", "left_semi")
    return detect.spans_from_answers(detect.detect_model(chunks, detector, answers))


def run_with_memory(docs: DataFrame, known: DataFrame, detector: Callable | None = None, pages: DataFrame | None = None, counters: DataFrame | None = None, answers: str | None = None) -> Run:
    """Patterns and memory first; a model sees only gated chunks of documents that hold an unknown span.

    counters: see ``memory.mapped``, where ``known`` is only what the documents can name. answers: see ``detect.detect_model``.
    """
    columns = ["doc_id", "type", "text", "start", "end", "source", "confidence", "ord"]
    spans = detect.detect_patterns(docs).select(*columns).unionByName(memory.scan(docs, known).select(*columns))
    if detector is not None and pages is not None:
        spans = settle(spans, "first-spans")
        spans = spans.unionByName(model_spans(pages, spans, known, detector, answers).select(*columns))
    found = settle(dedup_by_region(spans), "kept-spans")
    named, surfaces, edges = memory.mapped(found, known, counters)
    return Run(found, named, surfaces, redact.redact(docs, found, surfaces), edges)


def remember(known: DataFrame, result: Run) -> DataFrame:
    """The memory after a run, in the form of an exported one; ``memory.upsert_rows`` keeps edges as rows."""
    return memory.upsert(known, result.exported.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")))
