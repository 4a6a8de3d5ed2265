"""Stable pseudonyms for entities, and the surface map that rewriting reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ordering import numbered


def assign(found: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Entities with ``pseudonym``: numbered within a type by canonical_id as text, from the counter (type, next) on.

    Resolved entities bring that number, their ``place``, as their ids count on without a gap; others are put in order.
    """
    out = found.withColumnRenamed("place", "_i") if "place" in found.columns else numbered(found, "type", ["canonical_id"], "_i")
    if counters is not None:
        out = out.join(F.broadcast(counters), "type", "left").withColumn("_i", F.col("_i") + F.coalesce("next", F.lit(0))).drop("next")
    return out.withColumn("pseudonym", text.pseudonym(F.col("type"), F.col("_i"))).drop("_i")


def surface_map(named: DataFrame) -> DataFrame:
    """surface, pseudonym, canonical_id, type; of entities that share a surface the last by canonical_id wins."""
    rows = named.select("canonical_id", "type", "pseudonym", F.explode("aliases").alias("surface")).where("surface <> ''")
    last = F.max(F.struct("canonical_id", "type", "pseudonym"))
    return rows.groupBy("surface").agg(last.alias("e")).select("surface", "e.pseudonym", "e.canonical_id", "e.type")


def next_counters(named: DataFrame) -> DataFrame:
    """(type, next): one past the largest index among pseudonyms; malformed ones don't count."""
    return named.groupBy("type").agg((F.max(text.pseudonym_index(F.col("type"), F.col("pseudonym"))) + 1).alias("next")).where("next IS NOT NULL")


def statements(named: DataFrame) -> DataFrame:
    """One sentence per entity, for a graph store."""
    line = F.format_string("%s is a %s known as %s (aliases: %s; documents: %s).", "canonical_text", "type", "pseudonym", F.array_join("aliases", ", "), F.array_join(F.col("doc_ids").cast("array<string>"), ", "))
    return named.select("canonical_id", "pseudonym", line.alias("statement"), F.array("canonical_id", "pseudonym").alias("node_set"))


def payloads(spans: DataFrame) -> DataFrame:
    """Per document: a header and a line for each span in order, their number, and the tags of its node."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", F.concat_ws(": ", "type", "text").alias("line")))), lambda x: F.concat(F.lit("- "), x["line"]))
    rows = spans.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("body"), F.count(F.lit(1)).alias("n_spans"))
    return rows.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("body")).alias("payload"), "n_spans", F.array(F.col("doc_id").cast("string")).alias("node_set"))


def edges(named: DataFrame) -> DataFrame:
    """(canonical_id, doc_id) of a bipartite graph."""
    return named.select("canonical_id", F.explode("doc_ids").alias("doc_id")).distinct()
