"""Checks of a run: consistency, leaks, precision and recall, likeness of two extractions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_counts(spans: DataFrame) -> DataFrame:
    """Per document: spans by source, zero where there are none."""
    return spans.groupBy("doc_id").agg(*[F.count_if(F.col("source") == s).alias(s) for s in ("regex", "memory", "llm")])


def consistency(named: DataFrame) -> DataFrame:
    """One row: entities, distinct pseudonyms, surfaces, and surfaces that two entities share."""
    surfaces = named.select("type", "canonical_id", F.explode("aliases").alias("surface")).groupBy("surface").agg(F.count_distinct("canonical_id").alias("n"))
    shared = surfaces.agg(F.count(F.lit(1)).alias("surfaces"), F.count_if(F.col("n") > 1).alias("shared"))
    return named.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("pseudonym").alias("pseudonyms")).crossJoin(shared)  # two single rows


def precision_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """By type: exact hits, spans found and gold spans."""
    on = ["doc_id", "type", "start", "end"]
    a = found.select(*on).distinct().withColumn("f", F.lit(1))
    b = gold.select(*on).distinct().withColumn("g", F.lit(1))
    both = a.join(b, on, "full")
    return both.groupBy("type").agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("hits"), F.count("f").alias("found"), F.count("g").alias("gold"))


def likeness(pairs: DataFrame) -> DataFrame:
    """(doc_id, a, b) to lengths, their difference and a matching-blocks ratio to 4 places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ratio = [round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(f["a"].fillna(""), f["b"].fillna(""))]
            yield pd.DataFrame({"doc_id": f["doc_id"], "len_a": f["a"].fillna("").str.len(), "len_b": f["b"].fillna("").str.len(), "ratio": ratio}).assign(delta=lambda d: d["len_a"] - d["len_b"])[["doc_id", "len_a", "len_b", "delta", "ratio"]]

    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.select("doc_id", "a", "b").mapInPandas(run, f"doc_id {kind}, len_a long, len_b long, delta long, ratio double")


def stage_total(timings: Column) -> Column:
    """Sum of a map of stage times without its own total."""
    return F.aggregate(F.map_values(F.map_filter(timings, lambda k, v: k != "total")), F.lit(0.0), lambda s, x: s + x)


def ingest_metrics(pages: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Per document: pages, chunks, images, and whether its first page has a width."""
    own = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), (F.min_by("width", "page_no") > 0).alias("has_geometry"))
    counted = lambda rows, name: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    return own.join(counted(chunks, "chunks"), "doc_id", "left").join(counted(images, "images"), "doc_id", "left").fillna(0, ["chunks", "images"]).select("doc_id", "pages", "chunks", "images", "has_geometry")


def one_entity(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(group_id, members, entities, same): whether the mentions (group_id, doc_id, text) that gold says are one are one.

    found: doc_id, text, canonical_id. A mention that was not found counts as an entity of its own.
    """
    own = found.select("doc_id", "text", "canonical_id").distinct()
    rows = groups.select("group_id", "doc_id", "text").distinct().join(own, ["doc_id", "text"], "left")
    name = F.coalesce("canonical_id", F.concat_ws("#", F.lit("?"), "doc_id", "text"))
    counted = rows.groupBy("group_id").agg(F.count_distinct("doc_id", "text").alias("members"), F.count_distinct(name).alias("entities"))
    return counted.withColumn("same", F.col("entities") == 1)
