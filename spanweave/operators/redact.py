"""Rewriting texts, and the plan of rectangles for paginated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import intervals


def replacements(spans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Spans with the pseudonym of their surface, as it stands or trimmed; spans without one go. Only those with white space at
    an edge are looked up a second time."""
    own = spans.withColumn("_trim", text.strip(F.col("text")))
    exact = surfaces.select(F.col("surface").alias("text"), F.col("pseudonym").alias("_p"))
    loose = surfaces.select(F.col("surface").alias("_trim"), F.col("pseudonym").alias("_q"))
    plain = own.where("_trim = text").join(exact, "text").withColumn("_q", F.lit(None).cast("string"))
    edged = own.where("_trim <> text").join(exact, "text", "left").join(loose, "_trim", "left")
    return plain.unionByName(edged).withColumn("pseudonym", F.coalesce("_p", "_q")).where("pseudonym IS NOT NULL").drop("_trim", "_p", "_q")


def redact(docs: DataFrame, spans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """doc_id, original, redacted, replacements for every document. Spans must not overlap; a document's spans are one array."""
    marks = replacements(spans, surfaces).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pseudonym"))).alias("marks"))
    joined = docs.select("doc_id", F.col("text").alias("original")).join(marks, "doc_id", "left")
    # a piece for each span: what lies between it and the one before, and its pseudonym; then what is left
    before = lambda i: F.coalesce(F.get("marks", i - 1)["end"], F.lit(0).cast("bigint"))
    cut = lambda a, b: F.substring(F.col("original"), (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform("marks", lambda m, i: F.concat(cut(before(i), m["start"]), m["pseudonym"]))
    tail = cut(F.element_at("marks", -1)["end"], F.length("original"))
    rewritten = F.when(F.col("marks").isNull(), F.col("original")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select("doc_id", "original", rewritten.alias("redacted"), F.coalesce(F.size("marks"), F.lit(0)).cast("bigint").alias("replacements"))


def leaks(redacted: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, surface): detected surfaces that a rewritten text still holds."""
    pairs = spans.select("doc_id", F.col("text").alias("surface")).distinct().join(redacted.select("doc_id", "redacted"), "doc_id")
    return pairs.where(F.contains("redacted", F.col("surface"))).select("doc_id", "surface")


def span_words(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Spans beside each word they touch (ws, we: its offsets), an interval join within the document."""
    w = words.select("doc_id", "page_no", "word", F.col("char_start").alias("ws"), F.col("char_end").alias("we"), "x0", "y0", "x1", "y1")
    return intervals.overlaps(spans.select("doc_id", "type", "start", "end"), w, ["doc_id"], right_ends=("ws", "we"))


def span_rectangles(spans: DataFrame, words: DataFrame) -> DataFrame:
    """One rectangle per (document, span, page): the union of the boxes of the words it touches."""
    return intervals.touched_boxes(spans, words)


def rectangles_to_print(spans: DataFrame, words: DataFrame, surfaces: DataFrame, overlay: bool = True) -> DataFrame:
    """doc_id, page_no, x0, y0, x1, y1, label: what a writer blacks out, and the pseudonym to print there (null without overlay)."""
    named = replacements(spans, surfaces).select("doc_id", "type", "start", "end", "pseudonym")
    label = F.col("pseudonym") if overlay else F.lit(None).cast("string")
    return span_rectangles(spans, words).join(named, ["doc_id", "type", "start", "end"]).select("doc_id", "page_no", "x0", "y0", "x1", "y1", label.alias("label"))


def unmapped(spans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(surface): surfaces of spans that the map lacks, as they stand and trimmed."""
    rows = spans.select(F.col("text").alias("surface")).distinct().withColumn("_trim", text.strip(F.col("surface")))
    known = surfaces.select("surface")
    return rows.join(known, "surface", "left_anti").join(known.withColumnRenamed("surface", "_trim"), "_trim", "left_anti").select("surface")


def page_searches(spans: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans without any word box: the pages of their document whose text holds theirs, whatever the case."""
    boxed = span_rectangles(spans, words).select("doc_id", "type", "start", "end").distinct()
    left = spans.join(boxed, ["doc_id", "type", "start", "end"], "left_anti")
    return left.join(pages.select("doc_id", "page_no", F.col("text").alias("page_text")), "doc_id").where(F.contains(F.lower("page_text"), F.lower("text"))).drop("page_text")
