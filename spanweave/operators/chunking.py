"""Paragraph chunks with sentence-aligned overlap, in document-level code-point offsets."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text
from . import intervals


def full_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, nothing between them."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "").alias("text"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """Pages with ``page_start``, the length of all pages before."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("page_start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint"))


def paragraphs(pages: DataFrame, separator: str = r"\n[^\S\n]*\n") -> DataFrame:
    """doc_id, page_no, idx, start, end, text of paragraphs within their page."""
    rows = pages.select("doc_id", "page_no", F.posexplode(text.paragraphs(F.col("text"), separator)).alias("idx", "p"))
    return rows.select("doc_id", "page_no", "idx", "p.start", "p.end", "p.text")


_WORD, _STOP = re.compile(r"\S+"), re.compile(r"[.!?](?=\s|$)")


def _borrowed(page: str, start: int, end: int, ratio: float) -> tuple[int, int, int, int] | None:
    """(start, end, lead, trail) of the paragraph between two places: its first and last word, how far a chunk before it
    reaches into it, and from where on a chunk after it takes it along. None where there is no word."""
    words = [m.span() for m in _WORD.finditer(page, start, end)]
    if not words:
        return None
    first, last = words[0][0], words[-1][1]
    if ratio <= 0:
        return first, last, first, last
    k = max(1, math.ceil(len(words) * ratio))
    stops = [m.end() for m in _STOP.finditer(page, first, last)]
    if not stops or stops[-1] < last:
        stops.append(last)
    lead = stops[bisect_left(stops, words[k - 1][1])]
    tail = words[-k][0]
    i = bisect_right(stops, tail)
    trail = words[bisect_left(words, (stops[i - 1], 0))][0] if i else first
    return first, last, lead, trail


def chunk(pages: DataFrame, overlap: float = 0.2, separator: str = r"\n[^\S\n]*\n") -> DataFrame:
    """chunk_id, doc_id, page_no, idx, text, char_start, char_end.

    A chunk is a paragraph with at least ``overlap`` of its neighbours' words, led back (or on) to a sentence's edge.
    A page is read once: its paragraphs, words and sentences are offsets into it, and only chunks are cut out.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    between = re.compile(separator)

    def run(batches):
        for b in batches:
            out = []
            for doc_id, page_no, page, offset in zip(*(c.to_pylist() for c in b.columns)):
                page = page or ""
                gaps = [m.span() for m in between.finditer(page)]
                bounds = zip([0, *(g[1] for g in gaps)], [*(g[0] for g in gaps), len(page)])
                found = [p for a, e in bounds if (p := _borrowed(page, a, e, overlap))]
                for i, (first, last, _, _) in enumerate(found):
                    a = found[i - 1][3] if i and overlap else first
                    e = found[i + 1][2] if i + 1 < len(found) and overlap else last
                    out.append((f"{doc_id}_p{page_no}_c{i}", doc_id, page_no, i, page[a:e], offset + a, offset + e))
            columns = zip(*out) if out else [[]] * 7
            kinds = [pa.string(), b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["chunk_id", "doc_id", "page_no", "idx", "text", "char_start", "char_end"])

    placed = page_offsets(pages).select("doc_id", "page_no", "text", "page_start")
    kind = {f.name: f.dataType.simpleString() for f in placed.schema}
    return placed.mapInArrow(run, f"chunk_id string, doc_id {kind['doc_id']}, page_no {kind['page_no']}, idx int, text string, char_start long, char_end long")


def gate(chunks: DataFrame, least: int = 30, most: int = 3) -> DataFrame:
    """The first chunks of each document that are long enough to show a model."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "idx")
    return chunks.where(F.length("text") > least).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def page_words(words: DataFrame) -> DataFrame:
    """Words (doc_id, page_no, block_no, line_no, word_no, word) with char_start and char_end in their page's text."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("block_no", "line_no", "word_no")
    first = F.lag("word").over(w).isNull()
    sep = F.when(first, "").when(F.lag("block_no").over(w) != F.col("block_no"), "\n\n").when(F.lag("line_no").over(w) != F.col("line_no"), "\n").otherwise(" ")
    rows = words.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("word")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    return rows.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("word"))


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) from words: blocks by a blank line, lines by a line end, words by a space."""
    placed = page_words(words)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("char_start", "sep", "word"))), lambda x: F.concat(x["sep"], x["word"]))
    return placed.groupBy("doc_id", "page_no").agg(F.array_join(pieces, "").alias("text"))


def chunk_boxes(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks with the union of the boxes of the words inside them; nulls where there are none."""
    return intervals.enclosed_boxes(chunks, words)
