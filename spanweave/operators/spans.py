"""Resolving overlapping spans: a document's spans are swept in order, once.

Span rows have doc_id, type, text, start, end, source, confidence; ``ord`` breaks ties in the order of detection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Which source wins an exact tie, memory before patterns before models.
PRIORITY = {"memory": 3, "regex": 2, "llm": 1}


def _rank(order: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in order.items():
        out = F.when(F.col("source") == name, value).otherwise(out)
    return out


def _fold(spans: DataFrame, keys: list[Column], replace: bool = False) -> DataFrame:
    """Greedy sweep by ``keys``: keep a span that starts at or after the last kept end (or, with ``replace``, let it replace an overlapped one that ends earlier).

    Whether a span stays hangs on those kept before it, so rows are sorted within their document's partition and pass
    by in Arrow batches; only two numbers and a row are held, however many spans a document has.
    """
    fields = spans.columns
    place = {c: fields.index(c) for c in ("doc_id", "start", "end")}

    def run(batches):
        """Starts come in order, so the next row to stay is found by bisection for a whole batch; the walk is over kept rows."""
        doc, end = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column(place["doc_id"])
            starts, ends = (b.column(place[c]).to_numpy().astype(np.int64) for c in ("start", "end"))
            codes = docs.dictionary_encode(null_encoding="encode").indices.to_numpy()
            low = min(starts.min(), ends.min())
            width = max(starts.max(), ends.max()) - low + 1
            base = np.cumsum(np.r_[False, codes[1:] != codes[:-1]]) * width
            at = base + starts - low
            after = np.maximum(np.searchsorted(at, base + ends - low), np.arange(1, b.num_rows + 1)).tolist()
            i = int(np.searchsorted(at, min(end - low, width))) if docs[0].as_py() == doc else 0
            kept = []
            while i < b.num_rows:
                kept.append(i)
                i = after[i]
            doc = docs[-1].as_py()
            if kept:  # the last of them is of the last document, whose first row stays
                end = int(ends[kept[-1]])
                yield b.take(pa.array(kept))

    def run_replacing(batches):
        doc, end, held = object(), 0, None  # held: the last kept row, which may still be replaced
        for b in batches:
            keep, last = np.zeros(b.num_rows, dtype=bool), -1
            docs, starts, ends = (b.column(place[c]).to_pylist() for c in ("doc_id", "start", "end"))
            for i, (d, s, e) in enumerate(zip(docs, starts, ends)):
                if d != doc or s >= end:
                    keep[i] = True
                elif e > end:
                    keep[i] = True
                    if last >= 0:
                        keep[last] = False
                    else:
                        held = None
                else:
                    continue
                doc, end, last = d, e, i
            if last >= 0:
                if held is not None:
                    yield held
                held, keep[last] = b.slice(last, 1), False
            yield b.filter(pa.array(keep))
        if held is not None:
            yield held

    names = [f"_k{i}" for i in range(len(keys))]
    ties = [F.col(f"`{f}`") for f in fields if f != "doc_id"]  # what the keys leave open is settled by the rest of a row
    dealt = spans.withColumns(dict(zip(names, keys))).repartition("doc_id").sortWithinPartitions("doc_id", *names, *ties)
    return dealt.select(*[F.col(f"`{f}`") for f in fields]).mapInArrow(run_replacing if replace else run, spans.schema)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Leftmost, then widest, then pattern before model; later overlaps go."""
    return _fold(spans, [F.col("start"), -F.col("end"), -_rank({"regex": 1}), F.col("ord")])


def dedup_by_region(spans: DataFrame) -> DataFrame:
    """Leftmost, then longest, then memory, pattern, model."""
    return _fold(spans, [F.col("start"), -(F.col("end") - F.col("start")), -_rank(PRIORITY), F.col("ord")])


def memory_overlap_dedup(spans: DataFrame) -> DataFrame:
    """By start; an overlapping span that ends later replaces the last kept one."""
    return _fold(spans, [F.col("start"), F.col("ord")], replace=True)


def drop_contained(spans: DataFrame) -> DataFrame:
    """Drop a span that lies in a longer one of the same type in its document; equal ranges both stay.

    In the order (start, -end), a longer span around another comes before it: one running maximum of ends per document
    and type tells, over all rows before the range itself.
    """
    order = F.col("start").cast("bigint") * F.lit(1 << 32) - F.col("end")  # offsets are below 2^31
    before = Window.partitionBy("doc_id", "type").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(before)).where("_reach IS NULL OR _reach < end").drop("_reach")


def outside(inner: Column, outer: Column) -> Column:
    """The spans of one array that lie in no longer one of another."""
    around = lambda m: F.exists(outer, lambda o: (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (o["end"] - o["start"] > m["end"] - m["start"]))
    return F.filter(inner, lambda m: ~around(m))


def dedup_by_id(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per span_id: the last one's values at the first one's place."""
    w = Window.partitionBy("span_id")
    ranked = spans.withColumn("_rn", F.row_number().over(w.orderBy(F.col(seq).desc()))).withColumn("_first", F.min(seq).over(w))
    return ranked.where("_rn = 1").withColumn(seq, F.col("_first")).drop("_rn", "_first")
