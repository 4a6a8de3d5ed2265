"""Interval joins by a sorted sweep.

Both tables are dealt by their common key, sorted by start and read once, a batch at a time beside the intervals that are
still open where it begins. Of two that overlap the later one begins inside the other, so what meets an interval is a
stretch of the other side's starts, found by bisection for a whole batch in numpy. What is held is what is open at one
place: a join costs its input and its output, never the product of a document's spans and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_BOX = ("x0", "y0", "x1", "y1")
#: Pairs that are looked at together.
_PAIRS = 50_000


def _dealt(left: DataFrame, right: DataFrame, by: list[str], ends: tuple[str, str], right_ends: tuple[str, str], more: tuple[str, ...] = (), carried: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of both sides in the order of the sweep: key columns, _start, _end, _side (0: left), and the left's columns and
    what is carried of the right's, each a column of its own, as nested rows are slow to sort and to hand over.

    more: columns of the left that settle ties. carried: columns of the right, all but the keys by default.
    """
    own = [left.columns, [c for c in right.columns if c not in by] if carried is None else list(carried)]
    kinds = [df.schema for df in (left, right)]

    def side(df: DataFrame, k: int, names: tuple[str, str]) -> DataFrame:
        columns = [(F.col(f"`{c}`") if i == k else F.lit(None).cast(kinds[i][c].dataType)).alias(f"{_SIDES[i]}:{c}") for i in (0, 1) for c in own[i]]
        return df.select(*by, F.col(names[0]).cast("long").alias("_start"), F.col(names[1]).cast("long").alias("_end"), F.lit(k).alias("_side"), *columns)

    rows = side(left, 0, ends).union(side(right, 1, right_ends))
    return rows.repartition(*by).sortWithinPartitions(*by, "_start", "_side", "_end", *[F.col(f"`{_SIDES[0]}:{c}`") for c in more])


#: Beginnings of the columns of the left and of the right.
_SIDES = ("_l", "_r")


def _gathered(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with the columns of each side as one struct, without a copy; one that has them so is returned as it is."""
    if set(_SIDES) <= set(b.schema.names):
        return b
    at = b.schema.get_field_index("_side") + 1
    columns, names = list(b.columns[:at]), b.schema.names[:at]
    for name in _SIDES:
        own = [i for i in range(at, b.num_columns) if b.schema.names[i].startswith(f"{name}:")]
        fields = [pa.field(b.schema.names[i][len(name) + 1 :], b.schema.field(i).type) for i in own]
        columns.append(pa.StructArray.from_arrays([b.column(i) for i in own], fields=fields))
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names=names)


class _Step:
    """A batch behind the rows that were open before it (the first ``held``): per side the rows' places, starts and ends, as
    ranks that grow with the group, and how many of them were held."""

    def __init__(self, rows: pa.RecordBatch, held: int, distinct: str | None):
        group = _groups(rows)
        start, end = (rows.column(c).to_numpy() for c in ("_start", "_end"))
        if distinct:
            again = self._again(rows, group, start, end, distinct)
            rows, group, start, end = rows.filter(pa.array(~again)), group[~again], start[~again], end[~again]
        places = np.unique(np.concatenate([start, end]))
        base = group * len(places)
        side = rows.column("_side").to_numpy()
        self.rows, self.start, self.end = rows, start, end
        self.at = [np.flatnonzero(side == k) for k in (0, 1)]
        begin, close = base + np.searchsorted(places, start), base + np.searchsorted(places, end)
        self.begin, self.close = [begin[i] for i in self.at], [close[i] for i in self.at]
        self.held = [int(np.searchsorted(i, held)) for i in self.at]
        # open: what a later row of the last group may still meet, or repeat
        self.open = (group == group[-1]) & ((end >= start[-1]) | (start == start[-1]))

    @staticmethod
    def _again(rows, group, start, end, name) -> np.ndarray:
        """Left rows like the left row before them."""
        out = np.zeros(len(group), dtype=bool)
        at = np.flatnonzero(rows.column("_side").to_numpy() == 0)
        if len(at) > 1:
            kind = pc.dictionary_encode(rows.column("_l").field(name).take(pa.array(at)), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same = kind[1:] == kind[:-1]
            for v in (group, start, end):
                same &= v[at[1:]] == v[at[:-1]]
            out[at[1:][same]] = True
        return out


def _groups(rows: pa.RecordBatch) -> np.ndarray:
    """Numbers of the runs of equal keys, which stand before _start."""
    new = np.zeros(rows.num_rows, dtype=bool)
    for k in range(rows.schema.get_field_index("_start")):
        c = rows.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _steps(batches, found: list, distinct: str | None = None, lost=None) -> Iterator[_Step]:
    """The sweep's steps; ``found`` gets the schema. Rows with a null key or end are passed to ``lost``."""
    held = None
    for b in map(_gathered, batches):
        if not found:
            found.append(b.schema)
        good = np.ones(b.num_rows, dtype=bool)
        for k in range(b.schema.get_field_index("_end") + 1):
            if b.column(k).null_count:
                good &= b.column(k).is_valid().to_numpy(zero_copy_only=False)
        if not good.all():
            if lost:
                lost(b.filter(pa.array(~good)))
            b = b.filter(pa.array(good))
        if not b.num_rows:
            continue
        n = held.num_rows if held is not None else 0
        if n:
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, b.columns)], schema=b.schema)
        step = _Step(b, n, distinct)
        yield step
        held = step.rows.filter(pa.array(step.open))


def _stretches(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all j from low[i] to high[i], in parts of some ``_PAIRS``."""
    counts = np.maximum(high - low, 0)
    after = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = after[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(after, before + _PAIRS, "right")))
        n = counts[at:to]
        if total := int(n.sum()):
            i = np.repeat(np.arange(at, to), n)
            yield i, np.arange(total) - np.repeat(after[at:to] - n - before, n) + low[i]
        at = to


def _pairs(s: _Step) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) places of rows that overlap, as numbers within their sides, one of them of this step."""
    for k in (0, 1):  # of rows that begin together the left one counts as first
        n = len(s.at[k])
        low, high = np.searchsorted(s.begin[1 - k], s.begin[k], "right" if k else "left"), np.searchsorted(s.begin[1 - k], s.close[k], "left")
        low[: min(s.held[k], n)] = np.maximum(low[: s.held[k]], s.held[1 - k])
        for i, j in _stretches(low, high):
            meets = s.begin[k][i] < s.close[1 - k][j]
            i, j = i[meets], j[meets]
            if len(i):
                yield (j, i) if k else (i, j)


def overlaps(left: DataFrame, right: DataFrame, by: list[str], ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows with equal keys whose half-open ranges overlap (each starts before the other ends).

    All columns of the left, and those of the right that are not in ``by``; other names must not clash. Null keys and ends
    overlap nothing; repeated rows are rows of their own.
    """
    more = [f for f in right.schema if f.name not in by]
    out_kind = StructType([*left.schema, *[StructField(f.name, f.dataType) for f in more]])
    names = left.columns, [f.name for f in more]

    def run(batches):
        for s in _steps(batches, []):
            sides = s.rows.column("_l"), s.rows.column("_r")
            for pair in _pairs(s):
                out = [side.take(pa.array(at[i])) for side, at, i in zip(sides, s.at, pair)]
                yield pa.RecordBatch.from_arrays([x.field(n) for x, own in zip(out, names) for n in own], names=[*names[0], *names[1]])

    return _dealt(left, right, by, ends, right_ends).mapInArrow(run, out_kind)


def _boxes(s: _Step) -> np.ndarray:
    """The boxes of a step's words; NaN for null."""
    words = s.rows.column("_r").take(pa.array(s.at[1]))
    return np.stack([words.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in _BOX], axis=1)


def _united(boxes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The unions of runs of boxes that begin at ``first``; sides that are NaN don't count."""
    return np.concatenate([np.fmin.reduceat(boxes[:, :2], first, axis=0), np.fmax.reduceat(boxes[:, 2:], first, axis=0)], axis=1)


def _sides(boxes: np.ndarray) -> list[pa.Array]:
    return [pa.array(boxes[:, k], pa.float64(), from_pandas=True) for k in range(4)]


def touched_boxes(spans: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, type, start, end, page_no, x0, y0, x1, y1: for each distinct span and page the union of the boxes of the words
    (doc_id, page_no, char_start, char_end, and the box) that it overlaps."""
    s = spans.select("doc_id", "type", "start", "end")
    w = words.select("doc_id", "page_no", "char_start", "char_end", *[F.col(c).cast("double").alias(c) for c in _BOX])
    kind = {f.name: f.dataType.simpleString() for f in [*s.schema, *w.schema]}
    schema = f"doc_id {kind['doc_id']}, type {kind['type']}, start long, end long, page_no {kind['page_no']}, x0 double, y0 double, x1 double, y1 double"

    def run(batches):
        # unions so far, of a span's place among the step's spans and a page's number
        owner, page, box = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4))
        pages: dict = {}
        for s in _steps(batches, [], "type"):
            encoded = pc.dictionary_encode(s.rows.column("_r").field("page_no").take(pa.array(s.at[1])), null_encoding="encode")
            numbers = np.array([pages.setdefault(v, len(pages)) for v in encoded.dictionary.to_pylist()], np.int64)
            on = numbers[encoded.indices.to_numpy(zero_copy_only=False)] if len(numbers) else np.zeros(0, np.int64)
            boxes = _boxes(s)
            for i, j in _pairs(s):
                owner, page, box = np.concatenate([owner, i]), np.concatenate([page, on[j]]), np.concatenate([box, boxes[j]])
                order = np.lexsort((page, owner))
                owner, page, box = owner[order], page[order], box[order]
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (page[1:] != page[:-1])])
                owner, page, box = owner[first], page[first], _united(box, first)
            stays = s.open[s.at[0]]
            done = ~stays[owner]
            if done.any():
                yield batch(s, owner[done], page[done], box[done], pages)
            owner, page, box = (np.cumsum(stays) - 1)[owner[~done]], page[~done], box[~done]
            last = s
        if len(owner):
            held = np.flatnonzero(last.open[last.at[0]])
            yield batch(last, held[owner], page, box, pages)

    def batch(s, owner, page, box, pages):
        at = pa.array(s.at[0][owner])
        spans, names = s.rows.column("_l").take(at), pa.array(list(pages), s.rows.schema.field("_r").type.field("page_no").type)
        columns = [spans.field("doc_id"), spans.field("type"), pa.array(s.start[s.at[0][owner]]), pa.array(s.end[s.at[0][owner]]), names.take(pa.array(page)), *_sides(box)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "type", "start", "end", "page_no", *_BOX])

    return _dealt(s, w, ["doc_id"], ("start", "end"), ("char_start", "char_end"), ("type",), ("page_no", *_BOX)).mapInArrow(run, schema)


def enclosed_boxes(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id, x0, y0, x1, y1: for each chunk (chunk_id, doc_id, page_no, char_start, char_end) the union of the boxes of
    the words of its page that lie inside it, nulls where there are none."""
    by = ["doc_id", "page_no"]
    c = chunks.select(*by, "chunk_id", "char_start", "char_end")
    w = words.select(*by, "char_start", "char_end", *[F.col(x).cast("double").alias(x) for x in _BOX])
    schema = f"chunk_id {c.schema['chunk_id'].dataType.simpleString()}, x0 double, y0 double, x1 double, y1 double"

    def batch(rows, box):
        return pa.RecordBatch.from_arrays([rows.column("_l").field("chunk_id"), *_sides(box)], names=["chunk_id", *_BOX])

    def run(batches):
        box, lost, last = np.zeros((0, 4)), [], None  # unions so far, of the step's chunks; chunks without a place

        def drained():
            while lost:
                rows = lost.pop()
                yield batch(rows, np.full((rows.num_rows, 4), np.nan))

        for s in _steps(batches, [], lost=lambda b: lost.append(b.filter(pc.equal(b.column("_side"), 0)))):
            yield from drained()
            n = len(s.at[0])
            box = np.concatenate([box, np.full((n - len(box), 4), np.nan)])
            boxes = _boxes(s)
            low, high = np.searchsorted(s.begin[1], s.begin[0], "left"), np.searchsorted(s.begin[1], s.close[0], "right")
            low[: s.held[0]] = np.maximum(low[: s.held[0]], s.held[1])
            for i, j in _stretches(low, high):
                inside = s.close[1][j] <= s.close[0][i]
                i, j = i[inside], j[inside]
                if len(i):
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    own, more = i[first], _united(boxes[j], first)
                    box[own] = np.concatenate([np.fmin(box[own, :2], more[:, :2]), np.fmax(box[own, 2:], more[:, 2:])], axis=1)
            stays = s.open[s.at[0]]
            if not stays.all():
                yield batch(s.rows.take(pa.array(s.at[0][~stays])), box[~stays])
            box, last = box[stays], s
        if len(box):
            yield batch(last.rows.take(pa.array(last.at[0][last.open[last.at[0]]])), box)
        yield from drained()

    return _dealt(c, w, by, ("char_start", "char_end"), ("char_start", "char_end"), carried=_BOX).mapInArrow(run, schema)
