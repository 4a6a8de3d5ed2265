"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's components become integer weights, so that a row is a sparse list of (term, weight). Candidates are dealt to
blocks and queries to slices; each block meets each slice in one task (a tile), where the block is turned into postings,
one list of (candidate, weight) a term. A few queries at a time, every term that they have scatters its weighted
postings into dense arrays of scores. Each tile selects its k best for each of its queries; Spark merges the tiles' rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components in a block, so that 65536 vectors of 64 make one, and in a slice.
BLOCK, SLICE = 1 << 22, 1 << 20
#: Blocks and slices that smaller tables are cut into as well, for the tasks' sake, where each has so many rows left.
LEAST_BLOCKS, LEAST_SLICES, LEAST_ROWS = 8, 4, 1000
#: Candidates and queries whose scores are summed together: an array that a core's cache holds.
TILE_ROWS, TILE_QUERIES = 2048, 64
_LONG = (1 << 63) - 1


def sound(v: Column) -> Column:
    """Vectors that take part: not null, all components finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, by score, then smaller vec_id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. The score is the
    inner product of the integers floor(scale * x). Vectors that are null or hold null or non-finite components take no
    part; an empty vector scores 0 with all. Of vectors of unlike lengths, what one lacks has no weight. Every repeat of a
    row is a query and a candidate of its own, so an id may find itself in its repeat. A row without an id is a candidate
    only, and last among equals. Scores are exact; one beyond a long counts as the nearest long. Fewer candidates than k:
    all of them. Other columns stay out.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(sound(F.col("v")))
    rows = written(clean.withColumn("row", F.monotonically_increasing_id()), "search-rows")
    is_query = F.col("vec_id") % every == 0
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    cut = lambda rows, room, least: max(1, -(-rows * width // room), min(least, rows // LEAST_ROWS))
    blocks, slices = cut(n, BLOCK, LEAST_BLOCKS), cut(asked, SLICE, LEAST_SLICES)
    at = lambda count: F.pmod(F.xxhash64("row"), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    tile = (F.col("block") * slices + F.col("slice")).alias("tile")
    candidates = rows.withColumn("block", at(blocks)).withColumn("slice", each(slices)).select(tile, "row", "vec_id", "v")
    queries = rows.where(is_query).withColumn("slice", at(slices)).withColumn("block", each(blocks)).select(tile, "row", "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tile(left, right, k, scale)

    best = candidates.groupBy("tile").cogroup(queries.groupBy("tile")).applyInArrow(run, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def weights(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Integer weights, rows x width, as int64, or as Python's integers where one doesn't fit."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    x = np.zeros((len(lists), width))
    x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    if not x.size or np.abs(x).max() < 2.0**48 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [[int(v) * scale if v.is_integer() else math.floor(v * scale) for v in row] for row in x.tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


def kind_of(a: np.ndarray, b: np.ndarray):
    """The narrowest integers that hold every inner product of a row of a and one of b, and all sums on the way."""
    if a.dtype == object or b.dtype == object:
        return object
    most = int((np.abs(a).max(axis=0).astype(object) * np.abs(b).max(axis=0).astype(object)).sum())
    return np.int32 if most < 1 << 31 else np.int64 if most <= _LONG else object


def postings(x: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """(candidates, weights) of each term; a list that most candidates are in is a whole column (candidates None)."""
    found = []
    for term in range(x.shape[1]):
        at = np.flatnonzero(x[:, term])
        found.append((None, np.ascontiguousarray(x[:, term])) if 2 * len(at) > len(x) else (at, x[at, term]))
    return found


def accumulate(lists: list, queries: np.ndarray, scores: np.ndarray) -> None:
    """Add every query's terms, one after another, to the scores (candidates x queries)."""
    room = np.empty_like(scores)
    for term, (at, w) in enumerate(lists):
        q = queries[:, term]
        has = np.flatnonzero(q)
        if not len(has) or not len(w):
            continue
        if 2 * len(has) < len(q):  # few of these queries have the term
            scores[np.ix_(np.arange(len(scores)) if at is None else at, has)] += w[:, None] * q[has][None]
        elif at is None:
            scores += np.multiply(w[:, None], q[None], out=room)
        else:
            scores[at] += np.multiply(w[:, None], q[None], out=room[: len(at)])


def _tile(left: pa.Table, right: pa.Table, k: int, scale: int) -> pa.Table:
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    if any("v" not in t.column_names or not t.num_rows for t in (left, right)):  # a side without rows may come without columns
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last, so positions break ties
    width = max(max(t.column("v").combine_chunks().value_lengths().to_numpy().max() for t in (left, right)), 1)
    x, q = weights(left.column("v"), width, scale), weights(right.column("v"), width, scale)
    kind = kind_of(x, q)
    x, q = x.astype(kind), q.astype(kind)
    own, asking = left.column("row").to_numpy(), right.column("row").to_numpy()
    lists = [(a, min(a + TILE_ROWS, len(x)), postings(x[a : a + TILE_ROWS])) for a in range(0, len(x), TILE_ROWS)]
    found = []
    for at in range(0, len(q), TILE_QUERIES):
        some = q[at : at + TILE_QUERIES]
        scores = np.zeros((len(x), len(some)), dtype=kind)
        for a, b, block in lists:
            accumulate(block, some, scores[a:b])
        if kind is object:
            scores = np.clip(scores, -_LONG - 1, _LONG).astype(np.int64)
        who, place, score = select(np.ascontiguousarray(scores.T), min(k + 1, len(x)))
        other = own[place] != asking[at + who]
        who, place, score = who[other], place[other], score[other]
        first = np.searchsorted(who, who)  # where a query's rows begin
        keep = np.arange(len(who)) - first < k
        found.append((at + who[keep], place[keep], score[keep]))
    who, place, score = (np.concatenate(c) for c in zip(*found))
    ids = right.column("vec_id").take(pa.array(who)), left.column("vec_id").take(pa.array(place))
    return pa.table([pa.array(asking[who]), ids[0], pa.array(own[place]), ids[1], pa.array(score.astype(np.int64))], names=names)


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, score) of the k best of each row, best first, ties by position."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    who, place = np.nonzero(scores >= least[:, None])
    score = scores[who, place].astype(np.int64)
    order = np.lexsort((place, ~score, who))  # ~score falls as score grows, and never overflows
    who, place, score = who[order], place[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], place[keep], score[keep]
