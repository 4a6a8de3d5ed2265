"""Nearest vectors by cosine: an inverted file over cells, searched by its best cells first and then by those that a bound
cannot rule out, so that results are exact; the first step alone is the usual approximate search.

Centroids are fitted on a bounded sample, every row is indexed. A crowded cell is dealt out in blocks, queries in slices, and
each tile of both gives its best rows; no task holds more than a block and a slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Rows that centroids are fitted on, cells at most, rows of a block and queries of a slice.
SAMPLE, CELLS, BLOCK, SLICE = 20_000, 4096, 50_000, 20_000
#: Similarities are compared to so many decimals: what sums in another order differ in is far below.
DIGITS = 9


@dataclass
class Index:
    """rows: (cell, block, id, v), settled; a centroid, the widest angle and the number of blocks for each cell."""

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    blocks: np.ndarray


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(finite, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _units(column) -> np.ndarray:
    """Unit vectors of a list column whose lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; a cell that empties keeps its centroid."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def build(vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Index | None:
    """Index every vector that is not null, empty or zero and has finite components only; None where there is no such.

    Vectors of another length than most of the sample's are left out. cells: by default the root of the number of rows.
    """
    sound = _sound(vectors, id_col, vector_col)
    sample = sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    if not len(sample):
        return None
    lengths = [len(v) for v in sample.to_pylist()]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    rows = sound.where(F.size("v") == width)
    fitted = _units(sample.filter(pa.array([n == width for n in lengths])))
    centroids = fit(fitted, min(CELLS, cells or int(np.ceil(np.sqrt(rows.count())))))

    def place(batches):
        for b in batches:
            if b.num_rows:
                near = _units(b.column(1)) @ centroids.T
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "angle"])

    placed = settle(rows.mapInArrow(place, "id long, v array<double>, cell int, angle double"), "placed-vectors")
    reach, blocks = np.zeros(len(centroids)), np.zeros(len(centroids), dtype=np.int64)
    for cell, n, angle in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("angle")).collect():  # a row for each cell
        reach[cell], blocks[cell] = angle, -(-n // BLOCK)
    counts = placed.sparkSession.createDataFrame([(k, int(b)) for k, b in enumerate(blocks)], "cell int, blocks long")
    dealt = placed.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "v")
    return Index(settle(dealt, "vector-cells"), centroids, reach, blocks)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = True, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): the k rows nearest to each query by cosine, its own id left out; ties by id.

    The best ``probes`` cells are searched first. With ``exact``, every other cell that may hold a nearer row than the k-th
    found is searched too: its nearest possible row lies at the query's angle to the centroid less the cell's widest angle.
    """
    rows = settle(_sound(queries, id_col, vector_col).where(F.size("v") == index.centroids.shape[1]), "vector-queries")
    slices = max(1, -(-rows.count() // SLICE))
    blocks, centroids, reach = index.blocks, index.centroids, index.reach

    def ask(batches):
        """(query, slice, cell, block) tiles of the cells to search; least: what the k-th row found so far has, or null."""
        for b in batches:
            if not b.num_rows:
                continue
            near = _units(b.column(1)) @ centroids.T
            order = np.argsort(-near, axis=1, kind="stable")
            first = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            least = b.column(2).to_numpy(zero_copy_only=False)
            if b.column(3)[0].as_py():
                best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - reach, 0))
                wanted = ~first & (np.isnan(least)[:, None] | (best >= least[:, None] - 2 * 10.0**-DIGITS))
            else:
                wanted = first
            q, cell = np.nonzero(wanted & (blocks > 0))
            q, cell, block = np.repeat(q, blocks[cell]), np.repeat(cell, blocks[cell]), np.concatenate([np.arange(n) for n in blocks[cell]] or [np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int64))], names=["id", "v", "cell", "block"])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k)

    def found(asking: DataFrame) -> DataFrame:
        tiles = asking.mapInArrow(ask, "id long, v array<double>, cell int, block long").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
        held = index.rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("slice", F.col("slice").cast("long"))
        keys = ["cell", "block", "slice"]
        return held.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(tile, "query_id long, id long, similarity double")

    nothing = F.lit(None).cast("double")
    best = settle(found(rows.select("id", "v", nothing.alias("least"), F.lit(False).alias("rest"))), "nearest")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    if exact:
        kth = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("least"))
        again = rows.join(kth, "id", "left").select("id", "v", "least", F.lit(True).alias("rest"))
        best = best.unionByName(found(again))
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "similarity")


def _best(left: pa.Table, right: pa.Table, k: int, together: int = 256) -> pa.Table:
    """The k nearest rows of a block to each query of a slice."""
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    names = ["query_id", "id", "similarity"]
    if any("v" not in t.column_names or not t.num_rows for t in (left, right)):
        return pa.table([pa.array([], t) for t in kinds], names=names)
    left = left.sort_by("id")
    x, q = _units(left.column("v")), _units(right.column("v"))
    ids, asking = left.column("id").to_numpy(), right.column("id").to_numpy()
    out = []
    for at in range(0, len(q), together):
        near = np.round(q[at : at + together] @ x.T, DIGITS)
        near[asking[at : at + together, None] == ids] = -np.inf
        some = min(k, len(ids))
        least = np.partition(near, len(ids) - some, axis=1)[:, len(ids) - some]
        who, place = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        order = np.lexsort((place, -near[who, place], who))
        who, place = who[order], place[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, place = who[keep], place[keep]
        out.append((asking[at + who], ids[place], near[who, place]))
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names=names)
