"""Embedding near-dedup by an epsilon grid order join.

Equal vectors are collapsed first. The others are turned into principal axes, given grid cells of side epsilon on the
leading ones and sorted by cell; the order is cut into intervals, whose bounding boxes form a tree. A box has the leading
axes and one more, the length of the rest of a vector. Pairs of intervals are joined recursively: a pair whose boxes are
further apart than epsilon is skipped, any other is opened into its children's pairs, down to leaves, which are sent to
one task, and to blocks within leaves, where cosines are computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .graph import connected_components

_LINK = "kind int, a long, b long"


def _sound(v) -> F.Column:
    """Vectors that can link: not empty, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _axes(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of all unit vectors; only sums of width x width reach the driver."""

    def run(batches):
        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for b in small(batches, 4000):
            x = _unit(b.column(0))
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width + width + 1)), pa.array(np.concatenate([q.ravel(), s, [n]]))], names=["k", "v"])

    got = dict(classes.select("v").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    flat = np.array([got[k] for k in range(len(got))])
    n, s, q = max(flat[-1], 1), flat[width * width : -1], flat[: width * width].reshape(width, width)
    mean = s / n
    _, axes = np.linalg.eigh(q / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def _unit(column) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array(column.to_pylist(), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, least: float = 0.9, leaf: int = 4000, fan: int = 4, leading: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link at cosine ``least`` or more, in double precision. Null, empty or zero vectors and those with null or
    non-finite components link with nothing; vectors of unlike lengths do not link. Every repeat of a row is a vector
    of its own. An unlinked row is its own component; a null id has a null component unless it is linked to one that
    has an id. An empty table gives an empty result. ``leaf``: rows of a leaf, ``fan``: children of an interval,
    ``leading``: axes on which boxes are compared.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    grouped = rows.where(_sound(F.col("v"))).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # a class of equal vectors has a number of its own, as it may have no id
    classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "vector-classes")
    links = spark.createDataFrame([], _LINK)
    for width in sorted(r[0] for r in classes.select("width").distinct().collect()):  # as many as there are models
        links = links.unionByName(_links(classes.where(F.col("width") == width), width, least, leaf, fan, leading))
    links = written(links, "vector-links")
    counts = links.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))
    found = connected_components(links.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cls")
    ids = found.join(classes.select("cls", "rep"), "cls")
    least_ids = ids.groupBy("component").agg(F.min("rep").alias("least_id"))
    own = found.join(least_ids, "component").select("cls", "least_id")
    named = classes.join(counts, "cls", "left").join(own, "cls", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least_id", "rep").alias("component_id")
    )
    out = rows.join(named, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _place(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places on the leading axes, and the length of what is left of a vector beyond them. Two vectors are at least as
    far apart as these are."""
    y = x - mean
    lead = y @ axes
    rest = np.sqrt(np.maximum((y * y).sum(axis=1) - (lead * lead).sum(axis=1), 0))
    return np.column_stack([lead, rest])


def _links(classes: DataFrame, width: int, least: float, leaf: int, fan: int, leading: int) -> DataFrame:
    """kind 0: class a is linked to b rows of other classes; kind 1: a and b are linked (a spanning forest of each leaf pair)."""
    spark = classes.sparkSession
    eps = float(np.sqrt(max(2 - 2 * least, 0)))
    lead = min(leading, width)
    mean, axes = _axes(classes, width)
    axes = axes[:, :lead]
    kind = np.dtype("<f4") if classes.schema["v"].dataType.elementType.typeName() == "float" else np.dtype("<f8")

    def place(batches):
        for b in small(batches, 4000):
            x = _place(_unit(b.column(0)), mean, axes)
            cells = np.floor(x[:, :lead] / max(eps, 1e-9)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["v", "cls", "copies", "cell", "x"])

    placed = classes.select("v", "cls", "copies").mapInArrow(place, f"v {classes.schema['v'].dataType.simpleString()}, cls long, copies long, cell array<int>, x array<double>")
    tasks = max(1, -(-classes.count() // (8 * leaf)))
    ordered = placed.repartitionByRange(tasks, "cell", "cls").sortWithinPartitions("cell", "cls")

    def cut(batches):
        """Leaves of a task: rows as they come in grid order, at most ``leaf`` together."""
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, []

        def out(table):
            x = np.array(table.column("x").to_pylist())
            one = lambda a, t: pa.array([a], t)
            doubles = pa.list_(pa.float64())
            raw = np.array(table.column("v").to_pylist(), dtype=kind).tobytes()
            ids = np.array([table.column("cls").to_pylist(), table.column("copies").to_pylist()], dtype="<i8").tobytes()
            return pa.RecordBatch.from_arrays([one(task << 32 | seq, pa.int64()), one(x.min(axis=0).tolist(), doubles), one(x.max(axis=0).tolist(), doubles), one(raw, pa.binary()), one(ids, pa.binary())], names=["place", "low", "high", "raw", "ids"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= leaf:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, leaf))
                seq += 1
                held = table.slice(leaf).to_batches()
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    cut_rows = written(ordered.mapInArrow(cut, "place long, low array<double>, high array<double>, raw binary, ids binary"), "vector-leaves")
    # number leaves in order without gathering them: counts of tasks first, then positions inside a task
    starts = cut_rows.groupBy((F.col("place") / (1 << 32)).cast("long").alias("task")).count().collect()  # one row for each task of the sort
    base = spark.createDataFrame(_running(starts), "task long, base long")
    leaves = cut_rows.join(F.broadcast(base), (F.col("place") / (1 << 32)).cast("long") == F.col("task")).select((F.col("base") + F.col("place").bitwiseAND(0xFFFFFFFF)).alias("id"), "low", "high", "raw", "ids")
    total = sum(r["count"] for r in starts)
    boxes = [leaves.select("id", "low", "high")]
    reach = 1
    while reach < total:
        reach *= fan
        up = boxes[-1].withColumn("up", (F.col("id") / fan).cast("long"))
        merged = up.groupBy("up").agg(*[F.min(F.col("low")[k]).alias(f"l{k}") for k in range(lead + 1)], *[F.max(F.col("high")[k]).alias(f"h{k}") for k in range(lead + 1)])
        boxes.append(written(merged.select(F.col("up").alias("id"), F.array(*[f"l{k}" for k in range(lead + 1)]).alias("low"), F.array(*[f"h{k}" for k in range(lead + 1)]).alias("high")), "vector-boxes"))
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    steps = F.sequence(F.lit(0), F.lit(fan - 1))
    for level in reversed(boxes[:-1]):
        opened = pairs.select(F.col("a"), F.col("b"), F.explode(steps).alias("i")).select("a", "b", "i", F.explode(steps).alias("j"))
        opened = opened.select((F.col("a") * fan + F.col("i")).alias("a"), (F.col("b") * fan + F.col("j")).alias("b")).where("a <= b")
        left = level.select(F.col("id").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
        right = level.select(F.col("id").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        gap = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        pairs = written(opened.join(left, "a").join(right, "b").where(apart <= (eps + 1e-9) ** 2).select("a", "b"), "vector-pairs")

    def join(batches):
        for b in small(batches, 4):
            raw_a, ids_a, raw_b, ids_b, same = (b.column(i).to_pylist() for i in range(5))
            for ra, ia, rb, ib, one in zip(raw_a, ids_a, raw_b, ids_b, same):
                yield from _leaf_pair(_leaf(ra, ia, kind, width, mean, axes), _leaf(rb, ib, kind, width, mean, axes), one, least, eps)

    left = leaves.select(F.col("id").alias("a"), F.col("raw").alias("ra"), F.col("ids").alias("ia"))
    right = leaves.select(F.col("id").alias("b"), F.col("raw").alias("rb"), F.col("ids").alias("ib"))
    both = pairs.join(left, "a").join(right, "b").select("ra", "ia", "rb", "ib", (F.col("a") == F.col("b")).alias("same"))
    return written(both.mapInArrow(join, _LINK), "vector-leaf-links")


def _running(rows) -> list[tuple[int, int]]:
    out, total = [], 0
    for task, n in sorted(tuple(r) for r in rows):
        out.append((task, total))
        total += n
    return out or [(0, 0)]


#: Rows of a block, the last interval that the recursion opens.
BLOCK = 128


def _leaf(raw: bytes, ids: bytes, kind, width: int, mean, axes):
    """Unit vectors of a leaf, its class numbers and copies, and the boxes of its blocks."""
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = _place(x, mean, axes)
    starts = np.arange(0, len(x), BLOCK)
    return x, *np.frombuffer(ids, dtype="<i8").reshape(2, -1), np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)


def near_blocks(low_a, high_a, low_b, high_b, eps: float) -> np.ndarray:
    """Which pairs of boxes are not provably further apart than eps."""
    gap = np.maximum(np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]), 0)
    return (gap * gap).sum(axis=2) <= (eps + 1e-9) ** 2


def _leaf_pair(a, b, same: bool, least: float, eps: float):
    (x, cls_x, copies_x, low_x, high_x), (y, cls_y, copies_y, low_y, high_y) = a, b
    from_x, from_y, edges = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64), []
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = v = parent.get(p, p)
        return v

    for k, near in enumerate(near_blocks(low_x, high_x, low_y, high_y, eps)):
        blocks = np.flatnonzero(near)
        blocks = blocks[blocks >= k] if same else blocks
        if not blocks.size:
            continue
        at = k * BLOCK
        own = np.concatenate([np.arange(j * BLOCK, min(j * BLOCK + BLOCK, len(y))) for j in blocks])
        i, j = np.nonzero(x[at : at + BLOCK] @ y[own].T >= least)
        i, j = i + at, own[j]
        if same:
            i, j = i[i < j], j[i < j]
        np.add.at(from_x, i, copies_y[j])
        np.add.at(from_y, j, copies_x[i])
        for p, q in zip(cls_x[i].tolist(), cls_y[j].tolist()):
            u, v = root(p), root(q)
            if u != v:
                parent[max(u, v)] = min(u, v)
                edges.append((p, q))
    first = np.concatenate([cls_x[from_x > 0], cls_y[from_y > 0], np.array([e[0] for e in edges], dtype=np.int64)])
    second = np.concatenate([from_x[from_x > 0], from_y[from_y > 0], np.array([e[1] for e in edges], dtype=np.int64)])
    kinds = np.concatenate([np.zeros(len(first) - len(edges), dtype=np.int32), np.ones(len(edges), dtype=np.int32)])
    if len(first):
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(first), pa.array(second)], names=["kind", "a", "b"])
