"""Vector code compression: product codes whose codebooks come from delta-maintained Lloyd rounds.

A vector of integers is cut into equal parts; each part position has a codebook. A round assigns every part to its
nearest entry and keeps the assignment beside the vector in a table. What an entry has gathered, a count and integer sums,
is kept from round to round: only parts whose assignment changed since the round before give a minus to the entry that
they left and a plus to the one that they joined. Tasks add these up before the shuffle, so that a round moves at most a
row for each entry and task, and the driver holds the codebooks and their sums, whose size is fixed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .topk_postings import sound, weights

_LONG = (1 << 63) - 1
#: Sums are exact while a component is below this; no float32 vector of use comes near it.
_MOST = 10**26
_OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector that is sound.

    Vectors that are null or hold null or non-finite components go. Components become floor(scale * x). A codebook starts
    as that part of the ``entries`` smallest ids (null ids come last, repeats of an id by their components; fewer vectors:
    all of them). Distances are squared and exact, ties go to the lower index, also where entries are equal; new entries
    are floor(sum / count), unused ones stay. ``error``: final squared distances summed over parts; ``label_error``: errors
    summed over equal labels, nulls together; one beyond a long counts as the largest long. Vectors of unlike lengths, or
    of a length that ``parts`` doesn't divide, count as zeros beyond their end. A component of 10^26 or more fails the job.
    An empty table gives an empty result. Other columns stay out. ``entries`` is at most 256.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(sound(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], _OUT)
    width = max(-(-width // parts), 1) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()  # a documented, fixed number
    books = _split(weights(first.column("v"), width, scale), parts)
    sums = [[[0, [0] * (width // parts)] for _ in book] for book in books]
    now = rows.withColumn("code", F.lit(None).cast("binary"))
    for _ in range(rounds):
        now = written(_assigned(now, books, width, scale, ["vec_id", "label", "v"]), "vector-codes")
        _carry(sums, _deltas(now, len(books), width, scale))
        books = [_means(book, at) for book, at in zip(books, sums)]
    last = written(_assigned(now, books, width, scale, ["vec_id", "label"]), "vector-codes").drop("was")
    digest = hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()
    capped = lambda c: F.least(c, F.lit(_LONG)).cast("long")
    totals = last.groupBy("label").agg(capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    named = last.join(totals.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    return named.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest among equals, and its squared distance; exact at any size."""
    most = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    room = 4 * most * most * max(x.shape[1], 1)  # above every number on the way
    kind = np.float64 if room < 1 << 53 else np.int64 if room <= _LONG else object
    x, book = x.astype(kind), book.astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None]
    at = np.argmin(far, axis=1)
    least = far[np.arange(len(x)), at]
    return at.astype(np.uint8), least if kind is object else least.astype(np.int64)


def _assigned(rows: DataFrame, books: list[np.ndarray], width: int, scale: int, keep: list[str]) -> DataFrame:
    """``keep``, the code of the round before (was), the new one and the squared distance."""

    def run(batches):
        for b in small(batches, 4000):
            x = _split(weights(pa.chunked_array([b.column(b.schema.get_field_index("v"))]), width, scale), len(books))
            found = [nearest(part, book) for part, book in zip(x, books)]
            codes = np.stack([f[0] for f in found], axis=1)
            error = sum(f[1].astype(object) for f in found)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), b.column(b.schema.get_field_index("code")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(e, _LONG) for e in error], pa.int64())], names=[*keep, "was", "code", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{fields}, was binary, code binary, error long")


def _deltas(rows: DataFrame, parts: int, width: int, scale: int) -> list:
    """(part, entry, count, sums) by which what entries gather changes, from the parts whose assignment changed."""

    def run(batches):
        gathered: dict[tuple[int, int], np.ndarray] = {}
        for b in small(batches, 4000):
            x = weights(pa.chunked_array([b.column(0)]), width, scale)
            if x.dtype == object and max(abs(x.min()), abs(x.max())) >= _MOST:
                raise OverflowError("a component is too large for exact sums")
            new = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            had = np.array(b.column(1).is_valid())
            old = np.frombuffer(b"".join(c or bytes(parts) for c in b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            moved = (new != old) | ~had[:, None]
            for p, part in enumerate(_split(x, parts)):
                for sign, codes, some in ((1, new[:, p], moved[:, p]), (-1, old[:, p], moved[:, p] & had)):
                    for e in np.unique(codes[some]):
                        own = part[some & (codes == e)].astype(object if part.dtype == object else np.int64)
                        change = sign * np.array([len(own), *own.sum(axis=0)], dtype=object)
                        gathered[p, int(e)] = gathered.get((p, int(e)), 0) + change
        keys = list(gathered)
        kind = pa.decimal128(38)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([[int(x) for x in gathered[k]] for k in keys], pa.list_(kind))], names=["part", "entry", "change"])

    changed = rows.where("was IS NULL OR was <> code").select("v", "was", "code").mapInArrow(run, "part int, entry int, change array<decimal(38,0)>")
    size = width // parts + 1
    total = changed.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("change")[k]) for k in range(size)]).alias("change"))
    return total.collect()  # at most a row for each entry of the codebooks


def _carry(sums: list, changes: list) -> None:
    for part, entry, change in changes:
        at = sums[part][entry]
        at[0] += int(change[0])
        at[1] = [a + int(c) for a, c in zip(at[1], change[1:])]


def _means(book: np.ndarray, sums: list) -> np.ndarray:
    """Entries as the floor of their parts' means; those that no part has stay."""
    made = [[s // n for s in total] if n else row for row, (n, total) in zip(book.tolist(), sums)]
    return np.array(made, dtype=object if any(abs(x) > _LONG for row in made for x in row) else np.int64).reshape(book.shape)
