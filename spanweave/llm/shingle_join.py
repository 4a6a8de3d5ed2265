"""Near copies: SimHash links first, then an exact join of word shingles for what fingerprints may miss.

1. One pass over the texts gives every row's SimHash and parity bits, and its distinct shingles to the buckets that
   count them, as sorted 32-bit numbers; the buckets answer in how many rows each occurs.
2. Of a row's n shingles in the order (rows that have it, hash), the first n - ceil(0.8 n) + 1 are its prefix, and two
   rows of similarity 0.8 share a shingle of both prefixes. Shingles that no other row has come first and link nothing,
   so a text of which a fifth is its own takes no part, however common the rest.
3. Links of fingerprints by the generalised pigeonhole (``simhash``), and chains through the rows of each shared shingle,
   are verified by the Jaccard similarity of the texts' distinct shingles. They make first groups, so that the pairs
   within a large group of copies are never all looked at.
4. Rows of different groups that share a shingle of both prefixes are held against parity bits, whose differing bits
   never outnumber the shingles that only one of the two has. Every group's likeliest pair at a shingle is verified, and
   the links found join groups, in a few rounds; a row that meets no other group at a shingle leaves that shingle.
5. All pairs that still lie in different groups are verified. So no similar pair is missed, and a row that a large group
   of near copies could take in by any of its rows meets them all only where the rounds found no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import buckets, pack, small, unpack, written
from .graph import connected_components

_BITS = 1024
#: Shingles of a block, and rows of one at most.
_BLOCK, _ROWS = 1 << 20, 1 << 16
#: Rounds at most in which groups are joined by their likeliest pairs before all pairs left are verified.
_ROUNDS = 3
#: Keys that may be broadcast: some 10 MB.
_FEW = 200_000
_SIGN = "row long, doc_id long, h1 long, h2 long, n int, fp long, bits binary"
_STATE = "block long, part int, payload binary"
_PREFIX = "h long, row long, size_place long"
_MEETING = f"{_PREFIX}, other long"


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct XXH64 hashes of word shingles, ascending; a shorter text is one shingle, one without words none."""
    return np.unique(simhash.shingle_hashes(text or "", words).view(np.int64))


def _similar(common, a, b):
    """Whether ``common`` of a and b shingles make a Jaccard similarity of 0.8: 5 c >= 4 (a + b - c)."""
    return 9 * common >= 4 * (a + b)


def parity(own: np.ndarray) -> bytes:
    """_BITS bits: for each bit, whether an odd number of the shingles falls on it."""
    counts = np.bincount((own.view(np.uint64) % _BITS).astype(np.int64), minlength=_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers of 4 bytes by their first, second .. bytes, packed."""
    return pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block_rows(block: int, first: int, own: list[np.ndarray], parts: int):
    """A block as rows: part -1 tells which of its rows each shingle is of, part p has the sorted shingles of bucket p."""
    h = np.concatenate(own).view(np.uint64) if own else np.empty(0, dtype=np.uint64)
    n = np.array([len(x) for x in own], dtype=np.int64)
    doc = np.repeat(np.arange(len(own)), n)
    part, slot = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((slot, part))
    part, slot, doc = part[order], slot[order], doc[order]
    yield block, -1, b"".join(len(x).to_bytes(8, "little") + x for x in (first.to_bytes(8, "little", signed=True), _planes(n), _planes(doc)))
    cuts = np.flatnonzero(np.diff(part)) + 1
    for own_part, own_slot in zip(np.split(part, cuts), np.split(slot, cuts)):
        if len(own_part):
            yield block, int(own_part[0]), _planes(np.diff(own_slot, prepend=0))


def _unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def signatures(docs: DataFrame, words: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(signs, blocks): of every row of ``docs`` (doc_id, text) with words a number, its text's hashes, fingerprint and
    parity bits; and the blocks of rows as ``_block_rows`` has them."""
    schema = f"{_STATE}, {_SIGN}"
    names = [f.split()[0] for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        task = TaskContext.get().partitionId()
        at, seq, first, own, size = task << 33, 0, task << 33, [], 0
        for b in small(batches):
            rows = []
            for doc_id, text, h1, h2 in zip(*(c.to_pylist() for c in b.columns)):
                values = simhash.shingle_hashes(text or "", words)
                if not len(values):
                    continue
                own.append(np.unique(values.view(np.int64)))
                size += len(own[-1])
                rows.append((None, None, None, at, doc_id, h1, h2, len(own[-1]), simhash._signed(simhash.majority(values)), parity(own[-1])))
                at += 1
                if size >= _BLOCK or len(own) >= _ROWS:
                    yield batch([(*x, *[None] * 7) for x in _block_rows(task << 32 | seq, first, own, parts)])
                    seq, first, own, size = seq + 1, at, [], 0
            if rows:
                yield batch(rows)
        if own:
            yield batch([(*x, *[None] * 7) for x in _block_rows(task << 32 | seq, first, own, parts)])

    every = written(docs.select("doc_id", "text", *_text_hashes()).mapInArrow(run, schema), "signatures")
    return every.where("row IS NOT NULL").select(*names[3:]), every.where("row IS NULL").select(*names[:3])


def prefixes(blocks: DataFrame) -> DataFrame:
    """(h, row, size_place): the shingles of every row's prefix that other rows have too; size * 2^32 + place in the order."""

    def count(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_whole(x), dtype=np.int64) for x in table.column("payload").to_pylist()]
        _, where, rows = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        rows = np.minimum(rows, 255).astype(np.uint8)[where]
        out, at = [], 0
        for own in lists:
            n = rows[at : at + len(own)]
            at += len(own)
            shared = own[n > 1]
            out.append(b"".join(len(x).to_bytes(8, "little") + x for x in (pack(n.tobytes()), _planes(np.diff(shared, prepend=0)))))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array(out, pa.binary())})

    def order(table: pa.Table) -> pa.Table:
        answers = dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))
        first, n, doc = _unframe(answers.pop(-1))
        n, doc = _whole(n).astype(np.int64), _whole(doc).astype(np.int64)
        counts, hashes = [], []
        for part in sorted(answers):
            c, shared = _unframe(answers[part])
            c = np.frombuffer(unpack(c), np.uint8)
            h = np.zeros(len(c), dtype=np.int64)
            h[c > 1] = part << 32 | np.cumsum(_whole(shared), dtype=np.int64)
            counts.append(c)
            hashes.append(h)
        counts, hashes = np.concatenate(counts), np.concatenate(hashes)
        by = np.lexsort((hashes, counts, doc))
        doc, counts, hashes = doc[by], counts[by], hashes[by]
        place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
        keep = (counts > 1) & (place < n[doc] - (4 * n[doc] + 4) // 5 + 1)
        rows = int.from_bytes(first, "little", signed=True) + doc[keep]
        return pa.table({"h": pa.array(hashes[keep], pa.int64()), "row": pa.array(rows, pa.int64()), "size_place": pa.array((n[doc[keep]] << 32) + place[keep], pa.int64())})

    answers = blocks.where("part >= 0").groupBy("part").applyInArrow(count, _STATE)
    both = blocks.where("part < 0").unionByName(answers)
    return written(both.groupBy("block").applyInArrow(order, _PREFIX), "prefixes")


def _text_hashes():
    """Two 64-bit hashes by which a row's text is known again."""
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2")


def _meeting(h, size_place, group, bits):
    """Places (a, b) of rows of different groups that share a shingle (h is sorted) and may still be similar by sizes,
    places and parity bits, with the most shingles they can share; no place comes twice in one ``a`` or one ``b``."""
    n, place = size_place >> 32, size_place & 0xFFFFFFFF
    at, gap = np.arange(len(h)), 0
    while True:
        gap += 1
        at = at[at + gap < len(h)]
        at = at[h[at] == h[at + gap]]
        if not at.size:
            break
        a, b = at, at + gap
        fit = (group[a] != group[b]) & _similar(np.minimum(n[a] - place[a], n[b] - place[b]), n[a], n[b])
        a, b = a[fit], b[fit]
        common = (n[a] + n[b] - np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)) // 2
        fit = _similar(common, n[a], n[b])
        yield a[fit], b[fit], common[fit]


def _pairs(h, row, size_place, group, bits):
    """The pairs of rows that ``_meeting`` finds, in pieces."""
    out, held = [], 0
    for a, b, _ in _meeting(h, size_place, group, bits):
        out.append(np.stack([np.minimum(row[a], row[b]), np.maximum(row[a], row[b])]))
        held += len(a)
        if held >= 1 << 18:
            yield np.unique(np.concatenate(out, axis=1), axis=1)
            out, held = [], 0
    if held:
        yield np.unique(np.concatenate(out, axis=1), axis=1)


def _likeliest(h, row, size_place, group, bits):
    """The rows that ``_meeting`` finds, once a shingle; beside one of each group the row that it may share most with, and
    -1 beside the others. No more rows than were given."""
    n, share, other = size_place >> 32, np.zeros(len(h)), np.full(len(h), -1)
    for a, b, common in _meeting(h, size_place, group, bits):
        own = common / (n[a] + n[b])
        for x, y in ((a, b), (b, a)):
            more = own > share[x]
            share[x[more]], other[x[more]] = own[more], y[more]
    at = np.flatnonzero(other >= 0)
    at = at[np.lexsort((-share[at], group[at], h[at]))]
    leads = np.append(True, (h[at[1:]] != h[at[:-1]]) | (group[at[1:]] != group[at[:-1]]))[: len(at)]
    yield h[at], row[at], size_place[at], np.where(leads, row[other[at]], -1)


def _chains(h, row, size_place):
    """For every shingle (h is sorted, row within it) its rows in a chain, and all beside the first of them: links enough
    to group copies of one text, and no more than twice the rows."""
    n, place = size_place >> 32, size_place & 0xFFFFFFFF
    at = np.flatnonzero(h[1:] == h[:-1]) + 1
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    first = np.repeat(heads, np.diff(np.append(heads, len(h))))
    a, b = np.concatenate([at - 1, first[at]]), np.concatenate([at, at])
    fit = _similar(np.minimum(n[a] - place[a], n[b] - place[b]), n[a], n[b]) & (row[a] != row[b])
    return np.unique(np.stack([np.minimum(row[a], row[b])[fit], np.maximum(row[a], row[b])[fit]]), axis=1)


def _by_shingle(pairs_of, columns: int, names: tuple[str, ...] = ("a", "b")):
    """A function over batches sorted by their first column, h, that hands on whole shingles: no shingle is cut in two.
    names: the columns that ``pairs_of`` gives."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(min(columns, 4))]
            if columns > 4:
                new.append(np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.flatnonzero(held[0] != held[0][-1])
            if last.size and len(held[0]) >= 100_000:
                done = last[-1] + 1
                for p in pairs_of(*(x[:done] for x in held)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], names=names)
                held = [x[done:] for x in held]
        if held:
            for p in pairs_of(*held):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], names=names)

    return run


def _possible(batches):
    """Pairs (a, b, n, n, bits, bits) whose parity bits leave room for the similarity."""
    for b in small(batches, 10_000):
        n, m = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (4, 5))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(_similar((n + m - apart) // 2, n, m)))


def _verified(batches):
    for b in small(batches):
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            keep.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sides(pairs: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both rows: x_a, y_a .. after x_b, y_b .., dealt anew so that Spark may split a hub."""
    out = pairs
    for k in "ab":
        out = out.join(side.select(F.col("row").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in names]), k)
    return out.select("a", "b", *[f"{c}_{k}" for c in names for k in "ab"])


def _verify(pairs: DataFrame, docs: DataFrame, sign: DataFrame, words: int, screened: bool = False) -> DataFrame:
    """The pairs (a, b: rows of ``sign``) whose similarity is 0.8 or more; first by parity bits, unless they have been
    held against them, then by all shingles."""

    def sets(batches):
        for b in small(batches):
            packed = [shingles(t, words).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["h1", "h2", "hashes"])

    left = written(pairs if screened else _sides(pairs, sign, ["n", "bits"]).mapInArrow(_possible, "a long, b long"), "candidates")
    rows = left.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    named = written(sign.join(rows, "row", "left_semi").select("row", "h1", "h2"), "named")
    wanted = _light(named.select("h1", "h2").distinct())
    texts = docs.select(*_text_hashes(), "text").join(wanted, ["h1", "h2"], "left_semi")
    own = texts.mapInArrow(sets, "h1 long, h2 long, hashes binary").dropDuplicates(["h1", "h2"])
    own = written(named.join(own, ["h1", "h2"]).select("row", "hashes"), "shingles")
    return _sides(left, own, ["hashes"]).mapInArrow(_verified, "a long, b long")


def _light(keys: DataFrame) -> DataFrame:
    """Keys to hold texts against: broadcast where they are few, as counted; else Spark deals out both sides."""
    return F.broadcast(keys) if keys.count() <= _FEW else keys


def _groups(links: DataFrame) -> DataFrame:
    return written(connected_components(links), "groups").withColumnRenamed("node", "row")


def _grouped(prefix: DataFrame, sign: DataFrame, group: DataFrame) -> DataFrame:
    """Rows of ``prefix`` with their group, if they have one, and their parity bits, by shingle."""
    rows = prefix.join(sign.select("row", "bits"), "row").join(group, "row", "left")
    return rows.select("h", "row", "size_place", F.coalesce("component", "row").alias("group"), "bits").repartition("h").sortWithinPartitions("h")


def similar_links(docs: DataFrame, words: int = 5, radius: int = 4) -> tuple[DataFrame, DataFrame]:
    """(signatures, links): links (a, b) between rows of the signatures join all that a chain of pairs with a Jaccard
    similarity of 0.8 or more joins, and no others. Every link is such a pair."""
    sign, blocks = signatures(docs, words, buckets(docs))
    prefix = prefixes(blocks)
    distinct = written(sign.groupBy("fp").agg(F.min("row").alias("rep")), "distinct")
    same = sign.join(distinct, "fp").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    near = simhash.link_fingerprints(distinct, radius)
    chains = prefix.repartition("h").sortWithinPartitions("h", "row").mapInArrow(_by_shingle(lambda *x: [_chains(*x)], 3), "a long, b long")
    close = written(_verify(near.unionByName(same).unionByName(chains).distinct(), docs, sign, words), "close-links")
    meeting, group = prefix, _groups(close)
    names = tuple(f.split()[0] for f in _MEETING.split(", "))
    for _ in range(_ROUNDS):
        meeting = written(_grouped(meeting, sign, group).mapInArrow(_by_shingle(_likeliest, 5, names), _MEETING), "meeting")
        pairs = meeting.where("other >= 0").select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))
        found = written(_verify(pairs.distinct(), docs, sign, words, screened=True), "bridges")
        if found.isEmpty():
            break
        close = close.unionByName(found)
        group = _groups(close)
    pairs = _grouped(meeting, sign, group).mapInArrow(_by_shingle(_pairs, 5), "a long, b long")
    rest = _verify(pairs.distinct(), docs, sign, words, screened=True)
    return sign, close.unionByName(written(rest, "other-links"))


def drop_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) but for those that another row of their group stands for.

    Rows group by chains of pairs that share 0.8 or more of their distinct ``words``-word shingles (Jaccard). Of a group
    the row of the smallest id stays, one with a null id only where all are null. Rows without words are no copies of
    anything; of rows equal in id and text one stays; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sign, links = similar_links(base, words)
    found = written(connected_components(links), "components")
    named = found.join(sign.select("row", "doc_id", "h1", "h2"), found.node == F.col("row")).select("component", "row", "doc_id", "h1", "h2")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("best"))
    ranked = named.join(best, "component").withColumn("own", F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2"))
    # a key of a group goes, unless it is the one that stays; a key that several rows have stays once
    judged = ranked.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    judged = written(judged.agg(F.max(F.col("own").eqNullSafe(F.col("best"))).alias("_stays"), F.count(F.lit(1)).alias("_rows")), "judged")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_null": F.col("doc_id").isNull(), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit("second"), text)})
    keys = ["_id", "_null", "_h1", "_h2"]
    once = keyed.join(_light(judged.where("NOT _stays OR _rows > 1").select(*keys)), keys, "left_anti")
    again = keyed.join(_light(judged.where("_stays AND _rows > 1").select(*keys)), keys, "left_semi").dropDuplicates(keys)
    return once.unionByName(again).select(*docs.columns)
