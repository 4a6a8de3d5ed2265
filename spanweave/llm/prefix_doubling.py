"""Repeated-substring removal by distributed prefix doubling over sampled suffix positions.

Suffixes are ranked at content-defined positions (anchors: minima of hashed 8-byte windows, so any 64 neighbouring
windows have one). Round by round the compared prefix grows: 100 bytes, then 200 by pairs (rank, rank where the first
prefix ended), then past the threshold of 400. In a round every block of documents sends its (position, rank pair) keys
to the bucket of the key, where they are sorted and those that are not unique get a new rank; unique positions drop out.

From ranks to bytes, exactly:
* a prefix of 400 bytes or more that occurs twice marks all 400-byte windows inside it;
* a window can only be repeated if the prefixes of all anchors well inside it are (their places depend on nothing
  outside the window), which clears nearly all other windows;
* the windows between, at the borders of repeated passages, are compared whole, together with those already known to be
  repeated whose first inner anchor has the same rank; of these the leading copy of a repeated prefix speaks for all.
Documents that occur twice as a whole need no comparison at their borders. Whole prefixes and documents are compared by
128-bit hashes, windows by 96 bits (of n windows, two that differ are taken for one with a chance of n^2 / 2^97: some
2 in 10,000 for the 6 * 10^12 windows at borders of 100 TB); ranks of shorter prefixes only prune.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import buckets, id_text, pack, small, unpack, written

#: Bytes of a hashed window, windows among which one is an anchor, and the first prefix.
GRAM, WINDOW, FIRST = 8, 64, 100

_STATE = "block long, part int, payload binary"
#: The bit of a rank that marks the copy that leads.
_LEADS = np.uint64(1 << 63)
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _frames(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts)


def _unframe(data: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.cumsum(np.frombuffer(data, dtype="<u8", count=n)).astype(np.int64)
    return [data[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(unpack(data), dtype=kind)


def anchors_of(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of anchors: rightmost minima of WINDOW neighbouring hashed windows that lie in one document."""
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, dtype=np.int64)
    grams = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span = 1
    while span < WINDOW:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    at = 0xFFFFFFFF - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(at), dtype=bool)
    for end in ends[:-1].tolist():  # windows that reach over a document's end
        inside[max(0, end - WINDOW - GRAM + 2) : end] = False
    at = at[inside]
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


class Block:
    """Documents of a block, their anchors, and what the rounds have found so far."""

    def __init__(self, payload: bytes, length: int):
        ids, null, sizes, data, at = _unframe(payload, 5)
        self.length = length
        self.ids, self.null = _array(ids, "<i8"), _array(null, "u1")
        self.sizes = _array(sizes, "<i4").astype(np.int64)
        self.raw = unpack(data)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.at = np.cumsum(_array(at, "<i4"), dtype=np.int64)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.large = np.flatnonzero(self.sizes >= length)
        n = len(self.at)
        self.edge = self.ends[self.doc] if n else self.at  # where a prefix that leaves its document counts as ending
        self.end1 = self._next(np.searchsorted(self.at, self.at + FIRST))
        self.pos1 = self._place(self.end1)
        self.end2 = np.where(self.end1 >= 0, self.end1[self.end1], -1) if n else self.end1
        self.pos2 = self._place(self.end2)

    def _next(self, index: np.ndarray) -> np.ndarray:
        ok = index < len(self.at)
        ok[ok] = self.doc[index[ok]] == self.doc[ok]
        return np.where(ok, index, -1)

    def _place(self, end: np.ndarray) -> np.ndarray:
        return np.where(end >= 0, self.at[end], self.edge) if len(end) else end

    def keys1(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.end1 >= 0)
        h, raw = xxhash.xxh3_64_intdigest, self.raw
        hi = np.array([h(raw[a:b]) for a, b in zip(self.at[own].tolist(), self.pos1[own].tolist())], dtype=np.uint64)
        return own, np.concatenate([np.stack([hi, np.zeros_like(hi)]), self.hashes(self.starts[self.large].tolist(), self.ends[self.large].tolist())], axis=1)

    def keys2(self, rank1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.end2 >= 0)
        own = own[(rank1[own] > 0) & (rank1[self.end1[own]] > 0)]
        return own, np.stack([rank1[own], rank1[self.end1[own]]])

    def cover(self, rank2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors whose prefix can be led past the threshold by a second rank, and where it ends."""
        own = np.flatnonzero(rank2 > 0)
        second = np.searchsorted(self.pos2, self.at[own] + self.length)
        ok = second < len(self.at)
        ok[ok] = rank2[second[ok]] > 0
        ok[ok] = (self.doc[second[ok]] == self.doc[own[ok]]) & (second[ok] <= self.end2[own[ok]])
        return own[ok], self.pos2[second[ok]]

    def keys3(self, rank2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, ends = self.cover(rank2)
        return own, self.hashes(self.at[own].tolist(), ends.tolist())

    def hashes(self, starts: list[int], ends: list[int], shift: int = 0) -> np.ndarray:
        h, raw = xxhash.xxh3_128_digest, self.raw
        found = np.frombuffer(b"".join([h(raw[a:b]) for a, b in zip(starts, ends)]), dtype="<u8").reshape(-1, 2).T
        return np.stack([found[0], found[1] >> np.uint64(shift)])

    def windows(self, rank1, rank2, long, whole) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows known to be repeated; starts to compare, their first inner anchors, and which are open."""
        size, n = self.length, len(self.raw)
        own, ends = self.cover(rank2)

        def inside(anchor, doc):
            steps = np.zeros(n + 1, dtype=np.int32)
            np.add.at(steps, self.at[own[anchor]], 1)
            np.add.at(steps, ends[anchor] - size + 1, -1)
            np.add.at(steps, self.starts[self.large[doc]], 1)
            np.add.at(steps, self.ends[self.large[doc]] - size + 1, -1)
            return np.cumsum(steps[:-1]) > 0

        sure = inside(long[own] > 0, whole > 0)
        leads = inside(long[own] >= _LEADS, whole >= _LEADS)
        p = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(self.starts.tolist(), self.ends.tolist()) if b - a >= size] or [np.empty(0, dtype=np.int64)])
        before = np.cumsum(np.bincount(self.at, minlength=n + 1), dtype=np.int64) if len(self.at) else np.zeros(n + 1, dtype=np.int64)
        first = before[np.minimum(p + WINDOW - 2, n)]  # anchors below p + WINDOW - 1, as positions are sorted
        p = p[first < len(self.at)]
        first = first[first < len(self.at)]
        keep = rank1[first] > 0
        p, first = p[keep], first[keep]
        last = p + size - WINDOW - GRAM + 1
        for rank, place, end in ((rank1, self.pos1, self.end1), (rank2, self.pos2, self.end2)):
            gone = np.concatenate(([0], np.cumsum((rank == 0) & (end >= 0))))
            reached = np.cumsum(np.bincount(place, minlength=n + 1), dtype=np.int64) if len(place) else np.zeros(n + 1, dtype=np.int64)
            upto = np.maximum(reached[last], first)  # prefixes that end at ``last`` or before it
            keep = gone[upto] == gone[first]
            p, first, last = p[keep], first[keep], last[keep]
        mine = ~sure[p] | leads[p]
        return np.flatnonzero(sure), p[mine], first[mine], ~sure[p[mine]]

    def results(self, starts: np.ndarray):
        steps = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.length, -1)
        gone = np.cumsum(steps[:-1]) > 0
        data = np.frombuffer(self.raw, dtype=np.uint8)
        for doc_id, null, a, b in zip(self.ids.tolist(), self.null.tolist(), self.starts.tolist(), self.ends.tolist()):
            own = gone[a:b]
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if len(own) else 0
            yield None if null else doc_id, b - a, int(own.sum()), spans, hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()


def _state(ids, null, texts: list[bytes]) -> bytes:
    raw = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype="<i4")
    at = anchors_of(np.frombuffer(raw, dtype=np.uint8), np.cumsum(sizes, dtype=np.int64))
    gaps = np.diff(at, prepend=0).astype("<i4")
    return _frames(pack(np.asarray(ids, dtype="<i8").tobytes()), pack(np.asarray(null, dtype="u1").tobytes()), pack(sizes.tobytes()), pack(raw), pack(gaps.tobytes()))


def _batch(rows: list[tuple[int, int, bytes]], kind=pa.RecordBatch):
    arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
    return kind.from_arrays(arrays, names=["block", "part", "payload"])


def _halves(values: np.ndarray) -> bytes:
    """64-bit values as their low and high halves, so that empty halves vanish in compression."""
    return pack(np.ascontiguousarray(values.view("<u4").reshape(-1, 2).T).tobytes())


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_array(data, "<u4").reshape(2, -1).T).view("<u8").ravel()


def _intervals(values: np.ndarray) -> bytes:
    """Ascending numbers as their unbroken runs."""
    heads = np.flatnonzero(np.append(True, np.diff(values) != 1)) if len(values) else np.empty(0, dtype=np.int64)
    return _frames(pack(values[heads].astype("<i8").tobytes()), pack(np.diff(np.append(heads, len(values))).astype("<i8").tobytes()))


def _members(data: bytes) -> np.ndarray:
    heads, sizes = (_array(x, "<i8") for x in _unframe(data, 2))
    return np.repeat(heads - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of 128-bit keys, and the group of each in that order."""
    order = np.lexsort((keys[1], keys[0]))
    hi, lo = keys[0][order], keys[1][order]
    return order, np.concatenate(([0], np.cumsum((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))


def _key_rows(block: int, keys: np.ndarray, parts: int, asks: np.ndarray | None = None):
    """A block's distinct keys by bucket, each with whether it occurs twice in the block or is asked for."""
    if not keys.shape[1]:
        return
    order, group = _sorted_groups(keys)
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    flags = (np.diff(np.append(lead, len(group))) > 1).astype(np.uint8)
    if asks is not None:
        flags |= 2 * np.maximum.reduceat(asks[order].astype(np.uint8), lead)
    hi, lo = keys[0][order[lead]], keys[1][order[lead]]
    bucket = ((hi ^ lo) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for own in np.split(by, cuts):
        yield block, int(bucket[own[0]]), _frames(pack(hi[own].tobytes()), _halves(lo[own]), pack(flags[own].tobytes()))


def _read_names(keys: np.ndarray, rows: dict[int, bytes], parts: int) -> np.ndarray:
    """The rank that each of a block's keys has got (0: unique), from the buckets' answers."""
    names = np.zeros(keys.shape[1], dtype=np.uint64)
    if not len(names):
        return names
    order, group = _sorted_groups(keys)
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    hi, lo = keys[0][order[lead]], keys[1][order[lead]]
    bucket = ((hi ^ lo) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    distinct = np.zeros(len(lead), dtype=np.uint64)
    distinct[np.argsort(bucket, kind="stable")] = np.concatenate([_array(rows[b], "<u8") for b in sorted(rows)])
    names[order] = distinct[group]
    return names


def _rank_buckets(keys: DataFrame, parts: int, asked: bool = False) -> DataFrame:
    """Sort each bucket's keys and answer every block: a new rank where a key is not unique (or is asked for), else 0."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lists = [_unframe(x, 3) for x in table.column("payload").to_pylist()]
        hi = [_array(x[0], "<u8") for x in lists]
        flags = np.concatenate([_array(x[2], "u1") for x in lists])
        keys = np.stack([np.concatenate(hi), np.concatenate([_whole(x[1]) for x in lists])])
        order, group = _sorted_groups(keys)
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        told = np.bitwise_or.reduceat(flags[order], lead)
        good = (told & 2 > 0) if asked else (np.diff(np.append(lead, len(group))) > 1) | (told & 1 > 0)
        rank = np.where(good, np.cumsum(good) * parts + part, 0).astype(np.uint64)
        out = np.zeros(len(group), dtype=np.uint64)
        out[order] = rank[group]
        out[order[lead[good]]] |= _LEADS
        cuts = np.cumsum([len(x) for x in hi])[:-1]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array([pack(x.tobytes()) for x in np.split(out, cuts)], pa.binary())})

    return keys.groupBy("part").applyInArrow(run, _STATE)


def remove_repeats(docs: DataFrame, length: int = 400, block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a ``length``-byte string (400 or more) that also starts elsewhere, in any document, is
    removed; strings never cross documents and are judged on the input. Null text counts as empty; a repeated row is
    another place; a null id stays null. An empty table gives an empty result.
    """
    if length < 400:
        raise ValueError("inner anchors are only guaranteed for strings of 400 bytes or more")
    parts = buckets(docs)

    def blocks(batches):
        task, seq, ids, null, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc_id or 0)
                null.append(doc_id is None)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield _batch([(task << 32 | seq, -1, _state(ids, null, texts))])
                    seq, ids, null, texts, size = seq + 1, [], [], [], 0
        if ids:
            yield _batch([(task << 32 | seq, -1, _state(ids, null, texts))])

    def first_keys(batches):
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                rows = list(_key_rows(block, Block(payload, length).keys1()[1], parts))
                if rows:
                    yield _batch(rows)

    def survivors(table: pa.Table) -> pa.Table:
        """Split a block into finished documents (part -2) and those with a repeated prefix (part -1, and ranks part -3)."""
        rows = dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))
        block, whole = table.column("block")[0].as_py(), Block(rows.pop(-1), length)
        own, keys = whole.keys1()
        names, rank = _read_names(keys, rows, parts), np.zeros(len(whole.at), dtype=np.uint64)
        rank[own] = names[: len(own)] & ~_LEADS
        twice = np.zeros(len(whole.sizes), dtype=np.uint64)
        twice[whole.large] = names[len(own) :]
        stay = np.zeros(len(whole.sizes), dtype=bool)
        stay[whole.doc[rank > 0]] = True
        texts = [whole.raw[a:b] for a, b in zip(whole.starts.tolist(), whole.ends.tolist())]
        gone = np.flatnonzero(~stay)
        sha = b"".join(hashlib.sha256(texts[i]).digest() for i in gone)
        out = [(block, -2, _frames(whole.ids[gone].astype("<i8").tobytes(), whole.null[gone].tobytes(), whole.sizes[gone].astype("<i8").tobytes(), sha))]
        if stay.any():
            keep = np.flatnonzero(stay)
            out.append((block, -1, _state(whole.ids[keep], whole.null[keep], [texts[i] for i in keep])))
            out.append((block, -3, _frames(pack(rank[stay[whole.doc]].tobytes()), pack(twice[keep].tobytes()))))
        return _batch(out, pa.Table)

    def round_of(step):
        """A round over the surviving blocks: their rows, and every earlier round's answers under ``level``."""

        def run(table: pa.Table) -> pa.Table:
            levels: dict[int, dict[int, bytes]] = {}
            for level, part, payload in zip(table.column("level").to_pylist(), table.column("part").to_pylist(), table.column("payload").to_pylist()):
                levels.setdefault(level, {})[part] = payload
            return step(table.column("block")[0].as_py(), levels)

        return run

    def ranks(levels, upto: int):
        block = Block(levels[0][-1], length)
        rank1, twice = (_array(x, "<u8") for x in _unframe(levels[0][-3], 2))
        rank2, long = np.zeros(len(block.at), dtype=np.uint64), np.zeros(len(block.at), dtype=np.uint64)
        if upto > 1:
            own, keys = block.keys2(rank1)
            rank2[own] = _read_names(keys, levels.get(2, {}), parts) & ~_LEADS
        if upto > 2:
            own, keys = block.keys3(rank2)
            long[own] = _read_names(keys, levels.get(3, {}), parts)
        return block, rank1, rank2, long, twice[block.large]

    def second(block_id, levels):
        block, rank1, *_ = ranks(levels, 1)
        return _batch(list(_key_rows(block_id, block.keys2(rank1)[1], parts)), pa.Table)

    def third(block_id, levels):
        block, _, rank2, *_ = ranks(levels, 2)
        return _batch(list(_key_rows(block_id, block.keys3(rank2)[1], parts)), pa.Table)

    def asking(block, rank1, *found):
        sure, p, first, asks = block.windows(rank1, *found)
        names = rank1[first]
        return sure, p, np.stack([names, np.zeros_like(names)]), asks

    def ask(block_id, levels):
        """A block's questions, and (part -4) what the later rounds start from, so that windows are looked for once."""
        sure, p, keys, asks = asking(*ranks(levels, 3))
        kept = _frames(_intervals(sure), pack(np.diff(p, prepend=0).astype("<u4").tobytes()), pack(keys[0].tobytes()))
        return _batch([*_key_rows(block_id, keys, parts, asks), (block_id, -4, kept)], pa.Table)

    def border(levels):
        block = Block(levels[0][-1], length)
        sure, p, names = _unframe(levels[3][-4], 3)
        p, names = np.cumsum(_array(p, "<u4"), dtype=np.int64), _array(names, "<u8")
        p = p[_read_names(np.stack([names, np.zeros_like(names)]), levels.get(4, {}), parts) > 0]
        return block, _members(sure), p, block.hashes(p.tolist(), (p + length).tolist(), shift=32)

    def whole_windows(block_id, levels):
        keys = border(levels)[-1]
        return _batch(list(_key_rows(block_id, keys, parts)), pa.Table)

    def finish(block_id, levels):
        block, sure, p, keys = border(levels)
        starts = np.union1d(sure, p[_read_names(keys, levels.get(5, {}), parts) > 0])
        names = [x.split()[0] for x in _RESULT.split(", ")]
        kinds = [*[pa.int64()] * 4, pa.string()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*block.results(starts)), kinds)], names=names)

    def finished(batches):
        for b in batches:
            for payload in b.column(2).to_pylist():
                ids, null, sizes, sha = _unframe(payload, 4)
                gone = np.frombuffer(null, dtype="u1").astype(bool)
                n = len(gone)
                zero = pa.array(np.zeros(n, dtype=np.int64))
                digests = pa.array([sha[32 * i : 32 * i + 32].hex() for i in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, dtype="<i8"), mask=gone), pa.array(np.frombuffer(sizes, dtype="<i8")), zero, zero, digests], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    state = written(id_text(docs, id_col, text_col).mapInArrow(blocks, _STATE), "repeat-blocks")
    ranked = _rank_buckets(state.mapInArrow(first_keys, _STATE), parts)
    split = written(state.unionByName(ranked).groupBy("block").applyInArrow(survivors, _STATE), "repeat-survivors")
    rows = split.where("part in (-1, -3)").selectExpr("0 AS level", "*")
    of_block = lambda rows, step: rows.groupBy("block").applyInArrow(round_of(step), _STATE)
    at_level = lambda rows, level: rows.selectExpr(f"{level} AS level", "*")
    for level, step in ((2, second), (3, third)):
        rows = rows.unionByName(at_level(written(_rank_buckets(of_block(rows, step), parts), f"repeat-ranks{level}"), level))
    asked = written(of_block(rows, ask), "repeat-border")
    answers = written(_rank_buckets(asked.where("part >= 0"), parts, asked=True), "repeat-ranks4")
    rows = at_level(split.where("part = -1"), 0).unionByName(at_level(asked.where("part = -4"), 3)).unionByName(at_level(answers, 4))
    rows = rows.unionByName(at_level(written(_rank_buckets(of_block(rows, whole_windows), parts), "repeat-ranks5"), 5))
    return rows.groupBy("block").applyInArrow(round_of(finish), _RESULT).unionByName(split.where("part = -2").mapInArrow(finished, _RESULT))
