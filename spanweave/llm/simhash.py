"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are collapsed to distinct ones first. Their 64 bits are grouped by correlation into m partitions that
get thresholds t_i >= -1 with sum(t_i) = radius - m + 1; two fingerprints within the radius then lie within t_i in some
partition i. Dynamic programming picks the thresholds, over every m offered, by estimated candidates plus probes.
A partition with threshold t is probed with every choice of t masked bits, so candidates meet by equality of
(choice, unmasked bits); each is verified on all 64 bits. Groups of candidates give a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small, written
from .graph import connected_components

#: Cost of looking at a candidate pair, in probes: a probe is shuffled and sorted, a pair is one XOR in an array.
CANDIDATE = 0.1


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles in order, repeats included; a shorter text is one shingle, one without words none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([h(line, 42)], dtype=np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - words].tolist()]
    return np.array([h(line[i:j], 42) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str, words: int) -> int:
    """64 majority bits over word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in small(batches):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlation of the 64 bits over all fingerprints: at most 64 x 64 sums reach the driver."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i * 64 + j, -1)), pa.array(np.append(both[i, j], n))], names=["k", "v"])

    both, n = np.zeros((64, 64)), 1.0
    for k, v in fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        if k < 0:
            n = v
        else:
            both[k // 64, k % 64] = both[k % 64, k // 64] = v
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each starts with a free bit and takes the free bits most correlated with it."""
    free, groups = set(range(64)), []
    for k in range(m):
        width = len(free) // (m - k)
        first = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(pairs: list[float], widths: list[int], n: float, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost. pairs: candidate pairs of each partition at threshold 0."""

    def cost(i: int, t: int) -> float:
        return 0.0 if t < 0 else comb(widths[i], t) * (n + CANDIDATE * pairs[i] * 2.0**t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(pairs)):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, min(radius, widths[i]) + 1):
                key, value = total + t, (c + cost(i, t), [*ts, t])
                if key not in step or value < step[key]:
                    step[key] = value
        best = step
    return best[radius - len(pairs) + 1]


def plan_probes(fps: DataFrame, radius: int, choices: tuple[int, ...]) -> list[int]:
    """The bit masks to probe with. choices: the numbers of partitions to choose from."""
    corr = _bit_correlation(fps)
    layouts = {m: group_bits(corr, m) for m in choices if m <= radius + 1}
    parts = [(m, k, sum(1 << b for b in bits)) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for i, (_, _, mask) in enumerate(parts)])
    counts = fps.select(F.explode(probes).alias("p")).groupBy("p.i", "p.v").count()
    pairs = {r[0]: (r[1], r[2]) for r in counts.groupBy("i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.sum("count")).collect()}
    plans = []
    for m, groups in layouts.items():
        own = [pairs.get(i, (0.0, 0))[0] for i, p in enumerate(parts) if p[0] == m]
        n = max([v[1] for v in pairs.values()], default=1)
        plans.append((*allocate(own, [len(g) for g in groups], n, radius), groups))
    _, thresholds, groups = min(plans, key=lambda x: x[0])
    masks = []
    for bits, t in zip(groups, thresholds):
        full = sum(1 << b for b in bits)
        masks += [full & ~sum(1 << b for b in gone) for gone in combinations(bits, t)] if t >= 0 else []
    return masks


def _forest(fp: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links within one group of candidates."""
    a, b, left = [], [], np.arange(len(fp))
    while left.size > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                a += [at] * len(hit)
                b += hit.tolist()
                queue += hit.tolist()
    return a, b


def link_fingerprints(fps: DataFrame, radius: int, choices: tuple[int, ...] = (2, 3, 4, 5)) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints (fp, rep) within the radius.

    choices: numbers of partitions among which the estimates choose. Many partitions send few probes but let candidates
    grow as rows^2 / 2^(64 / partitions); the more rows there are, the fewer partitions cost least.
    """
    masks = plan_probes(fps, radius, choices)
    probes = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])
    rows = fps.select("fp", "rep", F.explode(probes).alias("p")).select("p.k", "p.v", "fp", "rep").repartition("k", "v").sortWithinPartitions("k", "v")

    def links(k, v, fp, rep):
        same = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        cuts = np.flatnonzero(~same) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))
        size = ends - starts
        group = np.repeat(np.arange(len(size)), size)
        short = np.repeat(size <= 8, size)
        out_a, out_b = [], []
        for gap in range(1, 8):  # short groups: compare neighbours at each distance for all groups at once
            at = np.flatnonzero(short[: len(k) - gap] & (group[gap:] == group[: len(k) - gap]))
            if not at.size:
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= radius]
            out_a.append(rep[at])
            out_b.append(rep[at + gap])
        for i in np.flatnonzero(size > 8):
            a, b = _forest(fp[starts[i] : ends[i]], radius)
            out_a.append(rep[starts[i] + np.array(a, dtype=np.int64)])
            out_b.append(rep[starts[i] + np.array(b, dtype=np.int64)])
        pairs = np.stack([np.concatenate(out_a), np.concatenate(out_b)]) if out_a else np.empty((2, 0), dtype=np.int64)
        return np.unique(np.sort(pairs, axis=0), axis=1)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new[2] = new[2].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if last.size and len(held[0]) >= 20_000:
                done = last[-1] + 1
                pairs = links(*(x[:done] for x in held))
                held = [x[done:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
        if held:
            pairs = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, choices: tuple[int, ...] = (2, 3, 4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints link at ``radius`` or fewer differing bits. Null text counts as empty; texts without words have
    fingerprint zero and link like any other. Repeated rows are each returned. A row with a null id gets its component
    too but never names one unless all ids in it are null. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct")
    found = connected_components(link_fingerprints(distinct, radius, choices))
    named = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
