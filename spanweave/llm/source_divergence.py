"""Source divergence audit by sort-based streaming.

How far do a language's sources differ in the words that they use? Documents become rows (lang, term, source, document,
documents, count), which are dealt by (lang, term), sorted by (lang, term, source, document) and read once in that order:
run lengths give the document frequency of a term and its count in each source. A row stands for a stretch of documents
that a task read one after another, as it combines their terms first; its document is the first of them. A frequent term
is dealt by a salt too, and the salts' runs, by then one row for each source, are merged by the same scan.

The terms that are kept, one row each with its sources' counts, are read a second time with the totals of the sources, and
give partial sums for pairs of sources and terms that a source uses more than its language does.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Bytes of a text: A-Z in lower case, other ASCII that is no letter as blanks, all else itself.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose terms a task combines at once; a longer text is read in pieces of as many.
_CHUNK = 8 << 20
#: Sources whose pairs with all others are summed in one pass.
_SOURCES = 1024
#: The key is lang, a zero byte and the term, which holds none: it sorts as (lang, term), and is cheaper to compare.
_ROWS = "key binary, source string, document long, documents long, count long"
_NAMES = ["key", "source", "document", "documents", "count"]
_ORDER = ["key", "source", "document"]


def audit(docs: DataFrame, least_documents: int = 30, top: int = 50, smooth: int = 5, unit: int = 1_000_000_000, salts: int = 16, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Null texts, languages and sources are empty ones. A term is a longest run of ASCII letters and characters beyond ASCII,
    only A-Z lower-cased; a language keeps those that ``least_documents`` of its documents or more have (a repeated row is
    a document of its own). In a source, p = 1 + floor(unit * (count + smooth) / (N + smooth * V)), N its count over the V
    kept terms; the language has a p of its own, all exact. Part ``pair``: item is each other source of the language, value
    the sum over kept terms of the difference of p (0 where none is kept). Part ``term``: item is each kept term that the
    source has and whose p is above the language's, value the difference, the first ``top``. Ranks are by value descending,
    then item in UTF-8 order. An empty table gives an empty result. Other columns stay out.

    Totals of the sources are broadcast; the result has a row for each pair of a language's sources, so it outgrows every
    cluster long before they do (10^6 sources in 1000 languages: 40 MB, 10^9 rows). Sums over pairs are held for
    1024 x sources at once.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    stretches = given.mapInArrow(_stretches, _ROWS).withColumn("salt", F.shiftright("document", 33) % salts)
    runs = stretches.repartition("key", "salt").sortWithinPartitions(*_ORDER).drop("salt").mapInArrow(merged, _ROWS)
    whole = runs.repartition("key").sortWithinPartitions(*_ORDER)
    terms = written(whole.mapInArrow(lambda batches: _terms(merged(batches), least_documents), "lang string, term binary, sources array<string>, counts array<long>"), "audit-terms")
    groups = terms.where("length(term) = 0").select("lang", F.explode("sources").alias("source"))
    kept = terms.where("length(term) > 0")
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.join(counted, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "v"]).orderBy("lang", "source").toArrow()
    shared = spark.sparkContext.broadcast(_by_lang(totals))
    most = max((len(s[0]) for s in shared.value.values()), default=0)
    found = kept.mapInArrow(lambda batches: _more(batches, shared.value, smooth, unit), "lang string, source string, item binary, value long")
    used = found.select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    sums = None
    for first in range(0, most, _SOURCES):
        some = kept.mapInArrow(lambda batches, first=first, last=first + _SOURCES: _pairs(batches, shared.value, first, last, smooth, unit), "lang string, source string, item string, value long")
        sums = some if sums is None else sums.unionByName(some)
    other = groups.withColumnRenamed("source", "item")
    bare = groups.join(vocabulary, "lang", "left_anti").join(other, "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = bare if sums is None else bare.unionByName(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs.withColumn("part", F.lit("pair"))).select(*columns).unionByName(ranked(used).where(F.col("rank") <= top).select(*columns))


def _stretches(batches):
    """Terms of documents in the order in which a task reads them; the empty term is in every document."""
    base, seen = TaskContext.get().partitionId() << 33, 0
    held, size = [], 0
    for b in small(batches, 100):
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            if len(text) > _CHUNK:
                yield _long_text(lang, source, text, base | seen)
            else:
                held.append((lang, source, text.translate(_FOLD), base | seen))
                size += len(text)
            seen += 1
            if size >= _CHUNK or len(held) >= 50_000:
                yield _combined(held)
                held, size = [], 0
    if held:
        yield _combined(held)


def _rows(lang, source, term, document, documents, count) -> pa.RecordBatch:
    key = pc.binary_join_element_wise(lang.cast(pa.binary()), term, pa.scalar(b"\0", pa.binary()))
    return pa.RecordBatch.from_arrays([key, source, *(pa.array(x, pa.int64()) for x in (document, documents, count))], names=_NAMES)


def pieces(text: bytes):
    """A long text, folded, in pieces that end between terms."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + _CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def _long_text(lang: str, source: str, text: bytes, document: int) -> pa.RecordBatch:
    count = Counter({b"": 1})
    for piece in pieces(text):
        count.update(piece.split())
    n = len(count)
    return _rows(pa.array([lang] * n), pa.array([source] * n), pa.array(list(count), pa.binary()), np.full(n, document), np.ones(n, dtype=np.int64), np.fromiter(count.values(), np.int64, n))


def _combined(held: list[tuple[str, str, bytes, int]]) -> pa.RecordBatch:
    """One row for each (lang, source, term) of some documents, in the order in which Spark sorts them: what is dealt out
    is then made of sorted stretches, which Spark's sort merges."""
    groups = {k: i for i, k in enumerate(sorted({(lang, source) for lang, source, _, _ in held}))}
    group = np.array([groups[lang, source] for lang, source, _, _ in held])
    lang = np.unique([k[0] for k in groups], return_inverse=True)[1]
    data = np.frombuffer(b" ".join(text for _, _, text, _ in held), dtype=np.uint8)
    letter = data != 32
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    own = np.searchsorted(np.cumsum([len(text) + 1 for _, _, text, _ in held]), begins, side="right")
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # the empty term, which every document has, is 0
    terms = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(pa.array(order))])
    size = len(terms)
    seen = np.concatenate([own * size + rank[coded.indices.to_numpy()], np.arange(len(held)) * size])
    seen, count = np.unique(seen, return_counts=True)  # (document, term)
    row = (lang[group[seen // size]] * size + seen % size) * len(groups) + group[seen // size]  # (lang, term, source)
    order = np.argsort(row, kind="stable")
    row, seen, count = row[order], seen[order], count[order]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    first = np.array([document for *_, document in held])[seen[at] // size]
    langs, sources = (pa.array([k[i] for k in groups], pa.string()).take(pa.array(row[at] % len(groups))) for i in (0, 1))
    return _rows(langs, sources, terms.take(pa.array(seen[at] % size)), first, np.diff(np.append(at, len(row))), np.add.reduceat(count, at))


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for c in columns:
        column = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def merged(batches):
    """One row for each run of (lang, term, source) in sorted rows; a run may go on over batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if held is None else [held, b])
        at = _starts(table, ["key", "source"])
        sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), at)) for c in ("documents", "count")]
        first = table.select(_ORDER).take(pa.array(at))
        rows = pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in first.columns), *sums], names=_NAMES)
        held = rows.slice(len(at) - 1)
        if len(at) > 1:
            yield rows.slice(0, len(at) - 1)
    if held is not None:
        yield held


def _terms(batches, least: int):
    """One row for each term that enough documents have, and for the empty term: its sources and their counts."""
    held = None

    def out(table):
        at = _starts(table, ["key"])
        ends = pa.array(np.append(at, table.num_rows), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("source", "count")]
        keys = table.column("key").take(pa.array(at))
        keep = pc.or_(pa.array(np.add.reduceat(table.column("documents").to_numpy(), at) >= least), pc.ends_with(keys, b"\0"))
        rows = pa.table([keys, *lists], names=["key", "sources", "counts"]).filter(keep).combine_chunks()
        split = [k.rpartition(b"\0") for k in rows.column("key").to_pylist()]
        lang, term = pa.array([k[0].decode() for k in split], pa.string()), pa.array([k[2] for k in split], pa.binary())
        return pa.table([lang, term, *rows.columns[1:]], names=["lang", "term", "sources", "counts"]).to_batches()

    for b in batches:
        table = pa.Table.from_batches([b] if held is None else [*held, b])
        at = _starts(table, ["key"])
        held = table.slice(at[-1]).to_batches()  # at most a row for each source
        if len(at) > 1:
            yield from out(table.slice(0, at[-1]))
    if held is not None:
        yield from out(pa.Table.from_batches(held))


def _by_lang(totals: pa.Table) -> dict:
    """lang: (its sources in order, N of each, V)."""
    found: dict[str, tuple[list, list, int]] = {}
    for lang, source, n, v in zip(*(totals.column(c).to_pylist() for c in ("lang", "source", "n", "v"))):
        sources, counts, _ = found.setdefault(lang, ([], [], v))
        sources.append(source)
        counts.append(n)
    return {k: (pa.array(s, pa.string()), np.array(n, dtype=np.int64), v) for k, (s, n, v) in found.items()}


def shares(count: np.ndarray, total: np.ndarray, unit: int) -> np.ndarray:
    """1 + floor(unit * count / total), exact: three digits at a time keep every step inside a long below 9 * 10^15."""
    out, rest, left = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count, unit
    while left > 1:
        step = min(left, 1000)
        digits, rest = np.divmod(rest * step, total)
        out, left = out * step + digits, left // step
    return out + 1


def _counts(batches, by_lang: dict):
    """(lang, terms, counts of terms x sources of the lang) for stretches of rows of one lang."""
    for b in small(batches, 500):
        table = pa.Table.from_batches([b])
        at = [*_starts(table, ["lang"]).tolist(), b.num_rows]
        for a, z in zip(at, at[1:]):
            rows = b.slice(a, z - a)
            lang = rows.column(0)[0].as_py()
            sources = by_lang[lang][0]
            lists = rows.column(2)
            own = np.repeat(np.arange(z - a), pc.list_value_length(lists).to_numpy())
            counts = np.zeros((z - a, len(sources)), dtype=np.int64)
            counts[own, pc.index_in(lists.flatten(), value_set=sources).to_numpy()] = rows.column(3).flatten().to_numpy()
            yield lang, rows.column(1), counts


def _more(batches, by_lang: dict, smooth: int, unit: int):
    """Terms that a source has and uses more than its language does."""
    for lang, terms, counts in _counts(batches, by_lang):
        sources, n, v = by_lang[lang]
        p = shares(counts + smooth, n[None] + smooth * v, unit)
        q = shares(counts.sum(axis=1) + smooth, n.sum() + smooth * v, unit)
        term, source = np.nonzero((counts > 0) & (p > q[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), sources.take(pa.array(source)), terms.take(pa.array(term)), pa.array(p[term, source] - q[term])], names=["lang", "source", "item", "value"])


def _pairs(batches, by_lang: dict, first: int, last: int, smooth: int, unit: int):
    """Partial sums of this task's terms for the pairs of sources ``first`` to ``last`` of a language with all others."""
    held: tuple[str, np.ndarray] | None = None

    def out():
        lang, sums = held
        sources = by_lang[lang][0]
        a, b = np.nonzero(np.arange(first, first + len(sums))[:, None] != np.arange(len(sources)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), sources.take(pa.array(a + first)), sources.take(pa.array(b)), pa.array(sums[a, b])], names=["lang", "source", "item", "value"])

    for lang, _, counts in _counts(batches, by_lang):
        sources, n, v = by_lang[lang]
        some = len(sources[first:last])
        if not some:
            continue
        if held is None or held[0] != lang:
            if held is not None:
                yield out()
            held = lang, np.zeros((some, len(sources)), dtype=np.int64)
        p = shares(counts + smooth, n[None] + smooth * v, unit)
        for k in range(some):
            held[1][k] += np.abs(p - p[:, first + k : first + k + 1]).sum(axis=0)
    if held is not None:
        yield out()
