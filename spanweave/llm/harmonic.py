"""Token packing by harmonic classes.

A document's ids are cut into pieces of capacity / 2^k down to a smallest size, plus a tail below that size. A piece
belongs to the reciprocal class j = capacity // length, and every bin of class j takes exactly j pieces. Classes 1, 2,
4 .. fill their bins without padding; a tail's bin wastes less than one tail. Each map task packs its own documents;
what its open bins hold at the end is poured together, so a task pads little more than one bin. Nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, small

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict = {}


class _Words(dict):
    """Ids by word. A word that is not there gets an empty place, to be filled, and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        place = self[word] = bytearray()
        self.new.append(word)
        return place


class WordEncoder:
    """Ids of a lower-casing word-end BPE, from a memory of what stands between white space and of the words in it, bounded in
    bytes (and one text's words): a worker lives on for other tasks, and so does this.

    No word reaches over white space, so a text is split by it, which is far quicker than by the pattern of words; only a
    piece that was not met is searched for words. Words that are new go to the library in one text, whose ids are cut
    after each that ends a word.

    Characters below U+0250 are known to keep word borders under the tokenizer's normaliser; a text with any other
    character, with one of the four that only Python takes for white space, or with the string of a special token, goes to
    the library whole.
    """

    #: Fixed value: the pattern that the tokenizer file splits by.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    OTHER = regex.compile(r"[^\x00-\x1b\x20-\u012f\u0131-\u024f]")

    #: Bytes that a remembered word takes beside its characters and ids.
    ENTRY = 150
    #: Longer pieces and words, of which few come twice, are not remembered.
    LONG = 64

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # words that were met of late, and those met before; when the first outgrow their bytes they become the second
        self.most, self.held, self.words, self.older = most_bytes, 0, _Words(), _Words()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.held > self.most:
            self.older, self.words, self.held = self.words, _Words(), 0
        pieces = list(map(self.words.__getitem__, text.lower().split()))
        if self.words.new:
            self._fill()
        return b"".join(pieces)

    def _fill(self) -> None:
        """Fill the places of what was met anew: from the older memory, else by its words."""
        fresh, composed = [], []
        for piece in self._not_recalled():
            words = self.WORDS.findall(piece)
            if words == [piece]:
                fresh.append(piece)
            else:
                composed.append((piece, list(map(self.words.__getitem__, words))))
        fresh += self._not_recalled()
        for at in range(0, len(fresh), 10_000):
            part = fresh[at : at + 10_000]
            for word, ids in zip(part, self._encoded(part)):
                self._keep(word, ids)
        for piece, places in composed:
            self._keep(piece, b"".join(places))

    def _not_recalled(self) -> list[str]:
        """What was met anew and is not in the older memory; what is gets its ids."""
        new, self.words.new = self.words.new, []
        left = []
        for word in new:
            if (ids := self.older.get(word)) is None:
                left.append(word)
            else:
                self._keep(word, ids)
        return left

    def _encoded(self, words: list[str]) -> list[bytes]:
        (found,) = self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):  # a vocabulary in which some words end without a mark
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        data, cuts = ids.tobytes(), cuts.tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _keep(self, word: str, ids: bytes) -> None:
        """Fill a word's place, which this text's pieces hold, and remember the ids."""
        self.words[word] += ids
        if len(word) > self.LONG:
            del self.words[word]
            return
        self.words[word] = ids
        self.held += len(word) + len(ids) + self.ENTRY


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(total: int, capacity: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole capacities, then halves of it down to ``least``, then the tail."""
    start, size = 0, capacity
    while size >= least:
        while total - start >= size:
            yield start, size
            start += size
        size //= 2
    if start < total:
        yield start, total - start


class Packer:
    """Bins of one task. Pieces are tuples that begin with doc_id, start, length."""

    def __init__(self, task: int, capacity: int):
        self.next, self.capacity, self.open, self.rows = task << 32, capacity, {}, []

    def close(self, bin_: list[tuple]) -> None:
        offset = 0
        for piece in bin_:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        kind = self.capacity // piece[2]
        bin_ = self.open.setdefault(kind, [])
        bin_.append(piece)
        if len(bin_) == kind:
            self.close(self.open.pop(kind))

    def finish(self) -> None:
        """Pour what is left, longest first: powers of two fill bins without a gap, tails follow."""
        bin_, used = [], 0
        for piece in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2]):
            if used + piece[2] > self.capacity:
                self.close(bin_)
                bin_, used = [], 0
            bin_.append(piece)
            used += piece[2]
        if bin_:
            self.close(bin_)
        self.open = {}

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows)] if rows else [pa.array([], type=pa.int64())] * 7, names=names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the end id alone. Repeated rows are packed each; a null id stays null. Sequence ids are
    unique (task number and a count). An empty table gives an empty result.
    """

    def run(batches):
        enc, packer, end = encoder(tokenizer), Packer(TaskContext.get().partitionId(), capacity), np.array([end_id], dtype="<u4").tobytes()
        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                total = len(ids) // 4
                for start, length in cut(total, capacity, least):
                    packer.add((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)
