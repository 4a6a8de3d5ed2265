"""BPE by a distinct-word table.

Each map task splits its documents into blocks of words and keeps, for a block, the distinct words and every document
as positions in that list. The distinct words go to the bucket of their hash, where each word is encoded once however
many blocks have it; the ids return to the blocks in word order and are joined to the documents by position. Decoding
joins ids to the vocabulary's pieces, whose number is fixed by the tokenizer.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, id_text, pack, small, unpack

#: The pattern of the byte-level pre-tokenizer, and the characters on which every Unicode version agrees with it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER = regex.compile(r"[^\x00-ɏ]")

_STATE = "block long, part int, payload binary"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_LOADED: dict = {}


class Bpe:
    """The library's tokenizer with what the table needs of it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        special = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special = regex.compile("|".join(f"({regex.escape(s)})" for s in special.values())) if special else None
        back = _byte_letters()
        pieces = [b""] * self.lib.get_vocab_size(with_added_tokens=True)
        for piece, i in self.lib.get_vocab(with_added_tokens=True).items():
            pieces[i] = special[i].encode() if i in special else bytes(back[c] for c in piece)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out: list[str] = []
        for part in self.special.splititer(text):
            if part:
                out += [part] if self.special.fullmatch(part) else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of ids, joined."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.starts[ids], n)
        return self.bytes[at].tobytes()


def _byte_letters() -> dict[str, int]:
    """Byte-level letters: printable bytes are themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if chr(b) in "".join(map(chr, (*range(33, 127), *range(161, 173), *range(174, 256))))]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bpe(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, which compress better."""
    return pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _frames(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts)


def _unframe(data: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.cumsum(np.frombuffer(data, dtype="<u8", count=n)).astype(np.int64)
    return [data[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


def _block_rows(block: int, ids: list, docs: list[list[str]], parts: int):
    counts: Counter = Counter()
    for words in docs:
        counts.update(words)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    place = {w: i for i, w in enumerate(order)}
    coded = [w.encode("utf-8", "surrogatepass") for w in order]
    bucket = np.array([zlib.crc32(w) % parts for w in coded], dtype=np.uint32)
    flat = np.fromiter((place[w] for words in docs for w in words), dtype=np.uint32)
    null = np.array([i is None for i in ids], dtype=np.uint8)
    body = _frames(np.array([i or 0 for i in ids], dtype="<i8").tobytes(), null.tobytes(), np.array([len(w) for w in docs], dtype="<u4").tobytes(), _planes(flat), _planes(bucket))
    yield block, -1, body
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for own in np.split(by, cuts) if len(by) else []:
        words = [coded[i] for i in own]
        yield block, int(bucket[own[0]]), _frames(pack(np.array([len(w) for w in words], dtype="<u4").tobytes()), pack(b"".join(words)))


def split_blocks(docs: DataFrame, tokenizer: str, parts: int, block_chars: int) -> DataFrame:
    """(block, part, payload): part -1 has a block's documents, part p its distinct words of bucket p."""

    def run(batches):
        tok, task, seq = bpe(tokenizer), TaskContext.get().partitionId(), 0
        ids, words, chars = [], [], 0

        def out():
            rows = list(_block_rows(task << 32 | seq, ids, words, parts))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "part", "payload"])

        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc_id)
                words.append(tok.split(text))
                chars += len(text)
                if chars >= block_chars:
                    yield out()
                    ids, words, chars, seq = [], [], 0, seq + 1
        if ids:
            yield out()

    return docs.mapInArrow(run, _STATE)


def encode_buckets(words: DataFrame, tokenizer: str) -> DataFrame:
    """The ids of each block's words of a bucket, in word order; each distinct word of the bucket is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        tok, lists = bpe(tokenizer), []
        for payload in table.column("payload").to_pylist():
            lengths, text = map(unpack, _unframe(payload, 2))
            ends = np.cumsum(np.frombuffer(lengths, dtype="<u4")).tolist()
            lists.append([text[a:b] for a, b in zip([0, *ends[:-1]], ends)])
        distinct = list({w for own in lists for w in own})
        known: dict[bytes, bytes] = {}
        for at in range(0, len(distinct), 10_000):
            part = distinct[at : at + 10_000]
            for w, e in zip(part, tok.encode([x.decode("utf-8", "surrogatepass") for x in part])):
                known[w] = np.array(e, dtype="<u4").tobytes()
        out = []
        for own in lists:
            ids = [known[w] for w in own]
            out.append(_frames(_planes(np.array([len(x) // 4 for x in ids])), _planes(np.frombuffer(b"".join(ids), dtype="<u4"))))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "payload": pa.array(out, pa.binary())})

    return words.groupBy("part").applyInArrow(run, _STATE)


def _join_block(block: pa.Table, answers: pa.Table, tok: Bpe):
    """(doc_id, ids) of each document of a block, from its positions and the ids of its words."""
    own = block.column("payload")[block.column("part").to_pylist().index(-1)].as_py()
    rows = dict(zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist()))
    ids, null, lengths, flat, bucket = _unframe(own, 5)
    flat, bucket = _from_planes(flat), _from_planes(bucket)
    counts, values = [], []
    for part in sorted(rows):
        n, v = _unframe(rows[part], 2)
        counts.append(_from_planes(n))
        values.append(_from_planes(v))
    by = np.argsort(bucket, kind="stable")
    n = np.zeros(len(bucket), dtype=np.int64)
    n[by] = np.concatenate(counts) if counts else []
    starts = np.zeros(len(bucket), dtype=np.int64)
    starts[by] = np.cumsum(n[by]) - n[by]
    values = np.concatenate(values) if values else np.empty(0, dtype="<u4")
    ends = np.cumsum(np.frombuffer(lengths, dtype="<u4")).tolist()
    for doc_id, gone, a, b in zip(np.frombuffer(ids, dtype="<i8").tolist(), np.frombuffer(null, dtype=np.uint8).tolist(), [0, *ends[:-1]], ends):
        own = flat[a:b]
        k = n[own]
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[own], k)
        yield None if gone else doc_id, values[at]


def encode_documents(docs: DataFrame, tokenizer: str, block_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", finish=None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """One row per input row: doc_id and its ids, or what ``finish(tok, doc_id, ids)`` makes of them under ``schema``.

    Ids are those of the library without added special tokens, a special token's string in a text being that token.
    Null or empty text has no ids. Repeated rows and null ids are kept. An empty table gives an empty result.
    """
    parts = buckets(docs)
    # dealt by block once: the words' branch reads this exchange, and the join takes place where it left the documents
    state = split_blocks(id_text(docs, id_col, text_col), tokenizer, parts, block_chars).repartition(parts, "block")

    def words_only(batches):  # in Python, as a filter would move below the exchange and make a second one
        for b in batches:
            yield b.filter(pa.compute.greater_equal(b.column(1), 0))

    ids = encode_buckets(state.mapInArrow(words_only, _STATE), tokenizer)
    finish = finish or (lambda tok, doc_id, x: (doc_id, x.tolist()))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        tok = bpe(tokenizer)
        rows = [finish(tok, doc_id, x) for doc_id, x in _join_block(block, answers, tok)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return state.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, schema)


def decode_documents(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>): every id is joined to its piece; null ids give a null text."""
    def run(batches):
        tok = bpe(tokenizer)
        for b in small(batches):
            texts = [None if x is None else tok.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256 (see ``encode_documents``)."""

    def digest(tok: Bpe, doc_id, ids: np.ndarray):
        text = tok.decode(ids).decode("utf-8", "replace").encode()
        return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return encode_documents(docs, tokenizer, finish=digest, schema=_DIGEST, **options)
