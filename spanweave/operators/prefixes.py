"""Hashes of the beginnings of many strings, looked for at every place of a text at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Code points of a beginning: powers of two, each hashed from two halves.
SIZES = (1, 2, 4, 8, 16, 32, 64)
#: Code points of texts that are hashed together.
_WINDOW = 1 << 20
#: Odd numbers that spread bits.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _levels(codes: np.ndarray):
    """(size, hashes of that many code points from each place on), along the last axis."""
    h = (codes + np.uint64(1)) * _A
    for size in SIZES:
        if size > 1:
            half = size // 2
            if h.shape[-1] <= half:
                return
            h = (h[..., :-half] ^ (h[..., :-half] >> np.uint64(29))) * _B + h[..., half:] * _A + np.uint64(size)
        yield size, h


def hashed(batches):
    """(alias, hash of its beginning)."""
    for b in batches:
        names = b.column(0).to_pylist()
        lengths = np.array([len(n) for n in names])
        out = np.zeros(len(names), dtype=np.uint64)
        for size in SIZES:
            own = np.flatnonzero((lengths >= size) & ((lengths < 2 * size) | (size == SIZES[-1])))
            if len(own):
                codes = _codes("".join(names[i][:size] for i in own)).reshape(len(own), size)
                *_, (_, h) = _levels(codes)
                out[own] = h[:, 0]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["alias", "hash"])


def table(hashes: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the code points to take along at each."""
    order = np.argsort(hashes)
    return hashes[order], longest[order].astype(np.int32)


def _windows(text: str):
    """(offset, code points to search, text of those and of what a beginning may reach over)."""
    for at in range(0, len(text), _WINDOW):
        yield at, min(_WINDOW, len(text) - at), text[at : at + _WINDOW + SIZES[-1] - 1]


def places(batches, wanted: tuple[np.ndarray, np.ndarray]):
    """(doc_id, start, hash, head) of every place where a wanted beginning may stand; head: the text from there on."""
    hashes, longest = wanted
    for b in batches:
        docs, starts, found, heads = [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for at, n, part in _windows(text or ""):
                for _, h in _levels(_codes(part)) if len(hashes) else ():
                    own = h[:n].view(np.int64)
                    near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    for i in np.flatnonzero(hashes[near] == own).tolist():
                        docs.append(doc)
                        starts.append(at + i)
                        found.append(int(own[i]))
                        heads.append(text[at + i : at + i + int(longest[near[i]])])
        yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(found, pa.int64()), pa.array(heads, pa.string())], names=["doc_id", "start", "hash", "head"])
