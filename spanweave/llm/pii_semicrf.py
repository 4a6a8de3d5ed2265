"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns give exact spans of four kinds. The field then reads the passages near digits and signs that the
patterns left over: every segment of a passage, up to a length, is scored as a whole by features of its text (digit
groups, checksums, separators, address shape) and of the words beside it, and dynamic programming with a bounded
number of entities chooses boundaries and kinds together. It is trained here, by gradient steps on the exact
likelihood, from made passages; its spans are added where no base span lies. A passage is cut at base spans and what is
left of it is read; a long one is read in windows that overlap by the longest segment, so only segments are bounded.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, small

#: Kinds in their order, and the base patterns, possessive where giving back characters cannot help.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Passages that the field reads: runs of digits and their separators, and spelt-out mail addresses. The parts of an address
#: have the lengths that mail itself allows: 64 before the sign, 63 in a label.
_NUMBERS = re.compile(r"(?<![\w.@/-])[(+]?[0-9](?:[0-9]|[\x20().\-/](?=[\x20().\-/]{0,2}[0-9])){7,}+")
_SPELT = re.compile(
    r"(?i)(?<![\w.+-])[\w.+-]{1,64}(?:(?:\s?(?:\(at\)|\[at\])\s?|\s@\s)[\w-]{1,63}(?:(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s|\.)[\w-]{2,63}){1,8}|\sat\s[\w-]{1,63}(?:\sdot\s[\w-]{2,63}){1,8})"
)
_PIECE = re.compile(r"[0-9]+|[^\W\d_]+|[^\s\w]|_")
_EDGE = " .-/)"
_CUES = {
    "email": re.compile(r"(?i)e?-?mail|contact|write|reach|address"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|ping"),
    "card": re.compile(r"(?i)card|visa|amex|payment|credit|debit"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|cell|fax|dial|whatsapp"),
}
#: Pieces of the longest segment and of a window; entities of a made passage and of a window.
_SEGMENT, _WINDOW, _ENTITIES, _MOST = 14, 56, 4, 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind): leftmost matches without overlaps in a kind; those that fail the kind's test are dropped."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:  # a match is the run of local characters before an @ and the domain after it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _features(kind: int, text: str, before: str, after: str) -> list[float]:
    """Whole-span features of a segment under a kind."""
    digits = _NOT_DIGIT.sub("", text)
    groups = re.findall(r"[0-9]+", text)
    n = len(digits)
    cue = float(bool(_CUES[KINDS[kind]].search(before)))
    other = float(any(_CUES[k].search(before) for k in KINDS if k != KINDS[kind]))
    glued = float(before[-1:].isalnum() or after[:1].isalnum())
    letters = any(c.isalpha() for c in text)
    if kind == 0:
        names = re.split(r"(?i)\s*(?:\(at\)|\[at\]|@|\sat\s)\s*", text)
        own = len(names) == 2 and bool(re.fullmatch(r"(?i)[\w-]+(?:\s*(?:\(dot\)|\[dot\]|\.|\sdot\s)\s*[\w-]+)+", names[1]))
        top = bool(re.search(r"(?i)(?:com|org|net|edu|gov|io|co|uk|de|fr|es)$", text))
        sign = bool(re.search(r"(?i)\(at\)|\[at\]|@", text))
        shape = [float(own), float(own and top), float(own and sign), float(bool(own and re.fullmatch(r"[\w.+-]+", names[0])))]
    elif kind == 1:
        shape = [float(len(groups) == 4), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(text.count(".") >= 3), float(letters)]
    elif kind == 2:
        even = len(groups) >= 3 and all(len(g) == 4 for g in groups[:-1])
        shape = [float(13 <= n <= 19 and luhn(digits)), float(even), float(n in (15, 16)), float(letters or "(" in text)]
    else:
        shape = [float(9 <= n <= 13), float(2 <= len(groups) <= 5 and max(map(len, groups), default=0) <= 5), float(bool(re.match(r"\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]?\d{3,4}$|\+", text))), float(letters or n > 13)]
    return [1.0, cue, other, glued, *shape, float(text[:1] in " .-/)" or text[-1:] in " .-/("), float(n < 7 and kind > 0)]


_WIDTH = 10


class SemiCrf:
    """Segment scores w[kind] . features; other pieces score 0. Adjacent entities pay ``pair``."""

    def __init__(self):
        self.w, self.pair = np.zeros((len(KINDS), _WIDTH)), 0.0

    @staticmethod
    def segments(text: str, before: str, after: str):
        """Pieces of a passage, candidate segments (first, last + 1, kind) and their features."""
        pieces = [m.span() for m in _PIECE.finditer(text)]
        found, rows = [], []
        for i in range(len(pieces)):
            for j in range(i + 1, min(len(pieces), i + _SEGMENT) + 1):
                a, b = pieces[i][0], pieces[j - 1][1]
                if b - a < 7:
                    continue
                value, left, right = text[a:b], (before + text[:a])[-30:], (text[b:] + after)[:10]
                for kind in range(len(KINDS)):
                    if (kind == 0) == any(c.isdigit() for c in value) and not (kind == 0 and any(c.isalpha() for c in value)):
                        continue
                    if kind and any(c.isalpha() for c in value):
                        continue
                    found.append((i, j, kind))
                    rows.append(_features(kind, value, left, right))
        return pieces, found, np.array(rows, dtype=float).reshape(-1, _WIDTH)

    def scores(self, found, x) -> np.ndarray:
        return (x * self.w[[f[2] for f in found]]).sum(axis=1) if found else np.zeros(0)

    def _lattice(self, n, found, scores, combine, most=_ENTITIES):
        """Forward values [position][entities][last was an entity], for at most ``most`` entities."""
        ends: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(found):
            ends.setdefault(j, []).append(k)
        low = -1e30
        value = np.full((n + 1, most + 1, 2), low)
        value[0, 0, 0] = 0.0
        for p in range(1, n + 1):
            value[p, :, 0] = combine(value[p - 1, :, 0], value[p - 1, :, 1])
            for k in ends.get(p, ()):
                i = found[k][0]
                step = combine(value[i, :-1, 0], value[i, :-1, 1] + self.pair) + scores[k]
                value[p, 1:, 1] = combine(value[p, 1:, 1], step)
        return value, ends

    def read(self, text: str, before: str, after: str) -> list[tuple[int, int, int]]:
        """Entities of a passage of any length: a window's that may reach beyond it are left to the next window."""
        pieces = [m.span() for m in _PIECE.finditer(text)]
        out, at = [], 0
        while True:
            last = at + _WINDOW >= len(pieces)
            a, b = (pieces[at][0] if at else 0), len(text) if last else pieces[at + _WINDOW - 1][1]
            found = [(a + s, a + e, k) for s, e, k in self.decode(text[a:b], (before + text[:a])[-30:], (text[b : b + 10] + after)[:10])]
            if last:
                return out + found
            sure = pieces[at + _WINDOW - _SEGMENT][0]
            out += [f for f in found if f[1] <= sure]
            start = min([sure, *(s for s, e, _ in found if e > sure)])
            at = next(i for i in range(at + 1, len(pieces)) if pieces[i][0] >= start)

    def decode(self, text: str, before: str, after: str, most: int = _MOST) -> list[tuple[int, int, int]]:
        """Best segmentation with at most ``most`` entities, as (start, end, kind) in the passage."""
        pieces, found, x = self.segments(text, before, after)
        if not found:
            return []
        scores = self.scores(found, x)
        most = min(most, len(pieces))
        value, ends = self._lattice(len(pieces), found, scores, np.maximum, most)
        flat = int(value[-1].argmax())
        e, last, p, out = flat // 2, flat % 2, len(pieces), []
        while p > 0:
            if not last:
                last = int(value[p - 1, e, 1] > value[p - 1, e, 0])
                p -= 1
                continue
            for k in ends[p]:
                i = found[k][0]
                options = (value[i, e - 1, 0], value[i, e - 1, 1] + self.pair)
                if abs(max(options) + scores[k] - value[p, e, 1]) < 1e-9:
                    out.append((pieces[i][0], pieces[p - 1][1], found[k][2]))
                    p, e, last = i, e - 1, int(options[1] > options[0])
                    break
        return out[::-1]

    def train(self, examples, epochs: int = 25, rate: float = 0.3, decay: float = 1e-3) -> SemiCrf:
        """examples: (before, passage, after, [(start, end, kind)]). Expectations come from tilted partition functions."""
        ready = []
        for before, text, after, gold in examples:
            pieces, found, x = self.segments(text, before, after)
            index = {(pieces[i][0], pieces[j - 1][1], k): n for n, (i, j, k) in enumerate(found)}
            if found:
                ready.append((len(pieces), found, x, [index[g] for g in gold if g in index]))
        for epoch in range(epochs):
            grad = np.zeros_like(self.w)
            for n, found, x, gold in ready:
                scores = self.scores(found, x)
                forward, _ = self._lattice(n, found, scores, np.logaddexp)
                mirrored = [(n - j, n - i, k) for i, j, k in found]
                backward, _ = self._lattice(n, mirrored, scores, np.logaddexp)
                total = np.logaddexp.reduce(forward[-1].ravel())
                kinds = np.array([f[2] for f in found])
                left = np.logaddexp(forward[[f[0] for f in found], :, 0], forward[[f[0] for f in found], :, 1])
                right = np.logaddexp(backward[[n - f[1] for f in found], :, 0], backward[[n - f[1] for f in found], :, 1])
                chance = np.zeros(len(found))
                for e in range(_ENTITIES):
                    for f in range(_ENTITIES - e):
                        chance += np.exp(np.clip(left[:, e] + right[:, f] + scores - total, -700, 0))
                push = -chance
                push[gold] += 1
                np.add.at(grad, kinds, push[:, None] * x)
            self.w += rate / (1 + epoch / 10) * (8 * grad / len(ready) - decay * self.w)
        return self


def made_passages(n: int = 240, seed: int = 5) -> list[tuple[str, str, str, list[tuple[int, int, int]]]]:
    """Made passages with their spans: spelt-out addresses, grouped numbers, and look-alikes without any."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(3, 8)))

    def card():
        body = "4" + digits(14)
        value = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice([".", "/", "- ", " . "])
        return sep.join(value[i : i + 4] for i in range(0, 16, 4))

    made = {
        0: lambda: name() + r.choice([" (at) ", "(at)", " [at] ", " at ", " @ "]) + name() + r.choice([" (dot) ", "[dot]", " dot ", "."]) + r.choice(["com", "org", "net", "co"]),
        1: lambda: " . ".join(str(r.randint(0, 255)) for _ in range(4)),
        2: card,
        3: lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(4)} {digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    }
    cues = {0: ["mail", "contact", "write to"], 1: ["ip", "host", "server"], 2: ["card", "visa", "payment"], 3: ["phone", "tel", "call", "mobile"]}
    none = [lambda: digits(16), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(8)}", lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"{name()} at {name()}. {name()}", lambda: f"{digits(5)}.{digits(5)}", lambda: f"{digits(4)}/{digits(4)}/{digits(4)}", lambda: f"{digits(12)}"]
    out = []
    for i in range(n):
        if i % 2:
            kind = r.randrange(4)
            value = made[kind]()
            cue = r.choice(cues[kind]) if kind != 0 and r.random() < 0.8 or r.random() < 0.5 else name()
            tail = r.choice(["", "", " ", " 12"]) if kind else ""
            out.append((f"{name()} {cue} ", value + tail, f" {name()}", [(0, len(value), kind)]))
        else:
            out.append((f"{name()} {r.choice([name(), name(), 'order', 'page', 'number'])} ", r.choice(none)(), f" {name()}", []))
    return out


@lru_cache(maxsize=2)
def model(seed: int = 5) -> SemiCrf:
    return SemiCrf().train(made_passages(seed=seed))


def passages(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the field reads: runs of numbers and spelt-out addresses, without the base spans in them."""
    runs = []
    for m in _NUMBERS.finditer(text):
        a, b = m.span()
        if text[b : b + 1] == "@" or text[b : b + 1].isalnum() or text[b : b + 1] == "_":  # the last group belongs to a word
            while b > a and text[b - 1].isdigit():
                b -= 1
        runs.append((a, b))
    if "@" in text or "(at)" in text or "[at]" in text or " at " in text:
        runs += [m.span() for m in _SPELT.finditer(text)]
    taken = sorted((s, e) for s, e, _ in base)
    ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    out = []
    for a, b in sorted(runs):
        i = bisect_right(ends, a)
        while i < len(taken) and taken[i][0] < b and a < b:
            out.append((a, taken[i][0]))
            a, i = max(a, ends[i]), i + 1
        out.append((a, b))
    cut = []
    for a, b in out:
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= 7:
            cut.append((a, b))
    return cut


def all_spans(text: str, crf: SemiCrf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the field's."""
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    for a, b in passages(text, base):
        if added and a < added[-1][1]:  # an address and a number may share a passage
            a = added[-1][1]
        if b - a >= 7:
            added += [(a + s, a + e, k) for s, e, k in crf.read(text[a:b], text[max(0, a - 30) : a], text[b : b + 10])]
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2]))


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_personal_data(docs: DataFrame, crf: SemiCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256, spans (base and added).

    Offsets are code points, ends exclusive. Null text counts as empty; repeated rows and null ids are kept; an empty
    table gives an empty result. Other columns are ignored.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for b in small(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base, every = all_spans(text, crf)
                counts = [0] * len(KINDS)
                for _, _, k in base:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), len(every) - len(base)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
