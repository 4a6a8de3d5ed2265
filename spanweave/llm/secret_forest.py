"""Secret scans with a random forest against false positives.

Patterns propose candidates: assigned values, credentials and path segments of URLs, and long tokens that mix letters
and digits, dotted ones too. A forest trained on labelled
findings then judges each by its length, its character transitions, how much of it a dictionary covers, whether it is
part of a path, and the words next to it.
"""

from __future__ import annotations

import math
import random
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, small

#: What counts as a candidate: the value of an assignment, a part of a URL, or a run of token characters (dots only
#: between them) with a letter and a digit.
ASSIGNED = regex.compile(r"""(?i)\b[a-z_-]*(?:token|secret|passw(?:or)?d|pwd|api_?key|key|auth|credential)s?\b["']?\s{0,3}(?:=>|[:=])\s{0,3}["']?([^\s"'<>,;]{8,})""")
TOKEN = regex.compile(r"(?<![A-Za-z0-9+/_=@-])(?<![A-Za-z0-9+/_=@-]\.)(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z])(?=[A-Za-z0-9+/_=.-]{16})[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+(?![@])")
URL = regex.compile(r"""(?i)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://([^\s"'<>]++)""")
_SEGMENT = regex.compile(r"[A-Za-z0-9+_=.~%-]*[A-Za-z0-9+_=-]")
_KEYS = regex.compile(r"(?i)token|secret|passw|pwd|key|auth|credential|bearer")
_BENIGN = regex.compile(r"(?i)sha|commit|digest|checksum|uuid|guid|version|etag|revision|image|example|href|src|url|path|file")
_WORDS = regex.compile(r"[a-z]{4,}")
#: Dictionary for coverage: common words that stand in identifiers, paths and placeholders.
DICTIONARY = frozenset("able about access account action address admin after again agent alpha amount android apache apple array assets async audit author backup based batch before beta binary block board body bool build bundle button bytes cache call card change changeme channel chart check child class clean click client clone close cloud code color column comma comment common compile config connect const content context control cookie copy count create credential current custom data database date debug default delete demo deploy desc design detail device digest direct disk display docs document domain double download draft drive dummy edit element email empty enable engine entry error event example export extra factor fake false feature field file filter final find first flag float folder font footer format forward frame free from full function game general generate global graph green group guide handler hash head header help here hidden history home host html http icon image import index info init inner input insert install inter item java job join json just keyboard kind label language large last layer layout left legal length level library license light limit line link linux list load local lock login logo long machine mail main make manager map mark master match media member memory menu merge message meta method middle minor mobile mode model module month more mouse move name native near network never next node none normal note null number object offset online only open option order other output over package page panel param parent parse part pass password path pattern phone photo pipeline place placeholder plain player plugin point policy port post power press price print private process product profile program project proxy public push python query queue quick random range rate read ready real record red refer region release remote remove render reply report request reset resource response rest result return right role root route rule safe sample save scale scan schema scope score screen script search second section secure select self send server service session setting share shell shop short show side sign simple site size skip small snapshot sort source space spark special stage standard start state static status step stop storage store stream string style submit support switch sync system table target task team temp template test text theme thread time title token tools total trace track train tree trial true type union unit update upload user util valid value variable vector version video view virtual visit wait watch week width widget window word work world write year your zone".split())


@lru_cache(maxsize=1)
def _transitions() -> np.ndarray:
    """Log-odds of letter pairs in dictionary words against uniform pairs."""
    counts = np.full((26, 26), 0.5)
    for w in DICTIONARY:
        for a, b in zip(w, w[1:]):
            counts[ord(a) - 97, ord(b) - 97] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True) * 26)


def _url_parts(text: str) -> list[tuple[int, int]]:
    """Spans in URLs: the password, or a long user name, before the host; long path and query segments after it."""
    out = []
    for m in URL.finditer(text) if "://" in text else ():
        start, end = m.span(1)
        host = next((k for k in range(start, end) if text[k] in "/?#"), end)
        at = text.rfind("@", start, host)
        if at >= 0:
            colon = text.find(":", start, at)
            user = at if colon < 0 else colon
            if user - start >= 16:
                out.append((start, user))
            if colon >= 0 and at - colon > 6:
                out.append((colon + 1, at))
        for part in _SEGMENT.finditer(text, host, end):
            a = max(part.start(), text.rfind("=", part.start(), part.end() - 3) + 1)  # the value of name=value
            value = text[a : part.end()]
            if len(value) >= 16 and any(c in string.digits for c in value) and any(c in string.ascii_letters for c in value):
                out.append((a, part.end()))
    return out


def _apart(spans, taken=()) -> list[tuple[int, int]]:
    """The spans, earlier and longer ones first, that overlap neither each other nor ``taken`` (both sorted)."""
    out: list[tuple[int, int]] = []
    k = 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (not out or a >= out[-1][1]) and (k == len(taken) or b <= taken[k][0]):
            out.append((a, b))
    return out


def _proposals(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Assigned values; and tokens and parts of URLs, without overlaps among themselves."""
    parts = _apart(_url_parts(text))
    tokens = _apart((m.span() for m in TOKEN.finditer(text)), parts)
    return [m.span(1) for m in ASSIGNED.finditer(text)], sorted(parts + tokens)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidates, without overlaps; an assigned value wins over all that overlaps it."""
    assigned, others = _proposals(text)
    return sorted(assigned + _apart(others, assigned))


def _kind(c: str) -> int:
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


def features(before: str, value: str, after: str) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    low = value.lower()
    counts = {c: low.count(c) for c in set(low)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    pairs = [(ord(a) - 97, ord(b) - 97) for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    table = _transitions()
    covered = sum(len(w) for w in _WORDS.findall(low) if w in DICTIONARY)
    covered = max(covered, sum(len(w) for w in DICTIONARY if len(w) > 5 and w in low))
    near = [w for w in before.split()[-4:] if "@" not in w]
    return [
        n,
        entropy,
        entropy / math.log2(max(n, 2)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(np.mean([table[a, b] for a, b in pairs])) if pairs else 0.0,
        min(covered / n, 1.0),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(max(counts.values()) / n),
        float(value.count("/") + value.count(".") > 0 or before[-1:] in "/.@" or after[:1] in "/@"),
        float(value.count("-") == 4 and n == 36),
        float(any(_KEYS.search(w) for w in near)),
        float(any(_BENIGN.search(w) for w in near)),
        float(before.rstrip(" \"'")[-1:] in ("=", ":", ">")),
        float(before[-1:] in "\"'" and before[-1:] != ""),
    ]


def labelled_findings(n: int = 1600, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(before, value, after, secret or not): made findings of known formats and of common false positives."""
    r = random.Random(seed)
    words = sorted(DICTIONARY)
    run = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    true = [
        lambda: run(40, hexa), lambda: run(32, hexa), lambda: run(64, hexa), lambda: "AKIA" + run(16, string.ascii_uppercase + string.digits), lambda: "ghp_" + run(36, alnum),
        lambda: "sk_live_" + run(24, alnum), lambda: run(r.randint(20, 60), alnum + "+/") + "=" * r.randint(0, 2), lambda: run(r.randint(16, 40), alnum), lambda: "xoxb-" + run(12, string.digits) + "-" + run(24, alnum), lambda: run(r.randint(8, 16), alnum + "!@#%^*"),
        lambda: "eyJ" + run(r.randint(17, 33), alnum) + ".eyJ" + run(r.randint(20, 80), alnum + "-_") + "." + run(43, alnum + "-_"), lambda: "SG." + run(22, alnum + "-_") + "." + run(43, alnum + "-_"), lambda: run(r.randint(8, 16), alnum) + r.choice("!@#%^*") + run(r.randint(2, 6), alnum) + r.choice(["", "-" + r.choice(words), "@" + "-".join(r.sample(words, 2))]),
    ]
    false = [
        lambda: "-".join(run(k, hexa) for k in (8, 4, 4, 4, 12)), lambda: "_".join(r.sample(words, 3)) + str(r.randint(1, 99)), lambda: "/".join(r.sample(words, 3)) + "/v" + str(r.randint(1, 9)), lambda: r.choice(["your_token_here", "changeme123", "xxxxxxxxxxxxxxxx1", "0000000000000000a", "example_password1", "placeholder_value_1"]),
        lambda: "-".join(r.sample(words, 4)) + "-20" + run(2, string.digits), lambda: "".join(w.capitalize() for w in r.sample(words, 4)) + str(r.randint(1, 99)), lambda: r.choice(words) + run(14, "0") + "1", lambda: run(40, hexa), lambda: run(64, hexa), lambda: "-".join(r.sample(words, 3)) + "-" + run(6, string.digits) + "-" + run(4, string.digits),
        lambda: ".".join([r.choice(words) + str(r.randint(1, 20)), *r.sample(words, 2), r.choice(["com", "org", "net"])]), lambda: "_".join(r.sample(words, 2)) + "_v" + str(r.randint(1, 9)) + r.choice([".tar.gz", ".min.js", ".parquet", ".html"]), lambda: ".".join(r.sample(words, 3)) + "." + r.choice(words).capitalize() + str(r.randint(1, 9)), lambda: "-".join(r.sample(words, 2)) + "-" + ".".join(str(r.randint(0, 30)) for _ in range(3)),
    ]
    out = []
    for i in range(n):
        lead = " ".join(r.sample(words, r.randint(0, 4)))
        tail = " " + " ".join(r.sample(words, 2))
        if i % 2:
            k = r.randrange(len(true))
            host = ".".join(r.sample(words, 2)) + r.choice([".com", ".net", ".io"])
            if k in (3, 4, 5, 7, 8) and r.random() < 0.3:  # a path segment or a query value of a URL
                out.append((f"{lead} https://{host}/" + r.choice(["services/", "hooks/", "bot/", f"v{r.randint(1, 4)}/", "?token=", "?key="]), true[k](), tail, 1))
                continue
            if k in (7, 9, 12) and r.random() < 0.3:  # a connection URL
                out.append((f"{lead} " + r.choice(["postgres", "mysql", "redis", "amqp", "https"]) + f"://{r.choice(words)}:", true[k]().replace("#", "%"), f"@{host}:5432/{r.choice(words)}" + tail, 1))
                continue
            bare = k not in (2, 9, 12) and r.random() < (0.25 if k < 2 else 0.5)
            key = r.choice(["token", "secret", "api_key", "password", "auth_token", "access_key", "SECRET_KEY"])
            how = r.choice([' = "', ": ", "=", " := '", '": "'])
            quote = how[-1] if how[-1] in "\"'" else ""
            out.append((f"{lead} " if bare else f"{lead} {key}{how}", true[k](), tail if bare else quote + tail, 1))
        else:
            k = r.randrange(len(false))
            if k in (7, 8):
                before = f"{lead} " + r.choice(["commit ", "sha256:", "checksum = \"", "digest: ", "revision ", "etag=\"", "href=\"/files/"])
            else:
                before = f"{lead} " + r.choice(["", "", "file ", "path = ", "url: ", "key: ", "token = \"", "https://host/", f"https://www.{r.choice(words)}.com/{r.choice(words)}/"])
            out.append((before, false[k](), tail, 0))
    return out


class Forest:
    """Random forest of classification trees over few features, grown on bootstrap samples."""

    def __init__(self, trees: int = 30, depth: int = 9, leaf: int = 4, seed: int = 11):
        self.trees, self.depth, self.leaf, self.seed, self.nodes = trees, depth, leaf, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            self.nodes.append(self._grow(x[rows], y[rows], rng))
        return self

    def _grow(self, x, y, rng) -> np.ndarray:
        """Rows of (feature or -1, cut, left, right, share of positives)."""
        nodes, todo = [], [(np.arange(len(y)), 0, None)]
        while todo:
            rows, depth, parent = todo.pop()
            here = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = here
            share = y[rows].mean()
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == self.depth or len(rows) < 2 * self.leaf or share in (0, 1):
                continue
            best = None
            for f in rng.choice(x.shape[1], max(2, round(x.shape[1] ** 0.5)), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], np.cumsum(y[rows][order])
                at = np.flatnonzero(v[1:] > v[:-1]) + 1
                at = at[(at >= self.leaf) & (at <= len(v) - self.leaf)]
                if at.size:
                    left, total = t[at - 1], t[-1]
                    gini = left * (1 - left / at) + (total - left) * (1 - (total - left) / (len(v) - at))
                    k = int(gini.argmin())
                    if best is None or gini[k] < best[0]:
                        best = gini[k], f, (v[at[k] - 1] + v[at[k]]) / 2
            if best:
                nodes[here][:2] = [best[1], best[2]]
                low = x[rows, best[1]] <= best[2]
                todo += [(rows[low], depth + 1, (here, 2)), (rows[~low], depth + 1, (here, 3))]
        return np.array(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.nodes:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = nodes[at, 0].astype(int)
                down = np.where(x[np.arange(len(x)), f] <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                at = np.where(f >= 0, down, at)
            total += nodes[at, 4]
        return total / max(len(self.nodes), 1)


def train(findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """A forest of labelled findings (a bounded list); without any, of ``labelled_findings()``."""
    findings = findings or labelled_findings()
    return Forest().fit(np.array([features(b[-60:], v, a[:60]) for b, v, a, _ in findings]), np.array([f[3] for f in findings]))


def find(text: str, forest: Forest, threshold: float = 0.5) -> tuple[list[tuple[int, int]], int]:
    """Spans of the secrets of a text, and the number of candidates. What lies in a rejected assigned value is judged too."""
    assigned, others = _proposals(text)
    spots = sorted(assigned + _apart(others, assigned))
    if not spots:
        return [], 0

    def judged(spans):
        scores = forest.score(np.array([features(text[max(0, a - 60) : a], text[a:b], text[b : b + 60]) for a, b in spans]))
        return [s for s, p in zip(spans, scores) if p >= threshold]

    found = judged(spots)
    rejected = [s for s in assigned if s not in set(found)]
    inner = [s for s in others if s not in set(spots) and any(a <= s[0] and s[1] <= b for a, b in rejected)] if rejected else []
    return sorted(found + judged(inner)) if inner else found, len(spots) + len(inner)


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_candidates, n_secrets, spans (start:end in code points, comma-joined).

    Whole texts are searched; null text counts as empty; null ids and repeated rows are kept; an empty table gives
    an empty result.
    """

    def run(batches):
        for b in small(batches):
            found = [find(t, forest, threshold) for t in b.column(1).to_pylist()]
            columns = [pa.array([n for _, n in found], pa.int64()), pa.array([len(s) for s, _ in found], pa.int64()), pa.array([",".join(f"{x}:{y}" for x, y in s) for s, _ in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_candidates", "n_secrets", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, spans string")


def mask(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text", filler: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced by ``filler``; null texts stay null."""

    def clean(text):
        spots = find(text, forest, threshold)[0] if text else []
        for a, b in reversed(spots):
            text = text[:a] + filler + text[b:]
        return text

    def run(batches):
        for b in small(batches):
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
