"""Quality by co-training of two classifiers.

One sees the text's content, the other the page's metadata (language, source, stated length). Both start from a bounded
sample of labelled rows. In every round each is asked about all unlabelled rows, and those it is sure about, in both
classes, become pseudo-labels for the other: every such row takes part, through sums of gradients and curvatures that
Spark adds up, so that what reaches the driver is the same at every size. Pseudo-labels of a class weigh at most
``trust`` of its labelled rows, more from round to round. Each classifier is calibrated on labelled rows it never
trained on, and the calibrated log-odds are combined to score all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written

_WORD = regex.compile(r"\w+")
_SOURCES = 32


def content_features(text: str) -> list[float]:
    """Of the whole text: shares of character kinds, word and line repetition, word shape."""
    n = max(len(text), 1)
    pieces = text.split()
    words = max(len(pieces), 1)
    counts = Counter(pieces)
    pairs = Counter(zip(pieces, pieces[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _WORD.findall(text)))
    upper = sum(1 for p in pieces if p.isupper() and len(p) > 1)
    bare = sum(1 for p in counts if not _WORD.search(p))
    ended = sum(1 for x in lines if x.rstrip()[-1:] in ".!?\"'")
    odd = sum(c for p, c in counts.items() if p[-1:] in "!#$%&*|")
    return [
        np.log1p(len(text)),
        letters / n,
        len("".join(pieces)) / words,
        upper / words,
        sum(c for p, c in counts.items() if not _WORD.search(p)) / words,
        bare / words,
        odd / words,
        len(counts) / words,
        max(counts.values(), default=0) / words,
        max(pairs.values(), default=0) / words,
        sum(c - 1 for c in pairs.values()) / words,
        len(set(lines)) / max(len(lines), 1),
        ended / max(len(lines), 1),
        sum(map(text.count, "0123456789")) / n,
        np.log1p(words / max(len(lines), 1)),
    ]


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * (8 + _SOURCES + 2)
    out[zlib.crc32((lang or "").encode()) % 8] = 1.0
    out[8 + zlib.crc32((source or "").encode()) % _SOURCES] = 1.0
    size = np.log1p(max(n_chars or 0, 0))
    out[-2:] = [size, size * size / 10]
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps, on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ridge: float = 3.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Logistic:
        model = cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(x.shape[1] + 1), ridge)
        for _ in range(15):
            model = model.step(x, y)
        return model

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def sums(self, x: np.ndarray, y, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss over rows, at these weights; or the curvature's upper bound."""
        z = self.columns(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (p - y), (z * (np.full(len(p), 0.25) if bound else p * (1 - p) + 1e-9)[:, None]).T @ z

    def step(self, x: np.ndarray, y: np.ndarray, more: list[tuple[float, np.ndarray, np.ndarray]] | None = None) -> Logistic:
        """One Newton step over rows; with others, of which (weight, gradient, bound of the curvature) are given, a step
        by the bound: it never raises the loss, however sure and wrong this view was of the others' labels."""
        gradient, curve = self.sums(x, y, bound=more is not None)
        penalty = np.append(np.full(len(self.weights) - 1, self.ridge), 1e-6)
        for weight, g, h in more or ():
            gradient, curve = gradient + weight * g, curve + weight * h
        # rounded, as the order in which Spark adds up sums is not fixed
        return Logistic(self.mean, self.scale, np.round(self.weights - np.linalg.solve(curve + np.diag(penalty), gradient + penalty * self.weights), 7), self.ridge)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.columns(x) @ self.weights, -30, 30)


@dataclass
class CoTrained:
    """Two views with their calibrations (slope, intercept) and the prior log-odds."""

    views: tuple[Logistic, Logistic]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        total = np.full(len(content), self.prior)
        for view, (slope, shift), x in zip(self.views, self.calibration, (content, metadata)):
            total += slope * view.odds(x) + shift - self.prior
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    model = Logistic.fit(odds[:, None], y, ridge=0.5)
    slope = float(model.weights[0] / model.scale[0])
    return slope, float(model.weights[1] - slope * model.mean[0])


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def pseudo_sums(models, free: tuple[np.ndarray, np.ndarray], sure: float) -> np.ndarray:
    """For each learner and class: how many rows the other view is sure of, their gradient and bound of curvature; flat."""
    out = []
    for learner in (0, 1):
        chance = _chance(models[1 - learner].odds(free[1 - learner]))
        for label, rows in ((0, chance <= 1 - sure), (1, chance >= sure)):
            g, h = models[learner].sums(free[learner][rows], float(label), bound=True)
            out += [[float(rows.sum())], g, h.ravel()]
    return np.concatenate(out)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, sums_of, rounds: int, trust: float) -> CoTrained:
    """Co-train on labelled rows (views, y) and on ``sums_of(models)``, the ``pseudo_sums`` over all unlabelled rows.

    A third of the labelled rows is kept for calibration, or none where that third lacks a class. Without labelled rows
    of both classes the model is the prior: the same for all documents, an even chance where there is no label at all.
    """
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[held])) < 2:
        held[:] = False
    rest = held if held.any() else ~held
    prior = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    if len(set(y[~held])) < 2:
        none = tuple(Logistic(np.zeros(v.shape[1]), np.ones(v.shape[1]), np.zeros(v.shape[1] + 1)) for v in views)
        return CoTrained(none, ((0.0, prior), (0.0, prior)), prior)
    xs, own = [v[~held] for v in views], y[~held]
    models = [Logistic.fit(x, own) for x in xs]
    for k in range(1, rounds + 1):
        flat, at, steps = sums_of(models), 0, []
        for learner in (0, 1):
            width, more = len(models[learner].weights), []
            for labelled in ((1 - own).sum(), own.sum()):
                n, g, h = flat[at], flat[at + 1 : at + 1 + width], flat[at + 1 + width : at + 1 + width + width * width]
                at += 1 + width + width * width
                if n:
                    more.append((min(1.0, trust * k / rounds * labelled / n), g, h.reshape(width, width)))
            steps.append(more)
        models = [m.step(x, own, more) for m, x, more in zip(models, xs, steps)]
    calibration = tuple(_calibrate(m.odds(v[rest]), y[rest]) for m, v in zip(models, views))
    return CoTrained(tuple(models), calibration, prior)


#: Columns of ``featured``.
CONTENT, META = "__content", "__metadata"


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist() if name in batch.schema.names else [None] * batch.num_rows
    if CONTENT in batch.schema.names:
        return tuple(np.array(column(c), dtype=float).reshape(batch.num_rows, -1) for c in (CONTENT, META))
    content = [content_features(t or "") for t in column("text")]
    meta = [metadata_features(*m) for m in zip(column("lang"), column("source"), column("n_chars"))]
    return np.array(content, dtype=float).reshape(batch.num_rows, -1), np.array(meta, dtype=float).reshape(batch.num_rows, -1)


def featured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``docs`` with the features of both views, as a table: texts are read once."""
    keep = docs.columns if keep is None else keep
    fields = [f for f in docs.schema.fields if f.name in keep]
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField(CONTENT, arrays), T.StructField(META, arrays)])
    used = [c for c in docs.columns if c in keep or c in ("text", "lang", "source", "n_chars")]

    def run(batches):
        for b in small(batches):
            own = [b.column(b.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), pa.list_(pa.float64())) for v in _views(b))], names=schema.names)

    return written(docs.select(*used).mapInArrow(run, schema), "features")


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, rounds: int = 5, trust: float = 0.5, sure: float = 0.95) -> CoTrained:
    """Co-train on ``most_labelled`` labelled rows at most, first by hashed id, and on all unlabelled rows.

    docs: documents, or what ``featured`` made of them. labels: doc_id, quality (1 good, 0 bad; null rows don't count, of
    several labels of an id the lowest counts). A row without an id is unlabelled. For empty tables and for labels of
    one class see ``co_train``.
    """
    rows = docs if CONTENT in docs.columns else featured(docs, ["doc_id"])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), CONTENT, META)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64(CONTENT)]
    own = written(rows.join(known, "doc_id").orderBy(*order).limit(most_labelled), "labelled").collect()  # as a table first, so that the driver gets no more than these rows
    own.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    width = len(content_features("")), len(metadata_features(None, None, None))
    views = tuple(np.array([r[k + 1] for r in own], dtype=float).reshape(-1, width[k]) for k in (0, 1))
    y = np.array([float(r.quality) for r in own])
    free = written(rows.join(known, "doc_id", "left_anti").select(CONTENT, META), "unlabelled") if len(set(y)) == 2 else None

    def sums_of(models) -> np.ndarray:
        def run(batches):
            total = pseudo_sums(models, tuple(np.empty((0, w)) for w in width), sure)
            for b in small(batches, 4000):
                total = total + pseudo_sums(models, _views(b), sure)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

        got = dict(free.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
        size = sum(2 * (1 + (w + 1) + (w + 1) ** 2) for w in width)
        return np.array([got.get(k, 0.0) for k in range(size)])

    return co_train(views, y, sums_of, rounds, trust)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """All rows and columns of ``docs`` (or of what ``featured`` made of it, without the features) with quality_score
    (probability); a column of that name is replaced.

    Null text is empty, null or missing metadata has features of its own; empty tables give empty results.
    """
    base = docs.drop("quality_score")
    fields = [f for f in base.schema.fields if f.name not in (CONTENT, META)]
    schema = T.StructType([*fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        for b in small(batches):
            own = [b.column(b.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(model.score(*_views(b)), pa.float64())], names=schema.names)

    return base.mapInArrow(run, schema)
