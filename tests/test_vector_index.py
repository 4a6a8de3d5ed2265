"""The vector index against brute force: exact results, and the recall of its first step."""

import math

import numpy as np

from spanweave.operators import vector_index

KIND = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in sound:
        if i in asked:
            near = sorted((-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), j) for j, v in sound if j != i and len(v) == len(q))
            out[i] = [j for _, j in near[:k]]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def clustered(n, width=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(25, width))
    return [(i, [float(x) for x in centres[r.integers(25)] + 0.25 * r.normal(size=width)]) for i in range(n)]


def test_exact_and_recall(spark, monkeypatch):
    rows = clustered(3000)
    rows += [(5000 + i, rows[7][1]) for i in range(400)]  # a hot vector
    rows += [(None, rows[0][1]), (9001, None), (9002, []), (9003, [0.0] * 16), (9004, [math.nan] * 16), (9005, [None] + [1.0] * 15), (9006, [1.0, 2.0])]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    monkeypatch.setattr(vector_index, "BLOCK", 100)  # crowded cells in several blocks
    monkeypatch.setattr(vector_index, "SLICE", 10)
    index = vector_index.build(df)
    assert index.rows.count() == 3400 and index.blocks.max() > 3
    asked = df.where("vec_id % 100 = 0 OR vec_id IN (9003, 9006)")
    want = brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    assert lists(vector_index.search(index, asked, 10)) == want
    near = lists(vector_index.search(index, asked, 10, exact=False))
    recall = sum(len(set(near[i]) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert vector_index.build(df.where("false")) is None
    assert vector_index.search(index, asked.where("false"), 10).count() == 0


def test_fewer_rows_than_asked_for(spark):
    rows = clustered(5)
    df = spark.createDataFrame(rows, KIND)
    assert lists(vector_index.search(vector_index.build(df, cells=2), df, 10, probes=1)) == brute(rows, set(range(5)), 10)
