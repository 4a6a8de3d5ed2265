"""Interval joins against all pairs in plain Python."""

import random

from spanweave.operators import intervals

WORDS = "doc_id string, page_no int, word string, char_start long, char_end long, x0 double, y0 double, x1 double, y1 double"


def made(seed, n=400):
    r = random.Random(seed)
    at = lambda: r.choice([None, *range(60)]) if r.random() < 0.05 else r.randrange(60)
    spans, words = [], []
    for i in range(n):
        a, b = at(), at()
        a, b = (a, b) if a is None or b is None else (min(a, b), max(a, b))
        spans.append((r.choice(["d1", "d2", None, "hot", "hot", "hot"]), r.choice("AB"), a, b))
        a = at()
        words.append((r.choice(["d1", "d2", None, "d3", "hot"]), r.choice([1, 2]), f"w{i}", a, None if a is None else a + r.randrange(6), *[r.choice([None, float(i), -1.0]) for _ in range(4)]))
    return spans + spans[:20], words


def touches(s, w):
    return None not in (s[0], s[2], s[3], w[3], w[4]) and s[0] == w[0] and w[3] < s[3] and s[2] < w[4]


def union(ws):
    pick = lambda k, f: f([w[k] for w in ws if w[k] is not None], default=None)
    return pick(5, min), pick(6, min), pick(7, max), pick(8, max)


def key(row):
    return [(x is None, str(x)) for x in row]


def test_overlaps(spark):
    spans, words = made(1)
    s = spark.createDataFrame(spans, "doc_id string, type string, start long, end long").repartition(3)
    w = spark.createDataFrame(words, WORDS).withColumnsRenamed({"char_start": "ws", "char_end": "we"}).repartition(2)
    got = [tuple(r) for r in intervals.overlaps(s, w, ["doc_id"], right_ends=("ws", "we")).collect()]
    want = [(*a, *b[1:]) for a in spans for b in words if touches(a, b)]
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 1000
    plan = intervals.overlaps(s, w, ["doc_id"], right_ends=("ws", "we"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert intervals.overlaps(s.where("false"), w, ["doc_id"], right_ends=("ws", "we")).count() == 0


def test_touched_boxes(spark):
    spans, words = made(2)
    got = intervals.touched_boxes(spark.createDataFrame(spans, "doc_id string, type string, start long, end long").repartition(3), spark.createDataFrame(words, WORDS))
    want = []
    for s in set(spans):
        for page in (1, 2):
            own = [w for w in words if w[1] == page and touches(s, w)]
            want += [(*s, page, *union(own))] if own else []
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_enclosed_boxes(spark):
    spans, words = made(3)
    chunks = [(f"c{i}", d, 1 + i % 2, a, b) for i, (d, _, a, b) in enumerate(spans)]
    got = intervals.enclosed_boxes(spark.createDataFrame(chunks, "chunk_id string, doc_id string, page_no int, char_start long, char_end long").repartition(3), spark.createDataFrame(words, WORDS))
    inside = lambda c, w: None not in (c[1], c[3], c[4], w[3], w[4]) and (c[1], c[2]) == w[:2] and w[3] >= c[3] and w[4] <= c[4]
    want = [(c[0], *union([w for w in words if inside(c, w)])) for c in chunks]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_rows_that_stay_open_over_batches(spark):
    """Arrow batches of seven rows: what is open goes on into the next ones, as in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for test in (test_overlaps, test_touched_boxes, test_enclosed_boxes):
            test(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_batch_is_swept_at_once():
    """200,000 words in batches as Spark hands them over cost a few numpy calls a batch, not a Python step a word."""
    import sys

    import numpy as np
    import pyarrow as pa

    n = 200_000
    at = np.arange(n, dtype=np.int64) // 2
    kinds = [pa.struct([("v", pa.int64())])] * 2
    side = np.arange(n, dtype=np.int32) % 2
    rows = pa.RecordBatch.from_arrays([pa.array(["d"] * n), pa.array(at), pa.array(at + 1), pa.array(side), *[pa.array([{"v": 1}] * n, k) for k in kinds]], names=["doc_id", "_start", "_end", "_side", "_l", "_r"])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        pairs = sum(len(i) for s in intervals._steps((rows.slice(k, 10_000) for k in range(0, n, 10_000)), []) for i, _ in intervals._pairs(s))
    finally:
        sys.setprofile(None)
    assert pairs == n // 2 and calls < n // 20


def test_rows_are_handed_over_flat(spark):
    """The sweep sorts and hands over plain columns, of words only what is united."""
    spans = spark.createDataFrame([("d", "A", 0, 4)], "doc_id string, type string, start long, end long")
    words = spark.createDataFrame([("d", 1, 0, 3, 0.0, 1.0, 2.0, 3.0, "abc")], "doc_id string, page_no int, char_start long, char_end long, x0 double, y0 double, x1 double, y1 double, word string")
    plan = intervals.touched_boxes(spans, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(" not in plan and "_r:page_no" in plan and "_r:char_start" not in plan
    assert [tuple(r) for r in intervals.touched_boxes(spans, words).collect()] == [("d", "A", 0, 4, 1, 0.0, 1.0, 2.0, 3.0)]
    paired = intervals.overlaps(spans, words.withColumnRenamed("char_start", "a").withColumnRenamed("char_end", "b"), ["doc_id"], right_ends=("a", "b"))
    assert [tuple(r) for r in paired.collect()] == [("d", "A", 0, 4, 1, 0, 3, 0.0, 1.0, 2.0, 3.0, "abc")]
