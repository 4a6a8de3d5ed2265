"""Copies in the pipeline: near ones against exact similarity of all pairs, exact ones with odd ids."""

import random

import numpy as np
import pytest
from plain import near_kept

import corpus_pipeline
from spanweave.llm import graph, shingle_join

MID = "/root/testdata/sf0.01"


def test_near_copies_share_four_fifths(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").where("n_chars < 6000").limit(600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.near(spark, df, MID).collect())
    assert got == near_kept(rows)


def test_near_copies_on_both_sides_of_the_threshold(spark):
    """Changed words give similarities of 0.55 to 0.95; boilerplate is shared by all."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    frame = [f"legal{k}" for k in range(30)]
    rows = []
    for k in range(60):
        base = r.choices(words, k=r.randint(60, 200))
        rows.append((10 * k, " ".join(base + frame)))
        for v in range(1, 4):
            other = list(base)
            for at in r.sample(range(len(base)), max(1, round(len(base) * r.choice([0.01, 0.02, 0.03, 0.04, 0.06])))):
                other[at] = r.choice(words)
            rows.append((10 * k + v if r.random() < 0.8 else None, " ".join(other + frame)))
    rows += [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "one three"), (None, "all alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(x.doc_id), x.text or "") for x in corpus_pipeline.near(spark, df, MID).collect())
    want = near_kept(rows)
    assert len(got) == len(want) and [i for i, _ in got] == [i for i, _ in want]
    assert corpus_pipeline.near(spark, df.where("false"), MID).count() == 0


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    """Copies with two changed words are similar to those with one, but not to each other: rows with one link each to a
    large group must not be held against all of it."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        other = list(base)
        for at in r.sample(range(5, 145), 2 if k < 300 else 1):
            other[at] = f"new{r.randrange(10**9)}"
        rows.append((k, " ".join(other)))
    pairs, verify = [], shingle_join._verify

    def counted(found, *args, **kwargs):
        if kwargs.get("screened"):
            pairs.append(found.count())
        return verify(found, *args, **kwargs)

    monkeypatch.setattr(shingle_join, "_verify", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(x.doc_id), x.text) for x in corpus_pipeline.near(spark, df, MID).collect())
    assert got == near_kept(rows)
    assert 0 < sum(pairs) < 10 * len(rows)


def test_likeliest_pairs_are_no_more_than_rows():
    """At one shingle every row is met, the likeliest of each group is named once, and rows that meet nobody go."""
    own = [np.arange(k, k + 100) for k in (0, 1, 3, 6, 0, 5000)]
    bits = np.stack([np.frombuffer(shingle_join.parity(x), np.uint64) for x in own])
    h, row, group = np.full(6, 7), np.arange(10, 16), np.array([10, 11, 12, 13, 10, 15])
    ((h, at, _, other),) = shingle_join._likeliest(h, row, np.full(6, 100 << 32), group, bits)
    assert dict(zip(at.tolist(), other.tolist())) == {10: 11, 14: -1, 11: 10, 12: 11, 13: 12}


def test_near_copies_of_hard_rows(spark):
    """Repeated rows, ids of several texts, null ids among copies, a very long text and columns of clashing names."""
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, None), (3, None), (4, ""), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (5, "quite another text here"), (None, "q r s"), (None, "q r s")]
    names = "doc_id long, text string, row long, n int, fp long, h1 long, _id long, _null boolean, component long, prefix string"
    df = spark.createDataFrame([(*r, 7, 7, 7, 7, 7, True, 7, "p") for r in rows], names).repartition(3)
    out = corpus_pipeline.near(spark, df, MID)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, long), (3, None), (3, None), (4, ""), (5, "a b c d e f"), (5, "quite another text here"), (None, "q r s")], key=str)


def test_exact_copies_with_null_and_repeated_ids(spark):
    rows = [
        (None, "unique without id"), (None, "twice without id"), (None, "twice  without id"), (None, "held by seven"), (7, "held by seven"),
        (1, "one id"), (1, "another text of one"), (2, "another text of one"), (3, "same again"), (3, "same again"), (3, "same  again"),
        (5, "lost here"), (4, "lost here"), (5, "kept here"), (None, None), (9, ""),
    ]
    want = [(None, "unique without id"), (None, "twice  without id"), (7, "held by seven"), (1, "one id"), (1, "another text of one"), (3, "same  again"), (4, "lost here"), (5, "kept here"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 6):
        got = corpus_pipeline.exact(spark, df.repartition(parts), MID)
        assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.exact(spark, df.where("false"), MID).count() == 0
    far = spark.createDataFrame([(None, "alone and far from all"), (None, "another of its own kind"), (1, "with an id here")], "doc_id long, text string")
    assert corpus_pipeline.near(spark, far, MID).count() == 3


def test_components_that_are_not_final_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, max_rounds=2)
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
