"""Top-k search, vector codes and the source audit against plain versions and DuckDB, and their hard rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from spanweave.llm import delta_lloyd, queries, source_divergence, topk_postings

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row long, v string, code long, score long, block int"


@pytest.mark.parametrize("name", ["op11_topk_postings", "op12_delta_lloyd", "op13_source_divergence"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SMALL).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", 2, 3, 4) for i, v, label in rows], VECTORS).repartition(3)


def hard_vectors(n=150, width=8, seed=5):
    """Ties, repeats, a hot vector, nulls everywhere, non-finite components, unlike lengths."""
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.integers(-3, 4, width) / 8], int(r.integers(0, 3)) if i % 7 else None) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(200, 260)]
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (None, None, None), (300, None, 1), (301, [math.nan] * width, 1), (302, [1.0, None] * 4, 1), (303, [math.inf] + [0.0] * 7, 1)]
    rows += [(320, [0.5, -0.25, 1.0], None), (340, [], 1), (-20, [1.0] * 12, 1)]
    return rows


def clean(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_top(rows, k, every=20, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in clean(rows)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-max(min(sum(x * y for x, y in zip(q, v)), 2**63 - 1), -(2**63)), j is None, j or 0) for b, (j, v) in enumerate(kept) if a != b)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_top_k_on_hard_rows(spark, monkeypatch):
    rows = hard_vectors()
    df = frame(spark, rows)
    same(topk_postings.top_k(df).collect(), plain_top(rows, 20))
    same(topk_postings.top_k(df, k=500, every=7, scale=3).collect(), plain_top(rows, 500, 7, 3))
    monkeypatch.setattr(topk_postings, "BLOCK", 300)
    monkeypatch.setattr(topk_postings, "SLICE", 60)  # many blocks and slices
    same(topk_postings.top_k(df, k=5, every=2).collect(), plain_top(rows, 5, 2))
    assert topk_postings.top_k(df.where("false")).count() == 0
    assert topk_postings.top_k(df.where("vec_id IS NULL")).count() == 0
    assert topk_postings.top_k(df.where("vec_id = 40")).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, -1.0], 0), (2, [-1e30, 0.5], 0), (3, [float(2**40), 2.0], 0), (20, [0.25, float(2**45)], 0)]
    got = topk_postings.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    same(got.collect(), plain_top(rows, 20))


def test_sparse_accumulation():
    r = np.random.default_rng(2)
    x = r.integers(-9, 9, (300, 40)) * (r.random((300, 40)) < r.random(40))
    q = r.integers(-9, 9, (30, 40)) * (r.random((30, 40)) < r.random(40))
    scores = np.zeros((300, 30), dtype=np.int64)
    topk_postings.accumulate(topk_postings.postings(x), q, scores)
    assert (scores == x @ q.T).all()


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, v, label) for i, v, label in clean(rows)]
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    ints = [[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    d = width // parts
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(ints[k], p) for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in ints]  # noqa: B023, E731
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(ints, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes = assign()
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes)]
    total = Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return [(i, bytes(c).hex(), min(e, most), min(total[label], most), digest) for (i, _, label), c, e in zip(kept, codes, errors)]


def test_codes_on_hard_rows(spark):
    rows = hard_vectors(n=230, width=32)
    df = frame(spark, rows)
    same(delta_lloyd.compress(df).collect(), plain_codes(rows))
    same(delta_lloyd.compress(df, parts=4, entries=9, rounds=5, scale=10).collect(), plain_codes(rows, 4, 9, 5, 10))
    few = rows[:5]
    same(delta_lloyd.compress(frame(spark, few)).collect(), plain_codes(few))
    assert delta_lloyd.compress(df.where("false")).count() == 0
    assert delta_lloyd.compress(df.where("vec_id = 340")).first()["code"] == "00" * 16


def test_codes_of_huge_components(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=16) * 10.0 ** int(r.integers(0, 20))], i % 2) for i in range(90)]
    same(delta_lloyd.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), plain_codes(rows))
    with pytest.raises(Exception, match="too large"):
        delta_lloyd.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_only_changed_parts_are_moved(spark):
    """After the first round, contributions come from changed assignments alone, and cancel out in the counts."""
    rows = spark.createDataFrame([(i, [float(i % 5)] * 4) for i in range(40)], "vec_id long, v array<double>")
    code = lambda b: bytearray(b)
    both = spark.createDataFrame([(i, code([i % 5] * 2), code([i % 5, 4 if i % 5 == 3 else i % 5])) for i in range(40)], "vec_id long, was binary, code binary")
    got = {(p, e): [int(x) for x in c] for p, e, c in delta_lloyd._deltas(rows.join(both, "vec_id"), 2, 4, 1)}
    assert got == {(1, 3): [-8, -24, -24], (1, 4): [8, 24, 24]}


def plain_audit(rows, least, top):
    words = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, c in words:
        groups[lang].add(source)
        df[lang].update(set(c))
        count[lang, source].update(c)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (n[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (sum(n.values()) + 5 * v) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, r) for part, found in (("pair", pairs), ("term", terms)) for r, (value, item) in enumerate(found, 1)]
    return out


def test_audit_on_hard_rows(spark, monkeypatch):
    r = np.random.default_rng(7)
    pool = ["Été", "ÉTÉ", "the", "The", "THE", "naïve", "日本語", "x1y", "it's", "a_b", "Ünï", "zz", " nbsp", "🙂", "a\x00b", "q\tq", "İ"]
    rows = [(" ".join(r.choice(pool, int(r.integers(0, 30)))), r.choice(["en", "fr"]), r.choice(["s1", "s2", "é", "S3"], p=[0.7, 0.1, 0.1, 0.1])) for _ in range(200)]
    rows = [(str(t), str(a), str(b)) for t, a, b in rows]
    rows += [rows[0]] * 40 + [(None, "en", "only nulls"), ("", None, None), ("the THE", None, "x"), (None, None, None), ("rare words", "xx", "a"), ("other", "xx", "b"), ("", "yy", "single"), ("Long wörds of TEXT " * 3000, "en", "s2"), ("lang", "a\x00b", "s"), ("lang", "a", "s"), ("lang", "a", "t")]
    names = "text string, lang string, source string, term string, key long, document long, count long, salt int"
    df = spark.createDataFrame([(*x, "t", 1, 2, 3, 4) for x in rows], names).repartition(5)
    for least, top in ((30, 50), (3, 4), (1, 50)):
        assert sorted(map(tuple, source_divergence.audit(df, least, top).collect())) == sorted(plain_audit(rows, least, top))
    monkeypatch.setattr(source_divergence, "_SOURCES", 2)  # several passes over pairs
    assert sorted(map(tuple, source_divergence.audit(df, 2, 9).collect())) == sorted(plain_audit(rows, 2, 9))
    assert source_divergence.audit(df.where("false")).count() == 0


def test_audit_in_small_chunks(monkeypatch):
    """Long texts in pieces, and stretches of a few documents, give what all at once does."""
    monkeypatch.setattr(source_divergence, "_CHUNK", 40)
    text = ("alpha " * 30 + "Beta\x00gamma é" * 9).encode()
    assert [w for p in source_divergence.pieces(text) for w in p.split()] == text.translate(source_divergence._FOLD).split()
    total = Counter()
    for n in range(1, 4):
        b = source_divergence._combined([("en", "s", text.translate(source_divergence._FOLD), k) for k in range(n)])
        total.update(dict(zip(b.column(0).to_pylist(), b.column(3).to_pylist())))
    assert set(total.values()) == {6}
    one = source_divergence._long_text("en", "s", text, 3)
    b = source_divergence._combined([("en", "s", text.translate(source_divergence._FOLD), 3)])
    assert sorted(map(str, one.to_pylist())) == sorted(map(str, b.to_pylist()))


def test_shares_are_exact():
    r = np.random.default_rng(1)
    a = r.integers(1, 9 * 10**14, 2000)
    b = a + r.integers(0, 8 * 10**14, 2000)
    assert source_divergence.shares(a, b, 10**9).tolist() == [1 + 10**9 * int(x) // int(y) for x, y in zip(a, b)]
