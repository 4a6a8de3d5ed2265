"""Pages, vectors, quality and the pipeline."""

import html
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from plain import near_kept
from tokenizers import Tokenizer

import corpus_pipeline
from spanweave.llm import cotraining, epsilon_grid, graph, harmonic, secret_forest, site_style_tree

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def articles(folder):
    found = {}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall():
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        found[page_id] = "\n\n".join(b for b in blocks if b)
    return found


def test_articles(spark):
    rows = {r.page_id: r for r in site_style_tree.extract(spark.read.parquet(f"{MID}/pages.parquet")).collect()}
    assert {k: r.text for k, r in rows.items()} == articles(MID)
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_tree_alone_finds_articles(spark):
    """Without the prior: on hosts of enough pages, the tree cuts menus, adverts and footers whose texts are all different."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = articles("/root/testdata/sf0.1")
    rows = site_style_tree.extract(pages, prior=0).collect()
    assert sum(r.text == want[r.page_id] for r in rows) > 0.95 * len(rows)
    assert sum(r.n_cut > 0 for r in rows) > 0.95 * len(rows)


def test_tree_on_sites_without_telling_names(spark):
    """Three sites, no class name that means anything: one of articles of all lengths, one whose articles are of one form,
    where the form must not speak against them, and one of few pages."""
    r = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{k}" for k in r.integers(0, 5000, n))
    rows, want = [], {}
    for i in range(60):
        site = ("a", "b", "c")[0 if i < 30 else 1 if i < 57 else 2]
        paragraphs = [words(30) for _ in range(r.integers(1, 9) if site != "b" else 3)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<body><div class=x1><span>{words(3)}</span></div><div class=k2><ul><li>{words(1)}<li>{words(1)}</ul></div><div class=z><h2>{words(4)}</h2>{body}</div><div class=q9>{words(8)}</div></body>"
        rows.append((i, f"https://{site}.example/{i}", page))
        want[i] = paragraphs
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for x in site_style_tree.extract(df).collect():
        blocks = x.text.split("\n\n")
        assert all(p in blocks for p in want[x.page_id])
        assert len(blocks) == (len(want[x.page_id]) + 1 if x.page_id < 30 else len(want[x.page_id]) + 5)


def test_pages_of_hard_rows(spark):
    """Null and empty html, repeated rows, a very long page, columns of clashing names; what the contract names is dropped, no more."""
    long = "<p>" + "word " * 200_000 + "</p>"
    inside = "<body class=no-sidebar><article><header class=entry-header><h1>T</h1></header><p>a <math><mi>x</mi></math> b</p><xmp>code</xmp><div class=share-of-votes>kept</div><div class='related work'>kept too</div><div class=ad>gone</div><form>gone<button>gone</button></form><div id=comments>gone</div></article></body>"
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/", inside), (3, "http://h/", inside), (None, "http://h/", long)]
    df = spark.createDataFrame([(*x, "c", 1, 2, [3]) for x in rows], "page_id long, url string, html string, host string, node long, page long, low array<long>").repartition(3)
    got = sorted(((x.page_id, x.text) for x in site_style_tree.extract(df).collect()), key=str)
    text = "T\n\na x b\n\ncode\n\nkept\n\nkept too"
    assert got == sorted([(1, ""), (2, ""), (3, text), (3, text), (None, ("word " * 200_000).strip())], key=str)


def test_style_tree_cuts_what_every_page_repeats(spark):
    page = "<body><div class=top>Our shop</div><div class=body{0}><p>Story {0} about {0}</p><div class='cookie'>no</div></div><section class=last>Call us</section></body>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(8)] + [(90, None, "<p>x &amp; y<script>no</script>"), (91, "http://one.example/", None), (92, "http://two.example", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table> e < f"), (None, "http://h.example/z", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r.text for r in site_style_tree.extract(df).collect()}
    assert all(rows[i] == f"Story {i} about {i}" for i in range(8))
    assert rows[90] == "x & y" and rows[91] == "" and rows[92] == "a\n\nb\n\nc\n\nd\n\ne < f" and rows[None] == ""
    assert site_style_tree.extract(df.where("false")).count() == 0
    tree = site_style_tree.style_tree(df).where("host = 'h.example' AND pages = 8").collect()
    assert min(r.content for r in tree) == pytest.approx(0) and max(r.content for r in tree) == pytest.approx(1)
    assert math.isclose(sum(r.presentation for r in tree if r.presentation > 0.99), 0)


@pytest.mark.parametrize("altered", [False, True])
def test_style_tree_keeps_articles_that_a_host_repeats(spark, altered):
    """Copies, whole or with one paragraph of their own, must not make article text look like a template."""

    def page(title, paragraphs, n):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        return f"<html><body><nav>Page {n}</nav><article><h1>{title}</h1>{body}</article></body></html>", "\n\n".join([title, *paragraphs])

    made = [page("Twice told", [f"Told paragraph {k}." for k in range(15)] + [f"Note {i}."] * altered, i) for i in range(14)]
    made += [page(f"Title {i}", [f"Own paragraph {i}.{k}." for k in range(5)], i) for i in range(20)]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r.text for r in site_style_tree.extract(df).collect()}
    assert rows == {i: text for i, (_, text) in enumerate(made)}
    if not altered:
        assert {r.pages for r in site_style_tree.style_tree(df).collect()} == {21}


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = [r.normal(size=16) for _ in range(120)]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    vectors += [(200 + k, [float(np.float32(x)) for x in base[int(r.integers(0, 20))] + r.normal(0, r.choice([0, 0.1, 0.2, 0.3]), 16)]) for k in range(300)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.0])]
    every = vectors + odd
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in every], "vec_id long, embedding array<float>, rep long, copies long").repartition(4)
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = {**dict.fromkeys((i for i, _ in odd), 0), **dict(zip(ids, near.sum(axis=1).tolist())), 905: 1, 906: 1}
    parent = {i: i for i, _ in every}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in [*((ids[a], ids[b]) for a, b in zip(*np.nonzero(near))), (905, 906)]:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    for leaf in (25, 2000):
        got = {(v.vec_id, v.n_links, v.component_id, v.kept) for v in epsilon_grid.near_vectors(df, leaf=leaf, leading=6).collect()}
        assert got == {(i, links[i], root(i), root(i) == i) for i, _ in every}
    assert epsilon_grid.near_vectors(df.where("false")).count() == 0


def test_vectors_without_ids(spark):
    """A null id alone, two that are equal, one equal to a vector with an id, one near it, and two near each other."""
    near = [1.0, 0.1, 0.0, 0.0]
    rows = [(None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (None, near), (None, [0.0, 0.0, 0.0, 1.0]), (None, [0.0, 0.0, 0.1, 1.0]), (None, None)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        got = Counter(tuple(r) for r in epsilon_grid.near_vectors(df).collect())
        assert got == Counter([(None, 0, None, False), (None, 1, None, False), (None, 1, None, False), (5, 2, 5, True), (None, 2, 5, False), (None, 2, 5, False), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False)])
    assert epsilon_grid.near_vectors(spark.createDataFrame([(None, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect() == [(None, 0, None, False)]


def test_distant_blocks_are_skipped():
    """Boxes skip pairs of blocks, and never one that holds a near pair."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + r.normal(0, 0.15, size=(300, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :6]
    at = epsilon_grid._place(x, mean, axes)
    starts = np.arange(0, len(x), 100)
    low, high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
    eps = float(np.sqrt(0.2))
    open_ = epsilon_grid.near_blocks(low, high, low, high, eps)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert open_[i // 100, j // 100].all() and open_.mean() < 0.5


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(50)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {(x.node, x.component) for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, root(v)) for e in edges if e[0] != e[1] for v in e}


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    model = cotraining.fit(docs, train)
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in cotraining.score(docs.where("doc_id % 2 = 1"), model).collect() if r.doc_id in held]
    counts = Counter((held[r.doc_id], r.quality_score >= 0.5) for r in rows)
    assert counts[1, True] / (counts[1, True] + counts[1, False]) > 0.99
    assert counts[0, False] / (counts[0, True] + counts[0, False]) > 0.95
    odd = spark.createDataFrame([(None, None, None, None, None, 2.0), (1, "", "xx", "s", 0, 2.0), (2, "word " * 20_000, None, None, -5, 2.0)], "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    assert all(0 <= r.quality_score <= 1 for r in cotraining.score(odd, model).collect())
    assert cotraining.score(odd.where("false"), model).count() == 0


def test_quality_without_two_classes(spark):
    """Labels of one class, or none, give the prior to all; so do empty tables."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for part, least, most in (("quality = 1", 0.9, 1), ("quality = 0", 0, 0.1), ("false", 0.5, 0.5)):
        scores = {r.quality_score for r in cotraining.score(docs, cotraining.fit(docs, labels.where(part))).collect()}
        assert len(scores) == 1 and least <= scores.pop() <= most
    assert cotraining.score(docs, cotraining.fit(docs.where("false"), labels)).where("quality_score = 0.5").count() == docs.count()
    assert corpus_pipeline.quality(spark, docs.where("false"), SMALL).count() == 0


def test_sure_and_wrong_rounds_stay_bounded():
    """A view that is sure of the opposite of what it is told moves by bounded steps, and loses nothing it had learned."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(-4, 1, (200, 3)), r.normal(4, 1, (200, 3))])
    y = np.repeat([0.0, 1.0], 200)
    free = r.normal(9, 0.1, (5000, 3))  # the first view is sure that these are good; it is told that they are bad

    def sums(models):
        g, h = models[0].sums(free, 0.0, bound=True)
        none = np.zeros(1 + 4 + 16)
        told = np.concatenate([[5000.0], g, h.ravel()])
        return np.concatenate([told, none, none, none])

    model = cotraining.co_train((x, x), y, sums, 5, 0.5)
    assert np.isfinite(model.views[0].weights).all() and abs(model.views[0].weights).max() < 20
    assert ((model.score(x, x) >= 0.5) == (y == 1)).mean() > 0.95


def test_co_training_rounds(spark):
    """The rounds in Spark, over all unlabelled rows, against the same sums taken row by row in one place."""
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    rows = cotraining.featured(docs, ["doc_id"])
    known = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None}
    every = [(r.doc_id, np.array(r[1]), np.array(r[2])) for r in rows.collect()]
    own = sorted((r for r in every if r[0] in known), key=lambda r: zlib.crc32(str(r[0]).encode()))
    free = [r for r in every if r[0] not in known]
    y = np.array([known[r[0]] for r in own])
    train = np.arange(len(y)) % 3 != 2
    xs = [np.array([r[k] for r in own])[train] for k in (1, 2)]
    ys = y[train]

    def slope(m, x, target):
        z = np.append(np.clip((x - m.mean) / m.scale, -8, 8), 1)
        p = 1 / (1 + math.exp(-max(-30, min(30, float(z @ m.weights)))))
        return (p - target) * z, 0.25 * np.outer(z, z)

    models = [cotraining.Logistic.fit(x, ys) for x in xs]
    for k in range(1, 6):
        new = []
        for learner in (0, 1):
            m, teacher = models[learner], models[1 - learner]
            g, h = np.zeros(len(m.weights)), np.zeros((len(m.weights),) * 2)
            for x, t in zip(xs[learner], ys):
                a, b = slope(m, x, t)
                g, h = g + a, h + b
            for label in (0, 1):
                picked = []
                for r in free:
                    p = 1 / (1 + math.exp(-float(teacher.odds(r[2 - learner][None])[0])))
                    if (p >= 0.95) if label else (p <= 1 - 0.95):
                        picked.append(slope(m, r[1 + learner], label))
                if picked:
                    weight = min(1, 0.5 * k / 5 * (ys == label).sum() / len(picked))
                    g, h = g + weight * sum(a for a, _ in picked), h + weight * sum(b for _, b in picked)
            penalty = np.array([3.0] * (len(m.weights) - 1) + [1e-6])
            new.append(cotraining.Logistic(m.mean, m.scale, m.weights - np.linalg.solve(h + np.diag(penalty), g + penalty * m.weights)))
        models = new
    got = cotraining.fit(rows, labels)
    for a, b in zip(got.views, models):
        assert np.allclose(a.weights, b.weights, atol=1e-5)


def test_pipeline_stages(spark):
    """Each stage against a plain version on what the one before it kept."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    quality, exact, near, secrets, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, MID)
    one = {r.doc_id: r for r in kept.collect()}
    model = cotraining.fit(docs, spark.read.parquet(f"{MID}/labels.parquet"))
    assert set(one) == {r.doc_id for r in cotraining.score(docs, model).collect() if r.quality_score >= 0.5}
    two = {r.doc_id: r for r in exact(spark, kept, MID).collect()}
    best = {}
    for r in one.values():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert set(two) == {i for _, i in best.values()}
    df2 = spark.createDataFrame(list(two.values()), docs.schema)
    three = {r.doc_id for r in near(spark, df2, MID).collect()}
    # the rule of the stage is a similarity of 0.8 of five-word shingles; it was two fingerprint radii before
    assert three == {int(i) for i, _ in near_kept([(i, r.text) for i, r in two.items()])} and len(three) < len(two)
    forest = secret_forest.train()
    df3 = spark.createDataFrame([two[i] for i in three], docs.schema)
    four = secrets(spark, df3, MID).collect()
    for r in four:
        text = two[r.doc_id].text
        for a, b in reversed(secret_forest.find(text, forest)[0]):
            text = text[:a] + "[SECRET]" + text[b:]
        assert r.text == text and r.n_chars == len(text)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing(spark, spark.createDataFrame(four, docs.schema), MID).collect()
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in four}
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and harmonic.cut(1, 4096, 64)
