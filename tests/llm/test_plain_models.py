"""The site style tree's importances and the secret forest's trees, computed again plainly."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from spanweave.llm import secret_forest, site_style_tree

SMALL = "/root/testdata/sf0.001"


def plain_importances(rows):
    """(host, node): pages, presentation, content, inherited. rows: (host, page).

    Presentation is the entropy of the child sequences of a node over its pages, by the logarithm of their number; content
    the mean over its texts of how far each is from being on every page.
    """
    merged = defaultdict(dict)
    for host, page in rows:
        units, children, parents = site_style_tree.parse(page, host)
        named = tuple((u.node, u.text) for u in site_style_tree._named(units))
        own = site_style_tree._hash(page)
        key = named or own
        if key not in merged[host] or own < merged[host][key][0]:
            merged[host][key] = own, units, children, parents
    out = {}
    for host, pages in merged.items():
        styles, texts, seen, above = defaultdict(Counter), defaultdict(Counter), Counter(), {}
        for _, units, children, parents in pages.values():
            for n in {u.node for u in units} | set(children):
                seen[n] += 1
                styles[n][tuple(children.get(n, ()))] += 1
                above[n], at = [], n
                while at in parents:
                    at = parents[at]
                    above[n].append(at)
            for n, t in {(u.node, u.text) for u in units}:
                texts[n][t] += 1
        presentation, content = {}, {}
        for n, many in seen.items():
            if many == 1:
                presentation[n] = content[n] = 1.0
                continue
            presentation[n] = -sum(k / many * math.log(k / many) for k in styles[n].values()) / math.log(many)
            far = [1 - math.log(k) / math.log(many) for k in texts[n].values() for _ in range(k)]
            content[n] = sum(far) / len(far) if far else 1.0
        for n in seen:
            handed = [presentation[a] * 0.9**level for level, a in enumerate(above[n])]
            out[host, n] = seen[n], presentation[n], content[n], max([presentation[n], *handed])
    return out


def test_importances(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    copies = pages.where("page_id % 3 = 0").withColumn("html", F.concat("html", F.lit("<footer>copied</footer>")))  # other text outside of what is named
    pages = pages.unionByName(copies)
    want = plain_importances([(r.host, r.html) for r in site_style_tree._pages(pages).where("host <> ''").collect()])
    got = {(r.host, r.node): (r.pages, r.presentation, r.content, r.inherited) for r in site_style_tree.style_tree(pages).collect()}
    assert got.keys() == want.keys() and len({v[0] for v in want.values()}) > 3
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    some = [v for v in want.values() if v[0] > 1]
    assert any(0 < v[1] < 1 for v in some) and any(0 < v[2] < 1 for v in some) and any(v[3] > v[1] for v in some)


def grown(nodes, x, y, forest, rng):
    """Follow a tree in the order in which it grew; each of its cuts must be as good as any of the features drawn for it,
    and each leaf must have had a reason to stop."""
    todo, count = [(0, np.arange(len(y)), 0)], 0
    while todo:
        here, rows, depth = todo.pop()
        count += 1
        feature, cut, low, high, share = nodes[here]
        assert np.isclose(share, y[rows].mean())
        if depth == forest.depth or len(rows) < 2 * forest.leaf or y[rows].mean() in (0, 1):
            assert feature == -1
            continue
        costs = {}
        for f in rng.choice(x.shape[1], max(2, round(x.shape[1] ** 0.5)), replace=False).tolist():
            values = np.unique(x[rows, f])
            for c in (values[1:] + values[:-1]) / 2:
                sides = [y[rows][x[rows, f] <= c], y[rows][x[rows, f] > c]]
                if min(map(len, sides)) >= forest.leaf:
                    costs[f, float(c)] = sum(Fraction(int(s.sum()) * (len(s) - int(s.sum())), len(s)) for s in sides)
        if feature == -1:
            assert not costs
            continue
        assert costs[int(feature), float(cut)] == min(costs.values())
        left = x[rows, int(feature)] <= cut
        todo += [(int(low), rows[left], depth + 1), (int(high), rows[~left], depth + 1)]
    assert count == len(nodes)


def test_every_tree_is_grown_by_the_rule():
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, 9, 160), r.integers(0, 4, 160), r.integers(0, 30, 160), r.random(160).round(2), r.integers(0, 2, 160)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 20) ^ (r.random(160) < 0.15)).astype(int)
    forest = secret_forest.Forest(trees=12, depth=5, leaf=3).fit(x, y)
    rng = np.random.default_rng(forest.seed)
    for nodes in forest.nodes:
        rows = rng.integers(0, len(y), len(y))
        grown(nodes, x[rows], y[rows], forest, rng)
    assert max(len(n) for n in forest.nodes) > 15


def plain_features(before, value, after):
    """Those features that need no table of the operator, by their plain meaning."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    n, counts = len(value), Counter(value.lower())
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    share = lambda k: sum(kind(c) == k for c in value) / n
    return {0: n, 1: entropy, 3: sum(kind(a) != kind(b) for a, b in zip(value, value[1:])) / n, 6: share(0), 7: share(1), 8: share(2), 9: share(3), 10: float(set(value.lower()) <= set("0123456789abcdef")), 11: max(counts.values()) / n, 13: float(value.count("-") == 4 and n == 36), 17: float(before.endswith(("'", '"')))}


def test_features_by_their_meaning():
    for before, value, after, _ in secret_forest.labelled_findings(300, seed=99):
        got = secret_forest.features(before[-60:], value, after[:60])
        for k, v in plain_features(before[-60:], value, after[:60]).items():
            assert math.isclose(got[k], v, abs_tol=1e-9), (k, value)
