"""Contours in numpy against plain versions and drawn shapes, and a whole run over images."""

import random

import numpy as np

from spanweave.operators import contours, vision


def flood(mask, diagonal):
    """Parts of a mask, pixel by pixel."""
    out, n = np.zeros(mask.shape, dtype=int), 0
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for at in zip(*np.nonzero(mask)):
        if out[at]:
            continue
        n, todo = n + 1, [at]
        out[at] = n
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                q = r + dr, c + dc
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out, n


def test_parts_against_a_flood():
    r = np.random.default_rng(1)
    for share in (0.2, 0.45, 0.7):
        mask = r.random((30, 41)) < share
        for diagonal in (False, True):
            (a, n), (b, m) = contours.parts(mask, diagonal), flood(mask, diagonal)
            assert n == m and len({(x, y) for x, y in zip(a[mask].tolist(), b[mask].tolist())}) == n and not a[~mask].any()


def test_borders_and_areas():
    """Pick's theorem for shapes without thin parts: inside pixels and half the border, less one."""
    y, x = np.mgrid[:60, :80]
    for mask in ((abs(x - 40) < 20) & (abs(y - 30) < 11), (x - 40) ** 2 + (y - 30) ** 2 < 400, (abs(x - 40) + abs(y - 30)) < 25):
        path = contours.border(mask)
        edge = mask & ~(mask[:, :] & np.roll(mask, 1, 0) & np.roll(mask, -1, 0) & np.roll(mask, 1, 1) & np.roll(mask, -1, 1))
        assert len(path) == len(set(path)) and set(path) == set(zip(*(v.tolist() for v in np.nonzero(edge))))
        assert contours.area(path) == mask.sum() - len(path) / 2 - 1
    assert contours.border(np.ones((1, 1), dtype=bool)) == [(0, 0)] and contours.area([(0, 0)]) == 0
    line = np.ones((1, 5), dtype=bool)
    assert contours.area(contours.border(line)) == 0 and set(contours.border(line)) == {(0, k) for k in range(5)}


def test_outer_contours():
    """A ring, a part in its hole, which is not outer, and two parts beside it."""
    mask = np.zeros((60, 60), dtype=bool)
    mask[5:40, 5:40] = True
    mask[8:37, 8:37] = False
    mask[15:20, 15:20] = True
    mask[50:55, 10:20] = True
    mask[45, 50] = True
    assert contours.outer(mask) == [(5, 5, 35, 35, 34.0 * 34), (50, 45, 1, 1, 0.0), (10, 50, 10, 5, 9.0 * 4)]
    assert contours.outer(np.zeros((30, 30), dtype=bool)) == []


def plain_edges(p, low, high):
    h, w = p.shape
    at = lambda a, r, c: a[min(max(r, 0), h - 1)][min(max(c, 0), w - 1)]
    dx, dy = np.zeros((h, w)), np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            dx[r, c] = sum(k * (at(p, r + i, c + 1) - at(p, r + i, c - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy[r, c] = sum(k * (at(p, r + 1, c + i) - at(p, r - 1, c + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    size = abs(dx) + abs(dy)
    s = lambda r, c: size[r, c] if 0 <= r < h and 0 <= c < w else 0
    ridge = np.zeros((h, w), dtype=bool)
    for r in range(h):
        for c in range(w):
            m, angle = size[r, c], np.degrees(np.arctan2(abs(dy[r, c]), abs(dx[r, c])))
            if m <= low:
                continue
            if angle < 22.5:
                ridge[r, c] = m > s(r, c - 1) and m >= s(r, c + 1)
            elif angle > 67.5:
                ridge[r, c] = m > s(r - 1, c) and m >= s(r + 1, c)
            else:
                k = 1 if dx[r, c] * dy[r, c] >= 0 else -1
                ridge[r, c] = m > s(r - 1, c - k) and m > s(r + 1, c + k)
    parts, n = flood(ridge, True)
    keep = {int(k) for k in parts[ridge & (size > high)]}
    return np.isin(parts, list(keep)) & ridge


def test_edges_against_plain():
    r = np.random.default_rng(4)
    for k in range(6):
        noise = np.rint(r.random((24, 31)) * 255)
        pixels = vision.blur(noise[:, :, None], 5)[:, :, 0] if k % 2 else np.rint(noise / 8) * 8
        assert (contours.edges(pixels, 50, 150) == plain_edges(pixels, 50, 150)).all()


def test_outlines_are_the_outer_parts_of_edges():
    """Parts that are told apart once: weak ridges go, and what lies in a hole; noise, blocks and a card with a panel."""
    r, found = np.random.default_rng(8), 0
    blocks = np.kron(r.integers(0, 2, (5, 6)), np.ones((11, 9))) * 90
    panel = card(70, 40, 90, 60)[:, :, 0].astype(np.float64)
    panel[20:40, 25:60] = 50
    for pixels in (np.rint(r.random((40, 51)) * 255), blocks, panel, np.rint(r.random((30, 30)) * 20) + blocks[:30, :30], np.zeros((20, 20))):
        want = contours.outer(plain_edges(pixels, contours.LOW, contours.HIGH))
        assert contours.outlines(pixels) == want
        found += len(want)
    assert found > 10


def card(w, h, width, height, depth=1):
    image = np.zeros((height, width, depth), dtype=np.uint8)
    image[10 : 10 + h, 10 : 10 + w] = 200
    return image


def test_a_whole_run(spark):
    """Cards of known size, a strip, noise, a small image and broken bytes; what is found is made unreadable."""
    r = random.Random(2)
    images = {"id": card(60, 36, 90, 60), "sign": card(90, 30, 120, 60, 3), "square": card(40, 40, 60, 60), "strip": card(30, 10, 100, 40), "tiny": card(5, 5, 19, 30), "plain": np.full((40, 50, 1), 9, dtype=np.uint8)}
    rows = [(k, vision.write_netpbm(v)) for k, v in images.items()] + [("broken", b"P5\n"), ("null", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id string, content binary").repartition(3)
    words = lambda image: [(-5.0, 2.0, 1e6, 6.0, "TEXT_PII", 0.5)] if image.shape[0] == 40 and image.shape[1] == 50 else []
    regions, redacted = vision.redact_found(df, {"text": words})
    got = sorted((x.image_id, x.label, x.x0, x.y0, x.x1, x.y1) for x in regions.collect())
    assert got == [("id", "ID", 9, 9, 70, 46), ("plain", "TEXT_PII", 0, 2, 50, 6), ("sign", "SIGNATURE", 9, 9, 100, 40), ("strip", "SIGNATURE", 0, 0, 100, 40)]
    out = {x.image_id: x for x in redacted.collect()}
    assert out["broken"].content is None and out["null"].content is None and out["broken"].error
    assert bytes(out["square"].content) == vision.write_netpbm(images["square"]) and bytes(out["id"].content) != vision.write_netpbm(images["id"])
    found = {(x.image_id, x.error is None) for x in vision.detect_regions(df, {"none": lambda image: []}).collect()}
    assert found == {("broken", False), ("null", False)}


def test_made_images_are_drawn_by_all_cores(spark):
    """One small file of rows is one partition, whose images one core would draw and search."""
    from spanweave.plans import catalog

    drawn = catalog.queries()["contour_regions"](spark, "/root/testdata/sf0.001")
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_images_stay_dealt_out(spark):
    """Images of few bytes are not gathered in one task before they are blurred."""
    images = spark.range(50).selectExpr("CAST(id AS STRING) AS image_id", "CAST(NULL AS BINARY) AS content")
    boxes = spark.range(50).selectExpr("CAST(id AS STRING) AS image_id", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    assert vision.redact_images(images, boxes).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
