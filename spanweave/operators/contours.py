"""Outer contours of an image in numpy: grey values, Gaussian blur, edges by gradient with non-maximum suppression and
hysteresis, connected parts, traced borders. Functions of one image, which tasks call."""

from __future__ import annotations

import numpy as np

#: Gradients below the first are no edge, above the second always, and the least side of an image looked at.
LOW, HIGH, LEAST_SIDE = 50, 150, 20
#: Slopes below and above which a gradient counts as one along an axis.
_FLAT, _STEEP = np.tan(np.pi / 8), np.tan(3 * np.pi / 8)
#: Neighbours of a pixel, clockwise from the left, as (row, column).
_AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def grey(image: np.ndarray) -> np.ndarray:
    """Height x width of luma; one channel stays as it is."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2]).astype(np.float64)
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114]))


def edges(pixels: np.ndarray, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Edge pixels of grey values: those whose gradient is a maximum across the edge and above ``high``, or above ``low`` and
    connected to such."""
    labels, strong = _ridges(pixels, low, high)
    return strong[labels]


def _framed(inside: np.ndarray, value=0) -> np.ndarray:
    """A copy with a pixel of one value around it."""
    out = np.full((inside.shape[0] + 2, inside.shape[1] + 2), value, dtype=inside.dtype)
    out[1:-1, 1:-1] = inside
    return out


def _ridges(pixels: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the connected parts of pixels that are a maximum above ``low``, whether a part has one above ``high``)."""
    p = _framed(pixels)
    p[0, 1:-1], p[-1, 1:-1] = pixels[0], pixels[-1]
    p[:, 0], p[:, -1] = p[:, 1], p[:, -2]
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]
    size = np.abs(dx) + np.abs(dy)
    # only what is above the lower bound can be an edge: its neighbours are looked up by place
    wide = size.shape[1] + 2
    s, own = _framed(size).ravel(), np.flatnonzero(size > low)
    at = own + 2 * (own // size.shape[1]) + wide + 1
    x, y, here = dx.ravel()[own], dy.ravel()[own], s[at]
    flat, steep = np.abs(y) < _FLAT * np.abs(x), np.abs(y) > _STEEP * np.abs(x)
    falling = x * y >= 0  # the gradient points down to the right, or up to the left
    step = np.where(flat, 1, np.where(steep, wide, np.where(falling, wide + 1, wide - 1)))
    second = s[at + step]
    # of two equal neighbours along an axis the one before stays
    top = (here > s[at - step]) & ((here > second) | ((flat | steep) & (here == second)))
    ridge = np.zeros(size.shape, dtype=bool)
    ridge.ravel()[own[top]] = True
    labels, n = parts(ridge, True)
    strong = np.zeros(n + 1, dtype=bool)
    strong[labels.ravel()[own[top & (here > high)]]] = True
    return labels, strong


def parts(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """(numbers from 1 on of the connected parts of a mask, 0 elsewhere; how many), by runs of rows that touch."""
    wide, reach = mask.shape[1] + 2, 1 if diagonal else 0
    flat = np.zeros((mask.shape[0], wide), dtype=bool)
    flat[:, 1:-1] = mask
    flat = flat.ravel()  # no run goes on in the next row
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    begin, end = turns[::2], turns[1::2]
    # the runs of the row below that a run touches are neighbours in the order of all runs
    low, high = np.searchsorted(end, begin + wide - reach, "right").tolist(), np.searchsorted(begin, end + wide + reach, "left").tolist()
    parent = list(range(len(begin)))
    for i, (j, k) in enumerate(zip(low, high)):
        for other in range(j, k):
            a, b = i, other
            if parent[b] == b and parent[a] == a and a < b:  # as most are
                parent[b] = a
                continue
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:
                parent[b] = a
            else:
                parent[a] = b
    names, n = [0] * len(parent), 0
    for i, p in enumerate(parent):  # a parent comes first
        if p == i:
            n += 1
            names[i] = n
        else:
            names[i] = names[p]
    out = np.zeros(mask.shape, dtype=np.int64)
    out[mask] = np.repeat(np.array(names, dtype=np.int64), end - begin)
    return out, n


def border(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer border of a mask's one connected part, (row, column) in order, from its first pixel on."""
    return [(r, c) for r, c in _border(mask).tolist()]


def _border(mask: np.ndarray) -> np.ndarray:
    """The outer border of a mask's one connected part, (row, column) in order, from its first pixel on."""
    wide = mask.shape[1] + 2
    m = _framed(mask).tobytes()  # read pixel by pixel
    steps = [r * wide + c for r, c in _AROUND]
    turns = [[(k, steps[k]) for k in ((back + i) % 8 for i in range(1, 9))] for back in range(8)]
    start = m.index(1)
    at, back, path = start, 0, []  # back: where the search comes from, as a neighbour's number
    first = None
    while True:
        for turn, step in turns[back]:
            if m[at + step]:
                break
        else:
            path = [start]
            break
        if at == start:
            if turn == first:
                break
            first = turn if first is None else first
        path.append(at)
        at, back = at + step, (turn + 4) % 8
    rows, columns = np.divmod(np.array(path), wide)
    return np.stack([rows - 1, columns - 1], axis=1)


def area(path: list[tuple[int, int]] | np.ndarray) -> float:
    """Of the polygon through the centres of a border's pixels."""
    p = np.array(path, dtype=np.float64)
    y, x = p[:, 0], p[:, 1]
    return abs(float(np.dot(x[:-1], y[1:]) + x[-1] * y[0] - np.dot(y[:-1], x[1:]) - y[-1] * x[0])) / 2


def outer(mask: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(x, y, width, height, area) of the parts of a mask that lie in no hole of another, from top to bottom."""
    return _outer(parts(mask, True)[0])


def outlines(pixels: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """``outer`` of the ``edges`` of grey values, whose parts are told apart once."""
    labels, strong = _ridges(pixels, LOW, HIGH)
    return _outer(np.where(strong[labels], labels, 0))


def _outer(labels: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    mask = labels > 0
    ground, _ = parts(_framed(~mask, True), False)
    outside = ground == ground[0, 0]
    beside = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
    found = []
    for k in np.unique(labels[mask & beside]).tolist():
        own = labels == k
        rows, columns = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
        y, x, h, w = int(rows[0]), int(columns[0]), int(rows[-1] - rows[0]) + 1, int(columns[-1] - columns[0]) + 1
        found.append((x, y, w, h, area(_border(own[y : y + h, x : x + w]))))
    return sorted(found, key=lambda f: (f[1], f[0]))
