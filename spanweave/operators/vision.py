"""Image regions: predicates over contours and words that a vision library finds, detectors as plug-ins, and blurring and
pixelation in numpy over image files."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle, spread
from . import contours as outlines

REGIONS = "image_id string, x0 double, y0 double, x1 double, y1 double, label string, confidence double, source string, error string"


def shape_regions(contours: DataFrame) -> DataFrame:
    """(image_id, x, y, w, h, area) to labelled boxes: identity cards and signatures by size and aspect."""
    big = contours.where("area >= 500 AND w >= 20 AND h >= 20").withColumn("aspect", F.col("w") / F.greatest("h", F.lit(1)))
    label = F.when(F.col("aspect").between(1.5, 1.8), "ID").when(F.col("aspect").between(2.5, 3.5), "SIGNATURE")
    rows = big.withColumn("label", label).where("label IS NOT NULL")
    score = F.when(F.col("label") == "ID", 0.6).otherwise(0.55)
    return rows.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "label", score.alias("confidence"))


def contours(image: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, area) of an image's outer contours; a small image has none."""
    if min(image.shape[:2]) < outlines.LEAST_SIDE:
        return []
    pixels = blur(outlines.grey(image)[:, :, None], 5)[:, :, 0]
    return outlines.outlines(pixels)


def image_contours(images: DataFrame, decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """(image_id, width, height, x, y, w, h, area, error): the outer contours of images (image_id, content), for
    ``shape_regions``. An image without any has one row without a contour; one that cannot be decoded has its error."""
    read = decode or read_netpbm

    def run(batches):
        for b in batches:
            rows = []
            for image_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    image = read(data)
                except (ValueError, TypeError) as e:
                    rows.append((image_id, *[None] * 7, str(e)))
                    continue
                size = image.shape[1], image.shape[0]
                rows += [(image_id, *size, *map(float, c), None) for c in contours(image)] or [(image_id, *size, *[None] * 6)]
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=["image_id", "width", "height", "x", "y", "w", "h", "area", "error"])

    return images.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInArrow(run, "image_id string, width int, height int, x double, y double, w double, h double, area double, error string")


def word_regions(words: DataFrame) -> DataFrame:
    """Recognised words (image_id, text, conf, x, y, w, h) that are neither blank nor below confidence 30."""
    rows = words.where("trim(text) <> '' AND conf >= 30")
    return rows.select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), F.lit("TEXT_PII").alias("label"), (F.col("conf") / 100).alias("confidence"))


def stand_in_regions(images: DataFrame) -> DataFrame:
    """Where no recogniser is at hand: two bands of fixed shares of the image (image_id, width, height)."""
    bands = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0.10, 0.22), (0.25, 0.37))])).alias("s")
    rows = images.select("image_id", "width", "height", bands)
    cut = lambda c, share: (F.col(c) * share).cast("int").cast("double")
    return rows.select("image_id", cut("width", F.lit(0.1)).alias("x0"), cut("height", F.col("s.a")).alias("y0"), cut("width", F.lit(0.9)).alias("x1"), cut("height", F.col("s.b")).alias("y1"), F.lit("TEXT_PII").alias("label"), F.lit(0.5).alias("confidence"))


def clamp(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions cut to their image; empty ones go."""
    rows = regions.join(images.select("image_id", "width", "height"), "image_id")
    low = lambda c, top: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(top)))
    rows = rows.withColumns({"x0": low("x0", "width"), "x1": low("x1", "width"), "y0": low("y0", "height"), "y1": low("y1", "height")})
    return rows.where("x1 > x0 AND y1 > y0").drop("width", "height")


def signature_strips(regions: DataFrame, images: DataFrame) -> DataFrame:
    """An image at least 2.2 times as wide as high is one signature, whatever was found in it."""
    wide = images.where(F.col("width") / F.greatest("height", F.lit(1)) >= 2.2)
    zero = F.lit(0.0)
    whole = wide.select("image_id", zero.alias("x0"), zero.alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"), F.lit("SIGNATURE").alias("label"), F.lit(0.55).alias("confidence"))
    return regions.join(wide.select("image_id"), "image_id", "left_anti").unionByName(whole)


def blur(part: np.ndarray, size: int = 51) -> np.ndarray:
    """Gaussian blur of height x width x channels, mirrored at the edges; the deviation follows from the window's size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    weights /= weights.sum()
    out = part.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        reach = np.abs(np.arange(-(size // 2), n + size // 2))
        if n > 1:
            reach = reach % (2 * n - 2)
            reach = np.minimum(reach, 2 * n - 2 - reach)
        else:
            reach = np.zeros_like(reach)
        wide = np.take(out, reach, axis=axis)
        out = sum(w * (wide[k : k + n] if axis == 0 else wide[:, k : k + n]) for k, w in enumerate(weights))
    return np.rint(out)


def shrink(part: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear samples at the centres of a coarser grid."""
    for axis, size in ((0, height), (1, width)):
        n = part.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(part.ndim)])
        part = np.take(part, low, axis=axis) * (1 - share) + np.take(part, np.minimum(low + 1, n - 1), axis=axis) * share
    return np.rint(part)


def pixelate(image: np.ndarray, box: tuple[float, float, float, float], cells: int = 10) -> np.ndarray:
    """A copy of an image whose box, cut to the image, is blurred; one larger than ``cells`` pixels each way is also brought
    down to a tenth of its sides and drawn up again in squares."""
    out = image if image.ndim == 3 else image[:, :, None]
    out = out.copy()
    x0, y0, x1, y1 = (int(v) for v in box)
    x0, y0, x1, y1 = max(0, x0), max(0, y0), min(out.shape[1], x1), min(out.shape[0], y1)
    if x1 > x0 and y1 > y0:
        part = blur(out[y0:y1, x0:x1])
        h, w = part.shape[:2]
        if h > cells and w > cells:
            small = shrink(part, h // cells, w // cells)
            part = small[(np.arange(h) * (h // cells) // h)][:, np.arange(w) * (w // cells) // w]
        out[y0:y1, x0:x1] = part
    return out.reshape(image.shape)


def read_netpbm(data: bytes) -> np.ndarray:
    """An 8-bit binary PGM or PPM image as height x width x channels."""
    head = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if head is None or int(head[4]) > 255:
        raise ValueError("not an 8-bit binary PGM or PPM image")
    depth, width, height = (3 if head[1] == b"P6" else 1), int(head[2]), int(head[3])
    return np.frombuffer(data, dtype=np.uint8, count=depth * width * height, offset=head.end()).reshape(height, width, depth)


def write_netpbm(image: np.ndarray) -> bytes:
    return b"P%d\n%d %d\n255\n" % (6 if image.shape[2] == 3 else 5, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def redact_images(images: DataFrame, regions: DataFrame, decode: Callable[[bytes], np.ndarray] = read_netpbm, encode: Callable[[np.ndarray], bytes] = write_netpbm) -> DataFrame:
    """(image_id, content, n_regions, error): images (image_id, content) with their regions (image_id, box) made unreadable.

    decode and encode wrap an image library; netpbm needs none. An image without regions is written as it is read; one
    that cannot be decoded has no content, so that it is never passed on unredacted.
    """
    boxes = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.array("x0", "y0", "x1", "y1"))).alias("boxes"))
    joined = images.select(F.col("image_id").cast("string").alias("image_id"), "content").join(boxes, "image_id", "left")

    def run(batches):
        for b in batches:
            contents, counts, errors = [], [], []
            for data, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    image = decode(data)
                    for box in own or ():
                        image = pixelate(image, box)
                    contents.append(encode(image))
                    errors.append(None)
                except (ValueError, TypeError) as e:
                    contents.append(None)
                    errors.append(str(e))
                counts.append(len(own or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary()), pa.array(counts, pa.int64()), pa.array(errors, pa.string())], names=["image_id", "content", "n_regions", "error"])

    # few bytes may be many images: they are not gathered in few tasks
    return spread(joined, "image_id").mapInArrow(run, "image_id string, content binary, n_regions long, error string")


def detect_regions(images: DataFrame, detectors: dict[str, Callable[[np.ndarray], list[tuple]]], decode: Callable[[bytes], np.ndarray] = read_netpbm) -> DataFrame:
    """The union of what detectors find in images (image_id, content), with the detector's name as source.

    A detector (faces, text: whatever library it wraps) maps pixels to (x0, y0, x1, y1, label, confidence). An image that
    cannot be decoded has one row with its error and no box, which ``redact_images`` never passes on.
    """

    def run(batches):
        for b in batches:
            out = []
            for image_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    image = decode(data)
                except (ValueError, TypeError) as e:
                    out.append((image_id, *[None] * 7, str(e)))
                    continue
                out += [(image_id, *map(float, box), label, float(score), name, None) for name, find in detectors.items() for *box, label, score in find(image)]
            kinds = [pa.string(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 9, kinds)], names=[x.split()[0] for x in REGIONS.split(", ")])

    return images.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInArrow(run, REGIONS)


def redact_found(images: DataFrame, detectors: dict[str, Callable[[np.ndarray], list[tuple]]], decode: Callable[[bytes], np.ndarray] = read_netpbm, encode: Callable[[np.ndarray], bytes] = write_netpbm) -> tuple[DataFrame, DataFrame]:
    """(regions, redacted): one run over images (image_id, content): shapes by their contours and whatever the detectors
    find, one strip where an image is a signature by its aspect, all cut to the image and made unreadable there."""
    seen = settle(image_contours(images, decode), "contours")
    sizes = seen.select("image_id", "width", "height").distinct()
    found = union_regions(shape_regions(seen), detect_regions(images, detectors, decode).where("error IS NULL"))
    regions = settle(clamp(signature_strips(found, sizes), sizes), "regions")
    return regions, redact_images(images, regions, decode, encode)


def union_regions(*found: DataFrame) -> DataFrame:
    """Regions of several detectors, one after the other; none is dropped."""
    columns = ["image_id", "x0", "y0", "x1", "y1", "label", "confidence"]
    out = found[0].select(*columns)
    for more in found[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def page_regions(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions with the document and page of their image, and how many the page has."""
    rows = regions.join(images.select("image_id", "doc_id", "page_no"), "image_id")
    counts = rows.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_on_page"))
    return rows.join(counts, ["doc_id", "page_no"])


def similar_vectors(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k rows (vec_id, similarity) of highest cosine with a query; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding")
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    rows = vectors.where(v.isNotNull()).select("vec_id", F.when(norm > 0, dot(v, q) / norm).alias("similarity"))
    return rows.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "vec_id").limit(k)


def composites(images: DataFrame, redacted: DataFrame, pages: DataFrame) -> DataFrame:
    """Where rewritten images go back: (doc_id, image_id, page_no, x0, y0, x1, y1, path) of images that have a box on a page
    their document has. images: doc_id, image_id, page_no and a box; redacted: image_id, path; pages: doc_id, page_no."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    rows = images.join(redacted.select("image_id", "path"), "image_id").join(last, "doc_id")
    return rows.where("x0 IS NOT NULL AND page_no BETWEEN 1 AND n_pages").select("doc_id", "image_id", "page_no", "x0", "y0", "x1", "y1", "path")
