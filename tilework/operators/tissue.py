"""Tissue contour masks of thumbnails: a range of hues, smoothing by bilateral filters, and two thresholds that the pixels choose."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The hues (half degrees) that stain gives, what other pixels become, and the filters' diameter and sigmas (colour, space).
HUES, FILL = (120, 180), 233
PASSES = ((90, 5000.0, 5000.0), (90, 5000.0, 5000.0), (90, 10000.0, 10000.0), (90, 10000.0, 100.0))
#: Grey levels at which a bilateral filter is worked out; between them it is interpolated.
LEVELS = 17


def half_degree_hue(rgb: np.ndarray) -> np.ndarray:
    """Hue of bytes (h x w x 3), from 0 to 180, 0 for greys."""
    r, g, b = (rgb[..., k].astype("f8") for k in range(3))
    top, spread = rgb.max(-1).astype("f8"), rgb.max(-1).astype("f8") - rgb.min(-1)
    safe = np.where(spread > 0, spread, 1)
    hue = np.where(top == r, 60 * (g - b) / safe, np.where(top == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    return np.where(spread > 0, np.rint(np.where(hue < 0, hue + 360, hue) / 2), 0)


def bilateral(image: np.ndarray, diameter: int, colour: float, space: float, levels: int = LEVELS) -> np.ndarray:
    """A bilateral filter of bytes over disks, the border mirrored: grey levels splat their pixels' weights, disks are summed by one transform each, and pixels are read between levels."""
    radius = max(diameter // 2, 1)
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disk = np.where(x * x + y * y <= radius * radius, np.exp(-(x * x + y * y) / (2 * space * space)), 0.0)
    wide = np.pad(image.astype("f8"), radius, "reflect") if min(image.shape) > radius else np.pad(image.astype("f8"), radius, "symmetric")
    shape = [n + 2 * radius for n in wide.shape]
    kernel = np.fft.rfft2(disk, shape)
    h, w = image.shape

    def summed(a: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(np.fft.rfft2(a, shape) * kernel, shape)[2 * radius : 2 * radius + h, 2 * radius : 2 * radius + w]

    at = np.linspace(0, 255, levels)
    made = []
    for level in at:
        weight = np.exp(-((wide - level) ** 2) / (2 * colour * colour))
        made.append(summed(weight * wide) / np.maximum(summed(weight), 1e-12))
    step = image / 255 * (levels - 1)
    low = np.minimum(step.astype(int), levels - 2)
    stack = np.stack(made)
    part = step - low
    rows, cols = np.indices(image.shape)
    return np.clip(np.rint(stack[low, rows, cols] * (1 - part) + stack[low + 1, rows, cols] * part), 0, 255).astype("u1")


def otsu(image: np.ndarray) -> int:
    """The grey level (the first of equals) up to which and above which bytes differ most; that of a plain image itself."""
    n = np.bincount(image.ravel(), minlength=256).astype("f8")
    if np.count_nonzero(n) == 1:
        return int(n.argmax())
    below, weight = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    apart = np.where(ok, weight / np.where(ok, below, 1) - (weight[-1] - weight) / np.where(ok, above, 1), 0)
    return int(np.round(below * above * apart * apart, 6).argmax())


def contour_mask(rgb: np.ndarray, passes=PASSES) -> np.ndarray:
    """Where a thumbnail (h x w x 3 bytes) shows tissue."""
    hue = half_degree_hue(rgb)
    kept = np.where(((hue >= HUES[0]) & (hue <= HUES[1]))[..., None], rgb, 0)
    filled = np.where(kept == 0, FILL, kept).astype("f8")
    grey = np.rint(filled @ np.array([0.114, 0.587, 0.299])).astype("u1")
    for diameter, colour, space in passes:
        grey = bilateral(255 - grey, diameter, colour, space)
    found = 255 - grey
    found = np.minimum(found, otsu(found))
    return found > otsu(found)


def tissue_runs(images: DataFrame, passes=PASSES) -> DataFrame:
    """(slide_id, row, lo, hi): runs of tissue in thumbnails (slide_id, width, height, channels, data as RGB), see regions.thumbnails; each is one row of an Arrow batch, so their size is the bound. rasters.run_components and shapes.contours go on from here."""
    source = images.where(F.col("channels") == 3).select(F.col("slide_id").cast("string").alias("slide_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "data")

    def put(batches):
        for batch in batches:
            for t in batch.to_pylist():
                mask = contour_mask(np.frombuffer(t["data"], "u1").reshape(t["height"], t["width"], 3), passes)
                ends = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype("i1"), axis=1)
                (row, lo), hi = np.nonzero(ends == 1), np.nonzero(ends == -1)[1]
                yield pa.RecordBatch.from_arrays([pa.array([t["slide_id"]] * len(row), pa.string()), *[pa.array(v.astype("i4")) for v in (row, lo, hi - 1)]], ["slide_id", "row", "lo", "hi"])

    return source.mapInArrow(put, "slide_id string, row int, lo int, hi int")
