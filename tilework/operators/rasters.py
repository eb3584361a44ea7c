"""Masks as tables of pixels (slide_id, row, col) and runs (slide_id, ..., lo, hi): filling, morphology, components, hulls, canvases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .cohorts import broadcast_if_small
from .tables import checkpoint_dir, written


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fill_polygons(vertices: DataFrame) -> DataFrame:
    """(slide_id, label, row, lo, hi): runs of pixels inside the rois of a label by the even-odd rule, at integer coordinates.

    An edge crosses the rows from its upper end up to, not including, its lower
    one; crossings of a row, in order, open and close runs. So rois of one label
    that overlap make holes, and horizontal edges count for nothing.
    """
    roi = Window.partitionBy("slide_id", "label", "roi_id").orderBy("vertex_id")
    whole = roi.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(roi), F.first(c).over(whole))
    edges = vertices.select("slide_id", "label", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny")).where("y <> ny")
    crossed = edges.withColumn("row", F.explode(F.sequence(F.least("y", "ny"), F.greatest("y", "ny") - 1)))
    at = F.col("x") + (F.col("row") - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))
    line = Window.partitionBy("slide_id", "label", "row").orderBy("at")
    opened = crossed.select("slide_id", "label", "row", at.alias("at")).select("slide_id", "label", "row", F.ceil("at").alias("lo"), F.floor(F.lead("at").over(line)).alias("hi"), (F.row_number().over(line) % 2).alias("opens"))
    return opened.where("opens = 1 and hi >= lo").drop("opens")


def paint(runs: DataFrame, class_key: DataFrame) -> DataFrame:
    """(slide_id, row, col, class_id): runs as pixels; of classes that overlap the greatest wins. The key is one row a label."""
    pixels = runs.join(broadcast_if_small(class_key), "label").select("slide_id", "row", F.explode(F.sequence("lo", "hi")).alias("col"), "class_id")
    return pixels.groupBy("slide_id", "row", "col").agg(F.max("class_id").alias("class_id"))


def dilate(mask: DataFrame, size: int = 2) -> DataFrame:
    """Every pixel grows downwards and to the right to a square of `size`."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    down = mask.select("slide_id", F.explode(F.transform(steps, lambda s: F.col("row") + s)).alias("row"), "col").distinct()
    return down.select("slide_id", "row", F.explode(F.transform(steps, lambda s: F.col("col") + s)).alias("col")).distinct()


def erode(mask: DataFrame, size: int = 2) -> DataFrame:
    """Pixels of which the whole square of `size` below and to the right is in the mask; beyond the edge is background."""
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    back = mask.select("slide_id", F.explode(F.transform(steps, lambda s: F.col("row") - s)).alias("row"), F.col("col").alias("at")).select("slide_id", "row", F.explode(F.transform(steps, lambda s: F.col("at") - s)).alias("col"))
    return back.groupBy("slide_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == size * size).drop("n")


def tissue_mask(gray: DataFrame, threshold: int, floor: int = 25, size: int = 2) -> DataFrame:
    """Pixels (slide_id, row, col) of `gray` (with v, a byte) darker than the threshold and lighter than the floor, closed and opened."""
    found = gray.where((F.col("v") < threshold) & (F.col("v") > floor)).select("slide_id", "row", "col").distinct()
    return dilate(erode(erode(dilate(found, size), size), size), size)


def runs_of(mask: DataFrame) -> DataFrame:
    """(slide_id, row, lo, hi): unbroken runs of pixels in each row."""
    cells = mask.select("slide_id", "row", "col").distinct()
    island = F.col("col") - F.row_number().over(Window.partitionBy("slide_id", "row").orderBy("col"))
    return cells.withColumn("island", island).groupBy("slide_id", "row", "island").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).drop("island")


def components(mask: DataFrame) -> DataFrame:
    """(slide_id, component struct<slide_id, row, lo>, row, lo, hi): each run of mask pixels with the first run of its 8-connected component."""
    return run_components(runs_of(mask))


def run_components(found: DataFrame, touch: int = 1) -> DataFrame:
    """components() of runs (slide_id, row, lo, hi); touch 1 joins runs that meet at a corner, 0 only those with a column in common.

    Runs are cut at the borders of blocks and joined within each block; rounds,
    over tables that are written, are only for what touches across a border.
    """
    side, kinds = blocks.SIDE, {c: found.schema[c].dataType for c in ("slide_id", "row", "lo", "hi")}
    c0, r0 = blocks.origin(F.col("bc")), blocks.origin(F.col("br"))
    spread = found.select("slide_id", "row", "lo", "hi", blocks.block_of(F.col("row")).alias("br"), F.explode(F.sequence(blocks.block_of(F.col("lo")), blocks.block_of(F.col("hi")))).alias("bc"))
    cut = spread.select("slide_id", "br", "bc", "row", F.greatest("lo", c0).cast(kinds["lo"]).alias("lo"), F.least("hi", c0 + side - 1).cast(kinds["hi"]).alias("hi"), (F.col("lo") >= c0).alias("begins"), F.col("hi").alias("end"))

    def label(table, block):
        row, lo, hi, br, bc = (blocks.numbers(table, c) for c in ("row", "lo", "hi", "br", "bc"))
        wide, left = side + 4, bc * side - side // 2 - 1
        line = (block * (side + 1) + row - br * side + side // 2) * wide
        below = line + wide
        u, v = blocks.ranges(np.searchsorted(line + hi - left, below + lo - left - touch), np.searchsorted(line + lo - left, below + hi - left + touch, "right"))
        least = pa.array(blocks.joined(len(row), u, v))
        return [*table.columns[:8], table["row"].take(least), table["lo"].take(least)]

    kind = {c: k.simpleString() for c, k in kinds.items()}
    pieces = written(blocks.by_block(cut, ["slide_id", "br", "bc"], ["row", "lo"], label, f"slide_id {kind['slide_id']}, br bigint, bc bigint, row {kind['row']}, lo {kind['lo']}, hi {kind['hi']}, begins boolean, end {kind['hi']}, first_row {kind['row']}, first_lo {kind['lo']}"))
    pieces = pieces.withColumn("node", F.struct("slide_id", F.col("first_row").alias("row"), F.col("first_lo").alias("lo")))
    beside = (F.col("lo") == c0) | (F.col("hi") == c0 + side - 1)
    above = pieces.where(beside | (F.col("row") == r0 + side - 1)).select(F.col("node").alias("a"), "slide_id", "row", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.struct("br", "bc").alias("block"), F.explode(F.array("bc", F.col("bc") - 1, F.col("bc") + 1)).alias("to"))
    below = pieces.where(beside | (F.col("row") == r0)).select(F.struct("slide_id", "row", "bc").alias("at"), F.col("node").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.struct("br", "bc").alias("other"))
    met = above.select("*", F.struct("slide_id", (F.col("row") + 1).alias("row"), F.col("to").alias("bc")).alias("at")).join(below, "at").where((F.col("block") != F.col("other")) & (F.col("a_lo") <= F.col("b_hi") + touch) & (F.col("b_lo") <= F.col("a_hi") + touch))
    ended = pieces.where("end > hi").select(F.struct("slide_id", "row", (F.col("hi") + 1).alias("lo")).alias("at"), F.col("node").alias("a"))
    went_on = pieces.where("not begins").select(F.struct("slide_id", "row", "lo").alias("at"), F.col("node").alias("b"))
    touching = met.select("a", "b").unionByName(ended.join(went_on, "at").select("a", "b")).distinct()
    edges = written(touching.unionByName(touching.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    whole = pieces.where("begins").select("slide_id", "node", "row", "lo", F.col("end").alias("hi"))
    if edges.isEmpty():
        return whole.withColumnRenamed("node", "component").select("slide_id", "component", "row", "lo", "hi")
    return whole.join(least_names(edges), "node", "left").select("slide_id", F.coalesce("name", "node").alias("component"), "row", "lo", "hi")


def least_names(edges: DataFrame) -> DataFrame:
    """(node, name): the least node that each is connected with by edges (a, b), which are given both ways.

    Nodes take the least name among their neighbours' and then the name of the
    node they are named after, so that rounds grow slowly with a path's length.
    Each round is written.
    """
    names = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("name"))
    while True:
        near = edges.join(names, F.col("b") == F.col("node")).groupBy("a").agg(F.min("name").alias("near"))
        least = names.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("name").alias("old"), F.least("name", "near").alias("name"))
        to = names.select(F.col("node").alias("at"), F.col("name").alias("further"))
        moved = written(least.join(to, F.col("name") == F.col("at"), "left").select("node", "old", F.least("name", "further").alias("name")))
        names = moved.select("node", "name")
        if moved.where("old <> name").isEmpty():
            return names


def fill_holes(mask: DataFrame) -> DataFrame:
    """The mask's pixels and those of its holes: background that no path of neighbours in a row or column leads out of."""
    frame = mask.groupBy("slide_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    lines = frame.select("slide_id", "c0", "c1", "r0", F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("row"))
    line = Window.partitionBy("slide_id", "row").orderBy("lo")
    runs = runs_of(mask)
    ends = lines.select("slide_id", "row", (F.col("c1") + 2).alias("lo"), (F.col("c1") + 2).alias("hi"))  # what closes each line's last gap
    starts = lines.select("slide_id", "row", (F.col("c0") - 2).alias("lo"), (F.col("c0") - 2).alias("hi"))
    marks = runs.unionByName(ends).unionByName(starts)
    gaps = marks.select("slide_id", "row", (F.col("hi") + 1).alias("lo"), (F.lead("lo").over(line) - 1).alias("hi")).where("hi >= lo")
    found = run_components(gaps, 0)
    inner = found.join(frame.select("slide_id", "r0"), "slide_id").where(F.col("component.row") >= F.col("r0"))  # what lies outside begins in the line above
    filled = inner.select("slide_id", "row", F.explode(F.sequence("lo", "hi")).alias("col"))
    return mask.select("slide_id", "row", "col").unionByName(filled).distinct()


def binary_mask(mask: DataFrame, class_id: int) -> DataFrame:
    """The pixels of one class, its holes filled."""
    return fill_holes(mask.where(F.col("class_id") == class_id).select("slide_id", "row", "col"))


def white_out(pixels: DataFrame, mask: DataFrame, values: list[str], white: int = 255) -> DataFrame:
    """Pixels (slide_id, row, col, values) with all values white where there is no mask pixel."""
    marked = pixels.join(mask.select("slide_id", "row", "col").distinct().withColumn("_in", F.lit(True)), ["slide_id", "row", "col"], "left")
    return marked.select(*[F.when(F.col("_in"), F.col(c)).otherwise(F.lit(white)).alias(c) if c in values else F.col(c) for c in pixels.columns])


# Lightness, saturation and the first hue of class colours.
LIGHTNESS, SATURATION, FIRST_HUE = 0.6, 0.65, 0.01


def palette(n: int) -> list[tuple[float, float, float]]:
    """n colours of even hue (red, green, blue from 0 to 1), lightness 0.6 and saturation 0.65."""
    import colorsys

    return [colorsys.hls_to_rgb((i / n + FIRST_HUE) % 1, LIGHTNESS, SATURATION) for i in range(n)]


def coloured(mask: DataFrame, n_classes: int) -> DataFrame:
    """mask with its class' colour (r, g, b): class 1 has the palette's first, background none (0)."""
    colours = F.array(*[F.struct(*[F.lit(round(x, 6)).alias(c) for c, x in zip("rgb", p, strict=True)]) for p in palette(n_classes)])
    at = F.when(F.col("class_id").between(1, n_classes), F.get(colours, F.col("class_id") - 1))
    return mask.select("*", *[F.coalesce(at[c], F.lit(0.0)).alias(c) for c in "rgb"])


def to_source_level(boxes: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """Boxes of components found at a level, in pixels of level 0, rounded half to even."""
    at = lambda c, k: F.bround(F.col(c) * F.lit(float(k)), 0).cast("long").alias(c)
    kept = [c for c in boxes.columns if c not in ("row_min", "row_max", "col_min", "col_max")]
    return boxes.select(*kept, at("row_min", scale_y), at("row_max", scale_y), at("col_min", scale_x), at("col_max", scale_x))


def blended(image: DataFrame, heat: DataFrame, alpha: float, threshold: float | None = None) -> DataFrame:
    """Pixels (slide_id, row, col, v) mixed with heat (slide_id, row, col, heat): alpha of the heat, the rest of the pixel; pixels without heat, or with heat below the threshold, stay."""
    both = image.join(heat.select("slide_id", "row", "col", "heat"), ["slide_id", "row", "col"], "left")
    shown = F.col("heat").isNotNull() if threshold is None else F.col("heat") >= threshold
    return both.select("slide_id", "row", "col", F.round(F.when(shown, alpha * F.col("heat") + (1 - alpha) * F.col("v")).otherwise(F.col("v")), 6).alias("v"))


def component_boxes(found: DataFrame, min_size: int = 0, largest: int | None = None) -> DataFrame:
    """(slide_id, component, area, row_min, row_max, col_min, col_max) of components above min_size; of each slide the `largest` if given."""
    boxes = found.groupBy("slide_id", "component").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("area"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("lo").alias("col_min"), F.max("hi").alias("col_max")
    ).where(F.col("area") > min_size)
    if largest is None:
        return boxes
    rank = F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("area"), "component"))
    return boxes.withColumn("_rank", rank).where(F.col("_rank") <= largest).drop("_rank")


def _hull(xs, ys) -> list[tuple[int, int]]:
    points = sorted({*zip(xs, ys, strict=True)})
    if len(points) < 3:
        return points

    def half(ordered):
        out: list[tuple[int, int]] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def hulls(found: DataFrame) -> DataFrame:
    """Vertices (slide_id, label, roi_id, vertex_id, x, y) of each component's convex hull; a component has at most two run ends a row to hand over."""
    ends = found.groupBy("slide_id", "component", "row").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = ends.groupBy("slide_id", "component").agg(F.collect_list(F.struct("row", "lo", "hi")).alias("ends"))

    def corners(batches):
        for batch in batches:
            ends = batch.column(2)
            row, lo, hi = (x.to_numpy().tolist() for x in ends.flatten().flatten())
            of, at, xs, ys, stop = [], [], [], [], 0
            for i, n in enumerate(ends.value_lengths().to_pylist()):
                start, stop = stop, stop + n
                found = _hull(lo[start:stop] + hi[start:stop], 2 * row[start:stop])
                of += [i] * len(found)
                at += range(len(found))
                xs += [p[0] for p in found]
                ys += [p[1] for p in found]
            ints = [pa.array(v, pa.int32()) for v in (at, xs, ys)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)), *ints], ["slide_id", "roi_id", "vertex_id", "x", "y"])

    named = rows.select("slide_id", F.concat_ws("_", "component.row", "component.lo").alias("roi_id"), "ends")
    made = named.mapInArrow(corners, f"slide_id {rows.schema['slide_id'].dataType.simpleString()}, roi_id string, vertex_id int, x int, y int")
    return made.select("slide_id", F.lit("tissue").alias("label"), "roi_id", "vertex_id", "x", "y")


def canvas(tiles: DataFrame, side: int, background: int = 255) -> DataFrame:
    """(slide_id, row, col, line): square tiles (slide_id, x, y, px) put together; a row a line of pixels, which starts at the leftmost tile's column; gaps are background."""
    lines = tiles.select("slide_id", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.slice("px", r * side + 1, side))).alias("r", "part"), "x")
    whole = lines.groupBy("slide_id", (F.col("x") + F.col("r")).alias("row")).agg(F.array_sort(F.collect_list(F.struct("y", "part"))).alias("parts"))
    gap = lambda i: F.when(i > 0, F.col("parts")[i]["y"] - F.get(F.col("parts"), i - 1)["y"] - side).otherwise(0)
    filled = F.transform("parts", lambda p, i: F.concat(F.array_repeat(F.lit(background), F.greatest(gap(i), F.lit(0)).cast("int")), p["part"]))
    return whole.select("slide_id", "row", F.col("parts")[0]["y"].alias("col"), F.flatten(filled).alias("line"))


def local_entropy(image: np.ndarray, radius: int = 10) -> np.ndarray:
    """Entropy in bits of the values within a disk around each pixel, cut at the borders."""
    h, w = image.shape
    dy = np.arange(-radius, radius + 1)
    half = np.sqrt(radius**2 - dy**2).astype(int)
    rows, cols = np.arange(h)[:, None], np.arange(w)[None, :]

    def counts(binary):
        sums = np.zeros((h, w + 1), "i8")
        sums[:, 1:] = binary.cumsum(1)
        out = np.zeros((h, w), "i8")
        for d, k in zip(dy, half, strict=True):
            at = rows + d
            inside = (at >= 0) & (at < h)
            line = np.clip(at, 0, h - 1)
            out += np.where(inside, sums[line, np.minimum(cols + k, w - 1) + 1] - sums[line, np.maximum(cols - k, 0)], 0)
        return out

    total, found = counts(np.ones_like(image, "i8")), np.zeros((h, w))
    for v in np.unique(image):
        p = counts(image == v) / total
        found -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
    return found


def mean_local_entropy(tiles: DataFrame, item: str, pixels: str, side: int, radius: int = 10) -> DataFrame:
    """(item, entropy): the mean of each square tile's local entropy."""
    @F.pandas_udf("double")
    def of(px: pd.Series) -> pd.Series:
        return px.map(lambda p: float(local_entropy(np.asarray(p).reshape(side, side), radius).mean()))

    return tiles.select(item, F.round(of(pixels), 6).alias("entropy"))
