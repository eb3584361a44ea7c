"""Tile grids over slides: generation, filters, level arithmetic and regions, all as lazy expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_extent(tile_dim: int, downsample: Column | int = 1) -> Column:
    """A tile's side in pixels of level 0, at a level with this downsample (its whole part counts)."""
    return (F.lit(tile_dim) * (F.floor(downsample) if isinstance(downsample, Column) else F.lit(int(downsample)))).cast("int")


def _axis(low: Column, end: Column, step: Column) -> Column:  # sequence() would count downwards where the stop lies below the start
    return F.when(end >= low, F.sequence(low.cast("int"), end.cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))


def tile_grid(slides: DataFrame, tile_dim: int, stride: int | None = None, drop_edges: bool = False, downsample: str | int = 1) -> DataFrame:
    """(slide_id, x, y) for every grid point of each slide (slide_id, width, height); x runs over rows, y over columns.

    Slides with x_min, x_max, y_min, y_max have their grids within that border
    only. Tile and stride are in pixels of a level, whose downsample is a number
    or a column. Tiles that overhang stay unless drop_edges. Empty slides and
    borders have no tiles.
    """
    scale = F.col(downsample) if isinstance(downsample, str) else downsample
    step, extent = tile_extent(stride or tile_dim, scale), tile_extent(tile_dim, scale)
    bordered = {"x_min", "x_max", "y_min", "y_max"} <= set(slides.columns)
    low = lambda c: F.col(f"{c}_min") if bordered else F.lit(0)
    high = lambda c, size: F.col(f"{c}_max") if bordered else F.col(size)
    end = lambda c, size: high(c, size) - (extent if drop_edges else 1)
    rows = slides.select("slide_id", F.explode(_axis(low("x"), end("x", "height"), step)).alias("x"), _axis(low("y"), end("y", "width"), step).alias("ys"))
    return rows.select("slide_id", "x", F.explode("ys").alias("y"))


def tile_count(size: Column, tile_dim: int, stride: int | None = None, drop_edges: bool = False) -> Column:
    """How many grid points an axis of this size has; the count of a slide is the product of its axes', and no tile is made."""
    end = size - (tile_dim if drop_edges else 1)
    return F.when(end >= 0, F.floor(end / (stride or tile_dim)) + 1).otherwise(0).cast("long")


def snap_dimension(dim: Column, factor: int, threshold: Column | int | None = None, operator: str = "=>") -> Column:
    """The multiple of factor, nearest to dim, of those that stand in `operator` to the threshold (dim itself, if none): '>', '=>', '<'; '=<' leaves equality out, too.

    Of two as near the smaller is taken.
    """
    limit = dim if threshold is None else F.lit(threshold) if isinstance(threshold, int) else threshold
    down = F.floor(dim / factor) * factor
    nearest = F.when(dim - down <= down + factor - dim, down).otherwise(down + factor)
    if operator in (">", "=>"):
        least = F.ceil(limit / factor) * factor if operator == "=>" else F.floor(limit / factor) * factor + factor
        return F.greatest(nearest, least, F.lit(0)).cast("long")
    if operator in ("<", "=<"):
        return F.greatest(F.least(nearest, F.ceil(limit / factor) * factor - factor), F.lit(0)).cast("long")
    raise ValueError(f"unknown operator {operator}")


def to_level(value: Column, downsample: Column | int) -> Column:
    """A level-0 coordinate at another level, rounded half to even."""
    return F.bround(value / downsample, 0).cast("long")


def point_at_level(value: Column, size: Column, level_size: Column) -> Column:
    """A level-0 coordinate at a level, by the two levels' own sizes, rounded half to even."""
    return F.bround(value * level_size / size, 0).cast("long")


def size_between(size: Column, from_downsample: Column, to_downsample: Column) -> Column:
    """A size at one level as a size at another, rounded half to even."""
    return F.bround(size * from_downsample / to_downsample, 0).cast("long")


def region_window(x: Column, y: Column, size_x: Column, size_y: Column, width: Column, height: Column, mag: int, factor: int | None = None, threshold: int | None = None, operator: str = "=>") -> Column:
    """The window of a region, its size first snapped if there is a factor, once clipped to its slide, in pixels of the magnification; beyond the slide it is empty."""
    scale = 1 << mag
    snap = lambda c: c if factor is None else snap_dimension(c, factor, threshold, operator)
    side = lambda size, room: F.floor(F.greatest(F.least(snap(size), room), F.lit(0)) / scale)
    return F.struct(x.alias("x"), y.alias("y"), side(size_x, width - x).alias("w"), side(size_y, height - y).alias("h"))


def overlay_rects(tiles: DataFrame, tile_dim: int, downsample: float) -> DataFrame:
    """Rectangles of tiles on a picture that is smaller by downsample, truncated."""
    at = lambda c: (F.col(c) / downsample).cast("int")
    side = F.lit(int(tile_dim / downsample))
    return tiles.select("slide_id", at("y").alias("left"), at("x").alias("top"), side.alias("w"), side.alias("h"))


def tissue_filter(tiles: DataFrame, mask: DataFrame, tile_dim: int, class_id: int, threshold: float = 0.5, stride: int | None = None) -> DataFrame:
    """Tiles of a grid of which at least `threshold` of the area is mask pixels (slide_id, row, col, class_id) of a class.

    The grid may begin anywhere on a slide, and tiles may overlap or leave gaps.
    Pixels are counted in cells as large as tile and stride allow; a cell names the
    tiles that it lies in, so an equi-join replaces the range join and no pixel is
    expanded. A threshold of 0 keeps all tiles.
    """
    step = stride or tile_dim
    cell = math.gcd(step, tile_dim)
    origin = tiles.groupBy("slide_id").agg(F.pmod(F.min("x"), F.lit(step)).alias("x0"), F.pmod(F.min("y"), F.lit(step)).alias("y0"))
    at = lambda c, o: (F.floor((F.col(c) - F.col(o)) / cell) * cell).cast("int")
    cells = mask.where(F.col("class_id") == class_id).join(origin, "slide_id").groupBy("slide_id", "x0", "y0", at("row", "x0").alias("r"), at("col", "y0").alias("c")).agg(F.count("*").alias("n"))

    def starts(c: str, o: str) -> Column:
        first, last = F.ceil((F.col(c) + cell - tile_dim) / step), F.floor(F.col(c) / step)
        return F.transform(_axis(first, last, F.lit(1)), lambda j: (j * step + F.col(o)).cast("int"))

    named = cells.select("slide_id", "n", starts("c", "y0").alias("ys"), F.explode(starts("r", "x0")).alias("x")).select("slide_id", "x", F.explode("ys").alias("y"), "n")
    area = named.groupBy("slide_id", "x", "y").agg(F.sum("n").alias("pixels"))
    if threshold <= 0:
        return tiles.join(area, ["slide_id", "x", "y"], "left").select("slide_id", "x", "y", F.coalesce("pixels", F.lit(0)).alias("pixels"))
    return tiles.join(area, ["slide_id", "x", "y"]).where(F.col("pixels") >= threshold * tile_dim * tile_dim).select("slide_id", "x", "y", "pixels")


def filter_tiles(tiles: DataFrame, remove: Callable, pixels: str = "px", shape: tuple[int, ...] | None = None, **options) -> DataFrame:
    """The tiles that `remove` does not say yes to.

    remove(column, **options) gives a Column, which stays in the JVM; with a shape,
    remove(array, **options) gets each tile as a numpy array of that shape and
    gives a bool, in Arrow batches. A tile whose pixels are null is kept.
    """
    if shape is None:
        return tiles.where(~F.coalesce(remove(F.col(pixels), **options), F.lit(False)))
    at = tiles.columns.index(pixels)

    def keep(batches):
        for batch in batches:
            told = [x is not None and bool(remove(np.asarray(x).reshape(shape), **options)) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not t for t in told], pa.bool_()))

    return tiles.mapInArrow(keep, tiles.schema)


def hash_order(*keys: str, seed: int = 0) -> Column:
    """A reproducible random order of rows: SHA-256 of the keys and the seed."""
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))), 256)


def sample_per_group(df: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group without replacement, in the order of their hashes."""
    w = Window.partitionBy(group).orderBy(hash_order(*keys, seed=seed), *keys)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sample_with_replacement(df: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n draws of each group's rows, with `draw` from 0: draw i takes the row whose place, by hash order, is the hash of (group, i) modulo the group's rows."""
    w = Window.partitionBy(group).orderBy(hash_order(*keys, seed=seed), *keys)
    placed = df.withColumn("_place", F.row_number().over(w) - 1)
    draws = df.groupBy(group).agg(F.count("*").alias("_n")).select(group, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.col("draw").cast("string"), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("long") % F.col("_n")
    return draws.withColumn("_place", drawn.cast("int")).join(placed, [group, "_place"]).drop("_n", "_place")


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group by an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def stitch_completeness(patches: DataFrame) -> DataFrame:
    """(slide_id, step, n, completeness) of patches (slide_id, x, y): the share of the grid, spanned by their extremes and the least step along either axis, that is present."""
    distinct = patches.select("slide_id", "x", "y").distinct()
    axis = lambda c: distinct.select("slide_id", F.col(c).alias("at")).distinct().select("slide_id", (F.col("at") - F.lag("at").over(Window.partitionBy("slide_id").orderBy("at"))).alias("gap"))
    steps = axis("x").unionByName(axis("y")).groupBy("slide_id").agg(F.min("gap").alias("step"))
    span = distinct.groupBy("slide_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    cells = lambda c: F.floor((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.col("step")) + 1
    return span.join(steps, "slide_id").where("step is not null").select("slide_id", F.col("step").cast("long").alias("step"), "n", F.round(F.col("n") / (cells("x") * cells("y")), 6).alias("completeness"))
