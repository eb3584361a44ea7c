"""Annotation tables: vertices(slide_id, label, roi_id, vertex_id, x, y) and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bbox(vertices: DataFrame, space: int = 100, mag: int = 0) -> DataFrame:
    """Each slide's box around its vertices, padded on every side, at a magnification; not clipped."""
    scale = 1 << mag
    at = lambda c: (c / scale).cast("long")  # noqa: E731  truncates towards zero
    return vertices.groupBy("slide_id").agg(
        at(F.min("x") - space).alias("x_min"), at(F.max("x") + space).alias("x_max"), at(F.min("y") - space).alias("y_min"), at(F.max("y") + space).alias("y_max")
    )


def roi_counts(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("label").agg(F.countDistinct("slide_id", "roi_id").alias("n_rois"), F.count("*").alias("n_vertices"))


def class_key(vertices: DataFrame) -> DataFrame:
    """(label, class_id): labels numbered from 1 by first appearance; 0 is background. One row a label, a bounded table."""
    first = vertices.groupBy("label").agg(F.min("vertex_id").alias("first_seen"))
    return first.select("label", F.row_number().over(Window.orderBy("first_seen", "label")).alias("class_id"))


def rename_labels(vertices: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return vertices.withColumn("label", F.coalesce(F.element_at(pairs, F.col("label")), F.col("label")))


def filter_labels(vertices: DataFrame, labels: list[str]) -> DataFrame:
    return vertices.where(F.col("label").isin(labels))


def polygon_measures(vertices: DataFrame) -> DataFrame:
    """(slide_id, label, roi_id, n_vertices, area, perimeter) by the shoelace formula; the last vertex joins the first."""
    return _measured(vertices).drop("cx", "cy")


def polygon_centroids(vertices: DataFrame) -> DataFrame:
    """(slide_id, label, roi_id, cx, cy): centres of mass; null where the signed area is 0."""
    return _measured(vertices).select("slide_id", "label", "roi_id", "cx", "cy")


def _measured(vertices: DataFrame) -> DataFrame:
    roi = ["slide_id", "label", "roi_id"]
    w = Window.partitionBy(*roi).orderBy("vertex_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).cast("double")
    edges = vertices.select(*roi, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), nxt("x").alias("nx"), nxt("y").alias("ny"))
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    length = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)
    return edges.groupBy(*roi).agg(F.count("*").alias("n_vertices"), F.round(F.abs(F.sum(cross)) / 2, 3).alias("area"), F.round(F.sum(length), 3).alias("perimeter"),
        *[F.round(F.when(F.sum(cross) != 0, F.sum((F.col(c) + F.col(f"n{c}")) * cross) / (3 * F.sum(cross))), 3).alias(f"c{c}") for c in "xy"],
    )


def mask_bbox(mask: DataFrame) -> DataFrame:
    """The box of each slide's mask pixels that are not background."""
    return mask.where("class_id <> 0").groupBy("slide_id").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.count("*").alias("n_pixels"))


def class_weights(mask: DataFrame) -> DataFrame:
    """Inverse frequency of each class; the window runs over one row a class."""
    n = mask.groupBy("class_id").agg(F.count("*").alias("n"))
    return n.select("class_id", "n", F.round(F.sum("n").over(Window.partitionBy()) / F.col("n"), 6).alias("weight"))


def edges_of(vertices: Column) -> Column:
    """Neighbouring pairs of an array of points, the last with the first."""
    turned = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))
    return F.arrays_zip(vertices.alias("a"), turned.alias("b"))
