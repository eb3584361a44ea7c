"""Pixel statistics of tiles given as arrays: intensity, dark area, Otsu's threshold, channel moments, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohorts import broadcast_if_small


def to_pixels(vector: Column) -> Column:
    """Values in [-1, 1] as bytes."""
    return F.transform(vector, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127.5).cast("int"))))


def mean_intensity(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(pixels)


def dark_share(pixels: Column, threshold: int) -> Column:
    """The share of pixels at or below the threshold."""
    return F.size(F.filter(pixels, lambda v: v <= threshold)) / F.size(pixels)


def otsu_threshold(histogram: DataFrame) -> DataFrame:
    """The bin (bin, n) that best parts a histogram in two; a histogram has 256 rows at most."""
    up_to, all_bins = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = histogram.select("bin", F.sum("n").over(up_to).cast("double").alias("w0"), F.sum(F.col("n") * F.col("bin")).over(up_to).cast("double").alias("s0"), F.sum("n").over(all_bins).cast("double").alias("w"), F.sum(F.col("n") * F.col("bin")).over(all_bins).cast("double").alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = h.where(w1 > 0).withColumn("between", F.round(F.col("w0") * w1 * gap * gap / F.col("w") / F.col("w"), 6))
    return between.agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).cast("int").alias("threshold"))


def channel_stats(pixels: DataFrame, channel: str, value: str) -> DataFrame:
    """Mean and population deviation of each channel, of values scaled to [0, 1]."""
    v = F.col(value).cast("double") / 255
    return pixels.groupBy(channel).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.count("*").alias("n"))


def normalize(pixels: Column, mean: float, std: float) -> Column:
    return F.transform(pixels, lambda v: (v / 255.0 - mean) / std)


def standard_scale(features: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, pos, z): positions scaled by their own mean and population deviation; the statistics are a row a position."""
    long = features.select(item, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    stats = long.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return long.join(broadcast_if_small(stats), "pos").select(item, "pos", F.round((F.col("v") - F.col("m")) / F.col("s"), 5).alias("z"))


def blue_share(pixels: Column) -> Column:
    """The share of struct pixels (r, g, b bytes) whose hue lies in [100, 130] of 180 and saturation is 150 at least."""
    def is_blue(p: Column) -> Column:
        hi, lo = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
        hue = F.when(hi == lo, 0.0).when(hi == p["b"], 120 + 30.0 * (p["r"] - p["g"]) / (hi - lo)).when(hi == p["g"], 60 + 30.0 * (p["b"] - p["r"]) / (hi - lo)).otherwise(30.0 * (p["g"] - p["b"]) / (hi - lo))
        return hue.between(100, 130) & (F.when(hi == 0, 0.0).otherwise(255.0 * (hi - lo) / hi) >= 150)

    return F.size(F.filter(pixels, is_blue)) / F.size(pixels)
