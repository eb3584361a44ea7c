"""Pooling of tile features into slide features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohorts import broadcast_if_small
from .metrics import running_sum


def mean_pool(features: DataFrame, key: str = "slide_id", vector: str = "embedding") -> DataFrame:
    """(key, pos, mean): each slide's mean vector, a row a position, so that partial sums meet in the shuffle."""
    return features.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def softmax_over(score: Column, key: str) -> Column:
    """Softmax of a score within the rows of a key."""
    w = Window.partitionBy(key)
    return F.exp(score - F.max(score).over(w)) / F.sum(F.exp(score - F.max(score).over(w))).over(w)


def softmax(df: DataFrame, key: str, score: str, into: str) -> DataFrame:
    """df and `into`: softmax_over() by two aggregations, whose partial results meet, so that no key's rows go to one task; a row without a key has null."""
    top = broadcast_if_small(df.groupBy(F.col(key).alias("_key")).agg(F.max(score).alias("_top")))
    sums = df.join(top, F.col(key) == F.col("_key")).groupBy("_key", "_top").agg(F.sum(F.exp(F.col(score) - F.col("_top"))).alias("_sum"))
    return df.join(broadcast_if_small(sums), F.col(key) == F.col("_key"), "left").withColumn(into, F.exp(F.col(score) - F.col("_top")) / F.col("_sum")).drop("_key", "_top", "_sum")


def attention_pool(tiles: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """The value's mean by softmax weights: one pass of exact sums after each key's greatest score."""
    top = tiles.groupBy(key).agg(F.max(score).alias("top"))
    weight = F.exp(F.col(score) - F.col("top"))
    return tiles.join(top, key).groupBy(key).agg(F.round(F.sum(weight * F.col(value)) / F.sum(weight), 6).alias("pooled"), F.count("*").alias("n_tiles"))


def extreme_scores(tiles: DataFrame, key: str, score: str, n_top: int, n_bottom: int) -> DataFrame:
    """(key, side, place, score): the n_top greatest and n_bottom least scores of each key, padded with zeros."""
    def side(name: str, order: Column, n: int) -> DataFrame:
        ranked = tiles.select(key, F.col(score).alias("score"), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("place")).where(F.col("place") <= n)
        wanted = tiles.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("place"))
        return wanted.join(ranked, [key, "place"], "left").select(key, F.lit(name).alias("side"), "place", F.coalesce("score", F.lit(0.0)).alias("score"))

    return side("top", F.col(score).desc(), n_top).unionByName(side("bottom", F.col(score).asc(), n_bottom))


def percentile_rank(df: DataFrame, key: str, score: str) -> DataFrame:
    """Average-tie rank of a score within its key, times 100 over the key's rows; different scores are counted first and summed up in blocks, so a key may hold any share of the rows."""
    per = df.groupBy(F.col(key).alias("_key"), F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    summed = running_sum(per, ["_key"], [F.col("_score")], F.col("_n"), "_upto", df.count())
    sizes = per.groupBy(F.col("_key").alias("_of")).agg(F.sum("_n").alias("_all"))
    ranked = summed.join(broadcast_if_small(sizes), F.col("_key").eqNullSafe(F.col("_of"))).select("_key", "_score", F.round((F.col("_upto") - (F.col("_n") - 1) / 2) * 100 / F.col("_all"), 6).alias("percentile"))
    return df.join(ranked, F.col(key).eqNullSafe(F.col("_key")) & F.col(score).eqNullSafe(F.col("_score"))).drop("_key", "_score")


def critical_instance_pool(tiles: DataFrame, key: str, item: str, score: str, vector: str) -> DataFrame:
    """(key, critical, attention_max): the tile of the greatest score of each key, and the greatest dot product of any of its tiles with that one."""
    top = tiles.groupBy(key).agg(F.max_by(F.struct(F.col(item).alias("i"), F.col(vector).alias("q")), F.struct(F.col(score), -F.col(item))).alias("c"))
    dot = F.aggregate(F.zip_with(vector, "c.q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    return tiles.join(top, key).groupBy(key).agg(F.first("c.i").alias("critical"), F.round(F.max(dot), 5).alias("attention_max"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _dot(weights: list[float], vector: Column) -> Column:
    return F.aggregate(F.zip_with(F.array(*map(F.lit, weights)), vector, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda x, y: x + y)


def gated_attention_pool(tiles: DataFrame, key: str, vector: str, v: list[list[float]], u: list[list[float]], w: list[float], temperature: float = 1.0) -> DataFrame:
    """(key, pos, pooled): the vectors' mean by the softmax of w . (tanh(V x) * sigmoid(U x)) / temperature within a key."""
    gates = [F.lit(float(a)) * F.tanh(_dot(x, F.col(vector))) * sigmoid(_dot(y, F.col(vector))) for a, x, y in zip(w, v, u, strict=True)]
    scored = tiles.select(key, vector, (sum(gates[1:], gates[0]) / temperature).alias("_score"))
    return _softmax_pool(scored, key, vector)


def _softmax_pool(scored: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, pooled) of (key, vector, _score)."""
    top = scored.groupBy(key).agg(F.max("_score").alias("_top"))
    weighted = scored.join(top, key).select(key, F.exp(F.col("_score") - F.col("_top")).alias("_w"), F.posexplode(vector).alias("pos", "_v"))
    return weighted.groupBy(key, "pos").agg(F.round(F.sum(F.col("_w") * F.col("_v").cast("double")) / F.sum("_w"), 6).alias("pooled"))


def critical_attention_pool(tiles: DataFrame, key: str, item: str, score: str, vector: str) -> DataFrame:
    """(key, pos, pooled): the vectors' mean by the softmax, within a key, of their dot products with the vector of its tile of the greatest score, over the root of the length."""
    top = tiles.groupBy(key).agg(F.max_by(F.col(vector), F.struct(F.col(score), -F.col(item))).alias("_q"))
    dot = F.aggregate(F.zip_with(vector, "_q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    return _softmax_pool(tiles.join(top, key).select(key, vector, (dot / F.sqrt(F.size(vector))).alias("_score")), key, vector)


def mean_of_branches(scores: DataFrame, key: str, top: str, bag: str) -> DataFrame:
    """(key, logit): half of the greatest tile's score and half of the bag's."""
    return scores.select(key, F.round(0.5 * (F.col(top) + F.col(bag)), 6).alias("logit"))


def padded(values: Column, length: Column | int, fill) -> Column:
    """struct<values, mask>: the first `length` values, filled up to as many; the mask is true where filled."""
    n = F.lit(length) if isinstance(length, int) else length
    gap = F.greatest(n - F.size(values), F.lit(0))
    kept = F.slice(values, F.lit(1), n)
    return F.struct(F.concat(kept, F.array_repeat(fill, gap)).alias("values"), F.concat(F.array_repeat(F.lit(False), F.least(F.size(values), n)), F.array_repeat(F.lit(True), gap)).alias("mask"))
