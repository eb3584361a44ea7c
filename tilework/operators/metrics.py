"""Classification and survival metrics, losses and summaries as aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rasters import checkpointed


def accuracy(scored: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    return scored.agg(F.round(F.avg(((F.col(logit) > 0).cast("int") == F.col(label)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


#: Rows that one block of an ordering holds about; an ordering of fewer rows is one block.
RANK_BLOCK = 1_000_000


def in_blocks(df: DataFrame, order: list, rows: int) -> DataFrame:
    """df with `_block`, which ascends with the order: ranges of about RANK_BLOCK rows each, so as many as `rows`, a bound of df's, asks for.

    Ranges are drawn by Spark's own range partitioning, so no cut points come to
    the driver; they are written, since a number out of a partition may not change.
    """
    if rows <= RANK_BLOCK:
        return df.withColumn("_block", F.lit(0))
    return checkpointed(df.repartitionByRange(-(-rows // RANK_BLOCK), *order).withColumn("_block", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column, into: str, rows: int) -> DataFrame:
    """df and `into`: the sum of value over the rows of a key up to each row in the order; sums within blocks, and the blocks' totals carried on. `rows` bounds df's rows."""
    held = in_blocks(df.withColumn("_value", value), order, rows)
    within = F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if rows <= RANK_BLOCK:
        return held.withColumn(into, within).drop("_block", "_value")
    totals = held.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    return held.withColumn("_within", within).join(carried, [*keys, "_block"]).withColumn(into, F.col("_within") + F.col("_before")).drop("_block", "_value", "_within", "_before")


def binary_auc(scored: DataFrame, score: str = "score", label: str = "label", by: str | None = None) -> DataFrame:
    """Mann-Whitney AUC; null where there is one class only.

    Scores collapse to one row each before the cumulative count, so ties cost
    nothing; distinct scores are summed up in blocks.
    """
    keys = [by] if by else []
    per = scored.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    summed = running_sum(per, keys, ["s"], F.col("neg"), "upto", scored.count())
    won = summed.withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return won.groupBy(*keys).agg(F.round(F.when(pairs > 0, F.sum("won") / pairs), 6).alias("auc"))


def mean_auc(by_class: DataFrame) -> DataFrame:
    """The mean of the classes' AUC (one row each, rounded as they are), null if any of them is."""
    return by_class.agg(F.round(F.when(F.count("*") == F.count("auc"), F.avg("auc")), 6).alias("mean_auc"), F.count("*").alias("n_classes"))


def argmax(scores: Column) -> Column:
    """The place of the greatest score, from 0; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def multiclass_accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    return rows.agg(F.round(F.avg((argmax(F.col(scores)) == F.col(label)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def class_metrics(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """(class, auc, acc, f1) of each class against the rest, where scores has a score for each class."""
    long = rows.select(argmax(F.col(scores)).alias("p"), F.col(label).alias("y"), F.posexplode(scores).alias("class", "s"))
    long = long.withColumn("hit", (F.col("y") == F.col("class")).cast("int")).withColumn("said", (F.col("p") == F.col("class")).cast("int"))
    both = F.sum(F.col("hit") * F.col("said"))
    scored = long.groupBy("class").agg(F.round(F.avg((F.col("hit") == F.col("said")).cast("double")), 6).alias("acc"), F.round(2 * both / F.greatest(F.sum("hit") + F.sum("said"), F.lit(1)), 6).alias("f1"))
    return binary_auc(long, "s", "hit", "class").join(scored, "class").select("class", "auc", "acc", "f1")


def _ranked(values: DataFrame, column: str, rows: int) -> DataFrame:
    """(column, rank) of the distinct values of a column without nulls: ranks within blocks, and the blocks' totals carried on."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    held = in_blocks(distinct, [F.col(column)], rows)
    here = F.row_number().over(Window.partitionBy("_block").orderBy(column)) - 1
    if rows <= RANK_BLOCK:
        return held.select(column, here.alias("rank"))
    before = held.groupBy("_block").agg(F.count("*").alias("n")).select("_block", (F.sum("n").over(Window.orderBy("_block")) - F.col("n")).alias("before"))
    return held.withColumn("here", here).join(before, "_block").select(column, (F.col("before") + F.col("here")).alias("rank"))


#: Ranks of risks in one block of cindex().
RISK_BLOCK = 4096


def cindex(rows: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """Harrell's concordance over all rows: an event at t is compared with all later times, and with censored rows of the same time.

    No pairs are made. Of two places in the order of time (at one time, events
    first) the earlier has 0 and the later 1 in the highest bit in which they
    differ; so for each bit, and all higher ones alike, the rows with 1 of lower and
    of equal risk are counted for the events with 0, in blocks of risks whose totals
    are carried on.
    """
    source = rows.where(F.col(time).isNotNull()).select(F.col(time).alias("t"), F.coalesce(F.col(event), F.lit(False)).alias("e"), F.col(risk).alias("r"), (~F.col(event)).alias("censored"))
    n = rows.count()
    times = _ranked(source, "t", n).withColumnRenamed("rank", "k")
    risks = _ranked(source, "r", n).withColumnRenamed("rank", "q")
    place = F.col("k") * 2 + F.coalesce("censored", F.lit(False)).cast("int")
    placed = source.join(times, "t").join(risks, "r", "left").groupBy(place.alias("place"), "q").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("long")).alias("events"))
    bits = max(1, (2 * n).bit_length())
    level = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    late = F.expr("shiftright(place, bit) & 1") == 1
    keys = ["bit", "over"]
    sides = level.withColumn("over", F.expr("shiftright(place, bit + 1)")).groupBy(*keys, "q").agg(F.sum(F.when(late, F.col("n")).otherwise(0)).alias("later"), F.sum(F.when(late, 0).otherwise(F.col("events"))).alias("asking"))
    sides = sides.withColumn("block", F.floor(F.col("q") / RISK_BLOCK))
    blocks = sides.groupBy(*keys, "block").agg(F.sum("later").alias("sum"))
    every = Window.partitionBy(*keys)
    carried = blocks.select(*keys, F.col("block").alias("of"), (F.sum("sum").over(every.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("under"), F.sum("sum").over(every).alias("all"), F.sum(F.when(F.col("block").isNull(), F.col("sum")).otherwise(0)).over(every).alias("unknown"))
    within = F.sum("later").over(Window.partitionBy(*keys, "block").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)) - F.col("later")
    counted = sides.withColumn("within", within).alias("s").join(carried.alias("c"), (F.col("s.bit") == F.col("c.bit")) & (F.col("s.over") == F.col("c.over")) & F.col("block").eqNullSafe(F.col("of")))
    twice = F.when(F.col("q").isNull(), 0).otherwise(F.col("asking") * (2 * (F.col("within") + F.col("under") - F.col("unknown")) + F.col("later")))
    totals = counted.agg(F.sum(twice).alias("won"), F.coalesce(F.sum(F.col("asking") * F.col("all")), F.lit(0)).alias("n_pairs"))
    return totals.select(F.round(F.when(F.col("n_pairs") > 0, F.col("won") / 2 / F.col("n_pairs")), 6).alias("cindex"), "n_pairs")


def bce_loss(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def cox_loss(rows: DataFrame, group: str, time: str, event: str, risk: str, item: str) -> DataFrame:
    """Mean negative partial log likelihood of each group: the hazards of all at risk are summed over descending time, events first among equals, in blocks of times."""
    source = rows.select(group, F.col(time).alias("_t"), F.col(event).alias("_e"), F.col(risk).alias("_r"), F.col(item).alias("_i"))
    summed = running_sum(source, [group], [F.col("_t").desc(), F.col("_e").desc(), F.col("_i")], F.exp("_r"), "_h", rows.count())
    part = F.when(F.col("_e"), F.log("_h") - F.col("_r")).otherwise(0.0)
    return summed.select(group, part.alias("part")).groupBy(group).agg(F.round(F.avg("part"), 6).alias("loss"), F.count("*").alias("n"))


def class_scores(predicted: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(class, tp, fp, fn, f1) of each class that is a label or a prediction."""
    both = predicted.select(F.explode(F.array_distinct(F.array(prediction, label))).alias("class"), prediction, label)
    p, y = F.col(prediction) == F.col("class"), F.col(label) == F.col("class")
    n = lambda c: F.sum(c.cast("long"))
    out = both.groupBy("class").agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"))
    return out.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


#: name -> statistic of rows (prediction or value p, label y) under weights w, as an aggregate; more may be added.
STATISTICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mean": lambda p, y, w: F.sum(p * w) / F.sum(w),
    "accuracy": lambda p, y, w: F.sum(F.when(p == y, w).otherwise(0)) / F.sum(w),
    "f1": lambda p, y, w: 2 * F.sum(p * y * w) / F.sum((p + y) * w),
}


def bootstrap_interval(rows: DataFrame, item: str, value: str, resamples: int = 1000, confidence: float = 0.95, statistic: str = "mean", label: str | None = None) -> DataFrame:
    """A basic bootstrap interval of a statistic: each row's weight in a resample is a Poisson(1) draw by the hash of (resample, row), so rows are neither indexed nor moved."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", "b", F.col(item).cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    cuts = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    of, source = STATISTICS[statistic], rows.select(item, F.col(value).cast("double").alias("v"), F.col(label or value).cast("double").alias("y"))
    drawn = source.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = drawn.groupBy("b").agg(of(F.col("v"), F.col("y"), F.col("w")).alias("m"))
    a = (1 - confidence) / 2
    ends = means.agg(F.expr(f"percentile(m, {1 - a})").alias("hi"), F.expr(f"percentile(m, {a})").alias("lo"))
    whole = source.agg(of(F.col("v"), F.col("y"), F.lit(1)).alias("estimate"))
    return whole.crossJoin(ends).select(F.round("estimate", 6).alias("estimate"), F.round(2 * F.col("estimate") - F.col("hi"), 6).alias("low"), F.round(2 * F.col("estimate") - F.col("lo"), 6).alias("high"))  # two single rows


def best_config(chosen: DataFrame) -> DataFrame:
    """The configuration (config, epoch, value) of the greatest value, the first of equals."""
    return chosen.agg(F.max_by(F.struct("config", "epoch", "value"), F.struct("value", F.struct(-F.col("epoch")))).alias("b")).select("b.*")


def select_epoch(history: DataFrame) -> DataFrame:
    """(config, epoch, value): each config's epoch of the greatest mean over splits, the first of equals."""
    means = history.groupBy("config", "epoch").agg(F.round(F.avg("value"), 9).alias("value"))
    best = means.groupBy("config").agg(F.max_by(F.struct("epoch", "value"), F.struct(F.col("value"), -F.col("epoch"))).alias("b"))
    return best.select("config", "b.epoch", F.round("b.value", 6).alias("value"))


def cv_summary(history: DataFrame) -> DataFrame:
    """(config, mean, std) over the splits' last epochs."""
    last = history.groupBy("config", "split").agg(F.max_by("value", "epoch").alias("v"))
    return last.groupBy("config").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))
