"""Encoders applied to tiles, PCA, linear probes and nested cross-validation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .metrics import binary_auc
from .optimise import minimise
from .rasters import checkpointed
from .tiles import hash_order

#: name -> a function that loads the encoder, once a task, and gives a function from a matrix of tiles to one of features.
ENCODERS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def encoder(name: str):
    def put(load):
        ENCODERS[name] = load
        return load

    return put


@encoder("cosine8")
def _cosine8():
    """Eight fixed cosine projections, for tests and as a pattern for encoders with weights."""
    return lambda x: x @ np.cos(np.outer(np.arange(x.shape[1]), np.arange(8)) * math.pi / 8)


def encode(tiles: DataFrame, item: str, vector: str, name: str) -> DataFrame:
    """(item, features array<double>) by a named encoder, in batches; tiles of one call have equally long vectors."""
    load = ENCODERS[name]

    def add(batches):
        run = load()
        for batch in batches:
            if batch.num_rows:
                made = run(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype("f8"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float64()))], [item, "features"])

    rows = tiles.select(item, vector).where(F.col(vector).isNotNull())
    return rows.mapInArrow(add, f"{item} {rows.schema[item].dataType.simpleString()}, features array<double>")


def principal_components(features: DataFrame, vector: str, k: int):
    """A fitted PCA over vectors that are not all zeros; the Gramian is summed where rows are, and only it comes to the driver."""
    rows = features.where(F.exists(vector, lambda v: v != 0)).select(array_to_vector(vector).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="pc").fit(rows)


#: Partial sums that one task adds up; more are added up by several tasks first.
SUMMED_AT_ONCE = 64


def _summed(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of the rows' vectors (column `sums`, packed); tasks add them up in rounds, and the driver gets one."""
    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    many = partials.rdd.getNumPartitions()
    while many > SUMMED_AT_ONCE:
        many = -(-many // SUMMED_AT_ONCE)
        partials = partials.repartition(many).mapInArrow(add, "sums binary")
    rows = partials.collect()
    return sum((np.frombuffer(r[0]) for r in rows), np.zeros(size))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype("f8")


def fit_logistic(rows: DataFrame, vector: str, label: str, chosen: Column, reg: list[float], iterations: int = 100) -> np.ndarray:
    """Coefficients (a row a model, the intercept last) of logistic models, each over the rows for which its entry of `chosen` (an array of flags) is true.

    A model minimises its rows' mean log loss and half of its `reg` times the
    squared coefficients, the intercept left out; without rows all is 0. All models
    are fitted at once: a step is one pass over the rows, which are written once,
    and it sums every model's gradient in its tasks. Null vectors and labels are
    left out.
    """
    kept = rows.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), chosen.cast("array<tinyint>").alias("m")).where("x is not null and y is not null")
    kept = checkpointed(kept)
    wide = kept.select(F.size("x").alias("n")).first()
    k = len(reg)
    if wide is None:
        return np.zeros((k, 1))
    d, penalty = wide["n"], np.array(reg)

    def passed(at: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros((k, d + 3))
            for batch in batches:
                if batch.num_rows:
                    x, y, m = _matrix(batch.column(0)), batch.column(1).to_numpy()[:, None], _matrix(batch.column(2))
                    z = x @ at[:, :d].T + at[:, d]
                    off = m * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                    total[:, :d] += off.T @ x
                    total[:, d] += off.sum(0)
                    total[:, d + 1] += (m * (np.logaddexp(0, z) - y * z)).sum(0)
                    total[:, d + 2] += m.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return _summed(kept.mapInArrow(part, "sums binary"), k * (d + 3)).reshape(k, d + 3)

    def loss(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = passed(at)
        n = np.maximum(total[:, d + 2], 1)
        gradient = total[:, : d + 1] / n[:, None]
        gradient[:, :d] += penalty[:, None] * at[:, :d]
        return total[:, d + 1] / n + penalty / 2 * (at[:, :d] ** 2).sum(1), gradient

    return minimise(loss, np.zeros((k, d + 1)), iterations, 1e-7)


def logistic_scores(rows: DataFrame, keep: list[str], vector: str, models: np.ndarray) -> DataFrame:
    """rows' columns `keep` and `scores`, every model's probability; one product an Arrow batch."""
    schema = StructType([*[rows.schema[c] for c in keep], StructField("scores", ArrayType(DoubleType()))])
    d = models.shape[1] - 1

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(batch.num_columns - 1)) @ models[:, :d].T + models[:, d]
                found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(found), pa.list_(pa.float64()))], [*keep, "scores"])

    return rows.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).cast("array<double>").alias("_x")).mapInArrow(put, schema)


def linear_probe(train: DataFrame, test: DataFrame, item: str, vector: str, label: str, portion: float = 1.0, models: int = 30, reg: float = 0.01) -> DataFrame:
    """(item, label, p): the mean probability of logistic models, each fitted on the train rows whose hash lies in its portion."""
    drawn = F.array(*[(F.conv(F.substring(hash_order(item, seed=m), 1, 8), 16, 10).cast("double") < portion * 2.0**32) for m in range(models)])
    fitted = fit_logistic(train, vector, label, drawn, [reg] * models)
    mean = F.aggregate("scores", F.lit(0.0), lambda a, p: a + p) / models
    return logistic_scores(test, [item, label], vector, fitted).select(item, label, mean.alias("p")).withColumnRenamed(label, "label")


def nested_cv(rows: DataFrame, item: str, vector: str, label: str, grid: list[float], outer: int = 5, inner: int = 5) -> DataFrame:
    """(split, reg, inner_auc, auc): of each outer fold the regularisation best over the inner folds, the first of equals, and its AUC on the fold.

    Folds follow from the hash of the item, so no row moves. All inner fits run in
    the same passes, and so do the final ones; a row is scored by the models of
    the folds that it is left out of, and one aggregation gives all their AUCs.
    """
    fold = lambda k, seed: F.pmod(F.conv(F.substring(hash_order(item, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
    data = rows.withColumn("outer_", fold(outer, 1)).withColumn("inner_", fold(inner, 2))

    def aucs(tasks: list[tuple[int, int | None, float]]) -> list[float | None]:
        """Of every task (outer fold, inner fold or none, regularisation) the AUC on the fold that it leaves out."""
        apart = lambda o, i: F.col("outer_") != o if i is None else (F.col("outer_") != o) & (F.col("inner_") != i)
        tested = lambda o, i: F.col("outer_") == o if i is None else (F.col("outer_") != o) & (F.col("inner_") == i)
        fitted = fit_logistic(data, vector, label, F.array(*[apart(o, i) for o, i, _ in tasks]), [reg for _, _, reg in tasks])
        scored = logistic_scores(data, [label, "outer_", "inner_"], vector, fitted)
        asked = F.array(*[tested(o, i) for o, i, _ in tasks])
        long = scored.select(F.col(label).cast("int").alias("y"), F.explode(F.filter(F.transform("scores", lambda s, k: F.struct(k.alias("task"), s.alias("s"), F.get(asked, k).alias("asked"))), lambda t: t["asked"])).alias("t"))
        found = binary_auc(long.select("y", "t.task", F.round("t.s", 12).alias("s")), "s", "y", "task").collect()
        by = {r["task"]: r["auc"] for r in found}
        return [by.get(k) for k in range(len(tasks))]

    tasks = [(o, i, reg) for o in range(outer) for reg in grid for i in range(inner)]
    got = dict(zip(tasks, aucs(tasks), strict=True))
    best, means = [], {}
    for o in range(outer):
        for reg in grid:
            known = [x for i in range(inner) if (x := got[o, i, reg]) is not None]
            means[o, reg] = sum(known) / len(known) if known else float("-inf")
        best.append(max(range(len(grid)), key=lambda g: (means[o, grid[g]], -g)))
    final = aucs([(o, None, grid[g]) for o, g in enumerate(best)])
    return rows.sparkSession.createDataFrame([(o, float(grid[g]), round(means[o, grid[g]], 6), a) for o, (g, a) in enumerate(zip(best, final, strict=True))], "split int, reg double, inner_auc double, auc double")
