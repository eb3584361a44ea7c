"""Given networks over tables of tokens and tiles: scorers by layers, attention of a class token, two-level embeddings and Nystroem attention.

Weights are matrices of a model's size, so they go with the tasks; tables of them
are read by matrix_of(). A batch of rows is one product.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .learning import encode
from .pooling import softmax

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))),
    "gelu": lambda x: x / 2 * (1 + np.vectorize(math.erf)(x / math.sqrt(2))),
    "none": lambda x: x,
}
#: Entries that a table of weights may have.
WEIGHTS = 50_000_000


def matrix_of(entries: DataFrame) -> np.ndarray:
    """A matrix out of its table (row, col, value); entries that are not there are 0."""
    size = entries.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count("*").alias("n")).first()
    if size["n"] > WEIGHTS:
        raise ValueError(f"a matrix of weights has {WEIGHTS} entries at most")
    out = np.zeros((0 if size["r"] is None else size["r"] + 1, 0 if size["c"] is None else size["c"] + 1))
    rows = entries.select("row", "col", F.col("value").cast("double")).toPandas()
    out[rows["row"], rows["col"]] = rows["value"]
    return out


def _stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype("f8")


def _mapped(rows: DataFrame, keep: list[str], vectors: list[str], made: str, run: Callable[..., np.ndarray]) -> DataFrame:
    """rows' columns `keep` and `made`: what run() gives for a batch's vectors, a row each."""
    schema = StructType([*[rows.schema[c] for c in keep], StructField(made, ArrayType(DoubleType()))])

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                found = run(*[_stacked(c) for c in batch.columns[len(keep) :]])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(found), pa.list_(pa.float64()))], [*keep, made])

    given = rows.select(*keep, *[F.col(v).cast("array<double>").alias(f"_{i}") for i, v in enumerate(vectors)])
    return given.where(F.forall(F.array(*[F.col(f"_{i}").isNotNull() for i in range(len(vectors))]), lambda x: x)).mapInArrow(put, schema)


def score_layers(rows: DataFrame, keep: list[str], vector: str, layers: list[tuple[np.ndarray, np.ndarray | None]], activation: str = "relu", last: str = "none", mask: str | None = None, masked_value: float = float("-inf")) -> DataFrame:
    """rows' columns `keep` and `scores`: the vector through layers (weights out x in, bias), the activation between them.

    Rows whose `mask` is true are padding: all their scores are `masked_value`, as a
    pooling by greatest scores or softmax leaves them out then.
    """
    between, after = ACTIVATIONS[activation], ACTIVATIONS[last]

    def run(x):
        for i, (weights, bias) in enumerate(layers):
            x = x @ np.asarray(weights).T + (0 if bias is None else np.asarray(bias))
            x = (after if i + 1 == len(layers) else between)(x)
        return x

    kept = keep if mask is None or mask in keep else [*keep, mask]
    found = _mapped(rows, kept, [vector], "scores", run)
    if mask is None:
        return found
    shown = F.when(F.coalesce(F.col(mask), F.lit(False)), F.transform("scores", lambda s: F.lit(masked_value))).otherwise(F.col("scores"))
    return found.select(*keep, shown.alias("scores"))


def class_attention(tokens: DataFrame, key: str, place: str, vector: str, query: np.ndarray, keys: np.ndarray, heads: int = 1) -> DataFrame:
    """(key, place, head, attention): how much the class token (place 0) of each key attends to each of its other tokens, by head.

    Scores are scaled products of the projected class token and the projected
    tokens; the softmax is over all tokens, the class token too, and its own share
    is then left out, so a head's attention adds up to less than 1. Keys without a
    class token are left out.
    """
    wide = np.asarray(query).shape[0] // heads
    first = _mapped(tokens.where(F.col(place) == 0), [key], [vector], "_query", lambda x: x @ np.asarray(query).T)

    def run(x, q):
        k = x @ np.asarray(keys).T
        return np.einsum("nhw,nhw->nh", k.reshape(len(x), heads, wide), q.reshape(len(x), heads, wide)) / math.sqrt(wide)

    scored = _mapped(tokens.join(first, key), [key, place], [vector, "_query"], "scores", run)
    by_head = scored.select(key, place, F.posexplode("scores").alias("head", "score")).withColumn("_part", F.struct(key, "head"))
    return softmax(by_head, "_part", "score", "attention").where(F.col(place) > 0).select(key, place, "head", "attention")


def attention_lines(attention: DataFrame, key: str, place: str, side: int, scale: int) -> DataFrame:
    """(key, head, row, line): attention (places 1, 2, ... row by row of a grid of `side`) as a map enlarged by a whole factor, each pixel its nearest token's; a row a line, tokens that are missing 0."""
    cells = attention.withColumn("_r", F.floor((F.col(place) - 1) / side).cast("int")).withColumn("_c", ((F.col(place) - 1) % side).cast("int"))
    lines = cells.groupBy(key, "head", "_r").agg(F.map_from_entries(F.collect_list(F.struct("_c", "attention"))).alias("m"))
    line = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda c: F.array_repeat(F.coalesce(F.element_at("m", c), F.lit(0.0)), scale)))
    return lines.select(key, "head", F.explode(F.sequence(F.col("_r") * scale, F.col("_r") * scale + scale - 1)).alias("row"), line.alias("line"))


def two_level(tiles: DataFrame, key: str, region: str, place: str, vector: str, first: str, second: str, cells: int, width: int) -> DataFrame:
    """(key, region, mean, whole, features): each region's tiles through the encoder `first`, whose vectors (of `width`), in the places of a grid of `cells`, go through `second`.

    `mean` is the tiles' mean vector, `whole` the second encoder's, and `features`
    both one behind the other. Places without a tile are zeros, places beyond the
    grid are left out; a region has at most `cells` vectors to hand over.
    """
    named = tiles.where((F.col(place) >= 0) & (F.col(place) < cells)).withColumn("_at", F.struct(key, region, place))
    made = encode(named.select("_at", vector), "_at", vector, first)
    placed = made.groupBy(F.col(f"_at.{key}").alias(key), F.col(f"_at.{region}").alias(region), F.col(f"_at.{place}").alias("_place")).agg(F.first("features").alias("f"))
    grids = placed.groupBy(key, region).agg(F.map_from_entries(F.collect_list(F.struct("_place", "f"))).alias("m"))
    empty = F.array_repeat(F.lit(0.0), width)
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.coalesce(F.element_at("m", i.cast(placed.schema["_place"].dataType)), empty)))
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, f: a + F.get(f, i)) / F.size("m"))
    flat = grids.select(F.struct(key, region, mean.alias("mean")).alias("_at"), grid.alias("grid"))
    whole = encode(flat, "_at", "grid", second)
    return whole.select(f"_at.{key}", f"_at.{region}", "_at.mean", F.col("features").alias("whole"), F.concat("_at.mean", "features").alias("features"))


def pseudo_inverse(square: np.ndarray, rounds: int = 6) -> np.ndarray:
    """An approximate pseudo-inverse of a matrix, by an iteration of third order that needs products alone."""
    one = np.eye(len(square))
    z = square.T / (np.abs(square).sum(0).max() * np.abs(square).sum(1).max())
    for _ in range(rounds):
        az = square @ z
        z = z @ (13 * one - az @ (15 * one - az @ (7 * one - az))) / 4
    return z


def _rows_softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Tiles that are handled with one copy of their slide's landmarks.
CHUNK = 4096


def nystroem_attention(tiles: DataFrame, key: str, order: str, vector: str, landmarks: int, rounds: int = 6) -> DataFrame:
    """(key, order, attended): self-attention of each key's tiles by landmarks, the means of `landmarks` stretches of tiles in their order.

    The product of three softmaxes: tiles to landmarks, the pseudo-inverse of
    landmarks to landmarks, and landmarks to tiles, whose sums over a key's tiles
    are taken in parts and merged. Room is linear in the tiles: a part of CHUNK tiles meets its
    key's landmarks, of which there are few. With as many landmarks as tiles it is
    full attention. Null vectors are left out.
    """
    kind, place = tiles.schema[key].dataType.simpleString(), tiles.schema[order].dataType.simpleString()
    given = tiles.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("x"))
    sizes = given.groupBy("k").agg(F.count("*").alias("n"))
    ranked = given.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("o")) - 1).join(sizes, "k")
    parts = ranked.select("k", "o", "x", F.floor(F.col("i") * F.least(F.col("n"), F.lit(landmarks)) / F.col("n")).cast("int").alias("mark"), F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"))
    means = parts.select("k", "mark", F.posexplode("x").alias("j", "v")).groupBy("k", "mark", "j").agg(F.avg("v").alias("v"))
    vectors = means.groupBy("k", "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda p: p["v"]).alias("v"))
    marks = vectors.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("mark", "v"))), lambda p: p["v"]).alias("marks"))
    chunks = parts.select(F.col("k").alias("of"), F.col("chunk").alias("part")).distinct()
    by_chunk = parts.groupBy("k", "chunk")

    def summed(rows: pa.Table, few: pa.Table) -> pa.Table:
        """Each landmark's greatest score, sum of exponentials and sum of weighted vectors over one part."""
        if not rows.num_rows:
            return pa.table({"k": few["of"].slice(0, 0), "sums": pa.array([], pa.list_(pa.list_(pa.float64())))})
        x, m = _stacked(rows["x"].combine_chunks()), np.array(few["marks"][0].as_py())
        s = m @ x.T / math.sqrt(x.shape[1])
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        return pa.table({"k": few["of"], "sums": pa.array([np.hstack([top, e.sum(1, keepdims=True), e @ x]).tolist()], pa.list_(pa.list_(pa.float64())))})

    partial = by_chunk.cogroup(chunks.join(marks, F.col("of") == F.col("k")).drop("k").groupBy("of", "part")).applyInArrow(lambda a, b: summed(a, b), f"k {kind}, sums array<array<double>>")
    long = partial.select("k", F.posexplode("sums").alias("mark", "s"))
    tops = long.groupBy("k", "mark").agg(F.max(F.col("s")[0]).alias("top"))
    scaled = long.join(tops, ["k", "mark"]).select("k", "mark", F.posexplode(F.transform(F.expr("slice(s, 2, size(s))"), lambda v: v * F.exp(F.col("s")[0] - F.col("top")))).alias("j", "v"))
    merged = scaled.groupBy("k", "mark", "j").agg(F.sum("v").alias("v")).groupBy("k", "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda p: p["v"]).alias("v"))
    seen = merged.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("mark", "v"))), lambda p: p["v"]).alias("seen")).join(marks, "k")

    def attended(rows: pa.Table, few: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"k": rows["k"], "o": rows["o"], "attended": pa.array([], pa.list_(pa.float64()))})
        x, m, s = _stacked(rows["x"].combine_chunks()), np.array(few["marks"][0].as_py()), np.array(few["seen"][0].as_py())
        scale = math.sqrt(x.shape[1])
        middle = pseudo_inverse(_rows_softmax(m @ m.T / scale), rounds) @ (s[:, 1:] / s[:, :1])
        return pa.table({"k": rows["k"], "o": rows["o"], "attended": pa.array(list(_rows_softmax(x @ m.T / scale) @ middle), pa.list_(pa.float64()))})

    found = by_chunk.cogroup(chunks.join(seen, F.col("of") == F.col("k")).drop("k").groupBy("of", "part")).applyInArrow(lambda a, b: attended(a, b), f"k {kind}, o {place}, attended array<double>")
    return found.select(F.col("k").alias(key), F.col("o").alias(order), "attended")
