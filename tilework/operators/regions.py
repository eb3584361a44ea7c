"""Pixels of regions: tiles, masks and thumbnails cut out of decoded images, their features, patches of regions and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import ENCODERS


def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], "u1").reshape(row["height"], row["width"], row["channels"])


def shrunk(image: np.ndarray, factor: int) -> np.ndarray:
    """An image smaller by a whole factor, each pixel read at its centre between its neighbours (bilinear), rounded half up."""
    if factor <= 1:
        return image
    h, w = image.shape[0] // factor, image.shape[1] // factor
    lo, hi = (factor - 1) // 2, factor // 2
    part = lambda a, b: image[a::factor, b::factor][:h, :w].astype("u2")
    return ((part(lo, lo) + part(lo, hi) + part(hi, lo) + part(hi, hi) + 2) // 4).astype("u1")


#: Rows of an image in one strip.
STRIP = 256
_PIECE = pa.schema([("slide_id", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("block_row", pa.int32()), ("block_col", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])


def strips(images: DataFrame, rows: int = STRIP) -> DataFrame:
    """Blocks (slide_id, block_row, block_col, x, y, width, height, channels, data) of whole images (slide_id, width, height, channels, data): strips of so many rows, each image's in its row's task."""
    kind = pa.schema([("slide_id", pa.string()), *[(c, pa.int32()) for c in ("block_row", "block_col", "x", "y", "width", "height", "channels")], ("data", pa.binary())])
    source = images.select(F.col("slide_id").cast("string").alias("slide_id"), *[F.col(c).cast("int").alias(c) for c in ("width", "height", "channels")], "data")

    def put(batches):
        for batch in batches:
            for row in batch.to_pylist():
                step = row["width"] * row["channels"]
                for k, at in enumerate(range(0, row["height"], rows)):
                    n = min(rows, row["height"] - at)
                    yield pa.RecordBatch.from_pylist([{"slide_id": row["slide_id"], "block_row": k, "block_col": 0, "x": at, "y": 0, "width": row["width"], "height": n, "channels": row["channels"], "data": row["data"][at * step : (at + n) * step]}], schema=kind)

    return source.mapInArrow(put, "slide_id string, block_row int, block_col int, x int, y int, width int, height int, channels int, data binary")


def extract_from_blocks(blocks: DataFrame, tiles: DataFrame, tile_dim: int, block: tuple[int, int | None], downsample: int = 1, normalize: Callable[[np.ndarray], np.ndarray] | None = None, then_downsample: int = 1) -> DataFrame:
    """extract_tiles() of images in blocks (slide_id, block_row, block_col, x, y, width, height, channels, data) of a regular grid, `block` being a block's rows and columns (None: as wide as the image).

    A tile names the blocks that it lies in and meets them by an equi-join; of a
    block only what lies in the tile goes on, so no task holds an image. A block
    that is there twice is an error.
    """
    high, wide = block
    extent = tile_dim * downsample
    known = blocks.groupBy("slide_id").agg(F.max("channels").alias("channels"))
    wanted = tiles.select(F.col("slide_id").cast("string").alias("slide_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct().join(known, "slide_id")
    span = lambda c, n: F.sequence(F.floor(F.col(c) / n).cast("int"), F.floor((F.col(c) + extent - 1) / n).cast("int")) if n else F.array(F.lit(0))
    asked = wanted.select("slide_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(span("x", high)).alias("block_row")).select("*", F.explode(span("ty", wide)).alias("block_col"))
    met = asked.join(blocks.select("slide_id", "block_row", "block_col", "x", "y", "width", "height", "channels", "data"), ["slide_id", "block_row", "block_col"])

    def crop(batches):
        for batch in batches:
            for t in batch.to_pylist():
                image = _image(t)
                r0, c0 = max(t["tx"] - t["x"], 0), max(t["ty"] - t["y"], 0)
                part = image[r0 : max(t["tx"] + extent - t["x"], 0), c0 : max(t["ty"] + extent - t["y"], 0)]
                if part.size:
                    yield pa.RecordBatch.from_pylist([{"slide_id": t["slide_id"], "x": t["tx"], "y": t["ty"], "block_row": t["block_row"], "block_col": t["block_col"], "row": t["x"] + r0 - t["tx"], "col": t["y"] + c0 - t["ty"], "height": part.shape[0], "width": part.shape[1], "data": part.tobytes()}], schema=_PIECE)

    pieces = met.mapInArrow(crop, "slide_id string, x int, y int, block_row int, block_col int, row int, col int, height int, width int, data binary")
    whole = pieces.groupBy("slide_id", "x", "y").agg(F.collect_list(F.struct("block_row", "block_col", "row", "col", "height", "width", "data")).alias("pieces"))
    kind = pa.schema([("slide_id", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def put(batches):
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                tile = np.zeros((extent, extent, t["channels"]), "u1")
                pieces = t["pieces"] or []
                if len({(p["block_row"], p["block_col"]) for p in pieces}) < len(pieces):
                    raise ValueError(f"slide {t['slide_id']} has a block twice")
                for p in pieces:
                    tile[p["row"] : p["row"] + p["height"], p["col"] : p["col"] + p["width"]] = np.frombuffer(p["data"], "u1").reshape(p["height"], p["width"], -1)
                tile = shrunk(tile, downsample)
                tile = shrunk(normalize(tile) if normalize else tile, then_downsample)
                out.append({"slide_id": t["slide_id"], "x": t["x"], "y": t["y"], "side": tile.shape[0], "channels": tile.shape[2], "data": tile.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return wanted.join(whole, ["slide_id", "x", "y"], "left").mapInArrow(put, "slide_id string, x int, y int, side int, channels int, data binary")


def extract_tiles(images: DataFrame, tiles: DataFrame, tile_dim: int, downsample: int = 1, normalize: Callable[[np.ndarray], np.ndarray] | None = None, then_downsample: int = 1) -> DataFrame:
    """(slide_id, x, y, side, channels, data): the pixels of tiles (slide_id, x, y; in level-0 pixels) of images (slide_id, width, height, channels, data).

    Images go in strips, see extract_from_blocks. Tiles that overhang are padded
    with 0, a tile asked for twice is there once, tiles of slides without an image
    are left out, and two images of one slide are an error. `downsample` is that of
    the level read, `normalize` maps a tile to a tile of equal shape,
    `then_downsample` shrinks it once more.
    """
    return extract_from_blocks(strips(images), tiles, tile_dim, (STRIP, None), downsample, normalize, then_downsample)


def thumbnails(images: DataFrame, most: int) -> DataFrame:
    """Images (slide_id, width, height, channels, data) shrunk by the least whole factor that brings their longer side to `most` at most."""
    schema = "slide_id string, width int, height int, channels int, data binary"
    rows = images.select(F.col("slide_id").cast("string").alias("slide_id"), *[F.col(c).cast("int").alias(c) for c in ("width", "height", "channels")], "data")

    def put(batches):
        for batch in batches:
            for row in batch.to_pylist():
                small = shrunk(_image(row), -(-max(row["width"], row["height"]) // most))
                yield pa.RecordBatch.from_pylist([{"slide_id": row["slide_id"], "width": small.shape[1], "height": small.shape[0], "channels": small.shape[2], "data": small.tobytes()}], schema=batch.schema)

    return rows.mapInArrow(put, schema)


def extract_masks(mask: DataFrame, tiles: DataFrame, extent: int, side: int) -> DataFrame:
    """(slide_id, x, y, classes): of each tile the class at the centre of each of side x side cells, row by row, 0 where the mask (slide_id, row, col, class_id) has none; tiles name the pixels they ask for, so an equi-join finds them."""
    cell = extent // side
    centres = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    points = tiles.select("slide_id", "x", "y", centres.alias("at")).select("*", (F.col("x") + F.floor(F.col("at") / side) * cell + cell // 2).cast("int").alias("row"), (F.col("y") + F.col("at") % side * cell + cell // 2).cast("int").alias("col"))
    classes = mask.select("slide_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "class_id")
    hits = points.join(classes, ["slide_id", "row", "col"]).groupBy("slide_id", "x", "y", "at").agg(F.max("class_id").alias("c"))
    lists = hits.groupBy("slide_id", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    return tiles.join(lists, ["slide_id", "x", "y"], "left").select("slide_id", "x", "y", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0), side * side)).otherwise(cells).alias("classes"))


def extract_features(images: DataFrame, tiles: DataFrame, tile_dim: int, encoder: str, **options) -> DataFrame:
    """(slide_id, x, y, features): tiles cut out (see extract_tiles) and encoded by name; the encoder gets a matrix with a row of bytes a tile."""
    load = ENCODERS[encoder]

    def add(batches):
        run = load()
        for batch in batches:
            if batch.num_rows:
                made = run(np.stack([np.frombuffer(x, "u1") for x in batch.column("data").to_pylist()]).astype("f8"))
                yield pa.RecordBatch.from_arrays([batch.column("slide_id"), batch.column("x"), batch.column("y"), pa.array(list(made), pa.list_(pa.float64()))], ["slide_id", "x", "y", "features"])

    return extract_tiles(images, tiles, tile_dim, **options).select("slide_id", "x", "y", "data").mapInArrow(add, "slide_id string, x int, y int, features array<double>")


def shrink_pixels(pixels: Column, side: int, factor: int) -> Column:
    """shrunk() of a square tile given as an array of values, row by row, in the JVM."""
    new, lo, hi = side // factor, (factor - 1) // 2, factor // 2
    at = lambda i, a, b: pixels[(F.floor(i / new) * factor + a).cast("int") * side + (i % new) * factor + b]
    return F.transform(F.sequence(F.lit(0), F.lit(new * new - 1)), lambda i: F.floor((at(i, lo, lo) + at(i, lo, hi) + at(i, hi, lo) + at(i, hi, hi) + 2) / 4).cast("int"))


def unfold(regions: DataFrame, pixels: str, side: int, patch: int) -> DataFrame:
    """regions with patch_row, patch_col and the pixels of that patch: a square region's array, row by row, as a grid of square patches."""
    n = side // patch
    at = lambda k, i: ((F.floor(k / n) * patch + F.floor(i / patch)) * side + (k % n) * patch + i % patch + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(patch * patch - 1)), lambda i: F.element_at(F.col(pixels), at(k, i))))
    rest = [c for c in regions.columns if c != pixels]
    return regions.select(*rest, F.posexplode(parts).alias("_k", pixels)).select(*rest, F.floor(F.col("_k") / n).cast("int").alias("patch_row"), (F.col("_k") % n).alias("patch_col"), pixels)


def fold(patches: DataFrame, key: str, pixels: str, side: int, patch: int) -> DataFrame:
    """(key, pixels): regions out of all their patches again; a region that lacks one is left out."""
    n = side // patch
    grouped = patches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("patch_row", "patch_col", F.col(pixels).alias("p")))).alias("all")).where(F.size("all") == n * n)
    at = lambda i: F.element_at(F.col("all"), (F.floor(i / side / patch) * n + F.floor(i % side / patch) + 1).cast("int"))["p"]
    return grouped.select(key, F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.element_at(at(i), (F.floor(i / side) % patch * patch + i % side % patch + 1).cast("int"))).alias(pixels))


def with_margin(pixels: Column, side: int, margin: int, fill: int = 255) -> Column:
    """A square tile's array with a margin of one value all around."""
    wide = side + 2 * margin
    lines = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.concat(F.array_repeat(F.lit(fill), margin), F.slice(pixels, r * side + 1, F.lit(side)), F.array_repeat(F.lit(fill), margin)))
    return F.concat(F.array_repeat(F.lit(fill), margin * wide), F.flatten(lines), F.array_repeat(F.lit(fill), margin * wide))


def side_by_side(left: Column, right: Column, side: int) -> Column:
    """Two square tiles' arrays as one image, the right one beside the left."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.concat(F.slice(left, r * side + 1, F.lit(side)), F.slice(right, r * side + 1, F.lit(side)))))


def colour_map(values: Column, change: Callable[[float], float]) -> Column:
    """Bytes through a table of 256 entries, made of a function on [0, 1]."""
    table = F.array(*[F.lit(int(min(max(change(i / 255), 0.0), 1.0) * 255 + 0.5)) for i in range(256)])
    return F.transform(values, lambda v: F.element_at(table, v.cast("int") + 1))
