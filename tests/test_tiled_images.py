"""Tiled TIFF pyramids read back through the data source, and regions cut out of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import regions, tiles
from tilework.sources import tiled_images

RNG = np.random.default_rng(12)


@pytest.fixture(scope="module")
def slides(tmp_path_factory):
    folder = tmp_path_factory.mktemp("slides")
    found = {}
    for name, shape, tile, deflate, big in (("a", (70, 101, 3), 16, True, False), ("b", (33, 64, 1), 32, False, True), ("c", (5, 5, 3), 16, True, True)):
        image = RNG.integers(0, 256, shape).astype("u1")
        levels = [image, regions.shrunk(image, 2)] if min(shape[:2]) > 30 else [image]
        (folder / f"{name}.tif").write_bytes(tiled_images.encode_pyramid(levels, tile, deflate, big))
        found[name] = (levels, tile)
    (folder / "notes.txt").write_text("no image")
    return str(folder), found


def test_every_tile_of_every_level(spark, slides):
    folder, want = slides
    rows = tiled_images.read_slides(spark, folder, tilesPerPartition=7).collect()
    for name, (levels, tile) in want.items():
        for k, image in enumerate(levels):
            mine = [r for r in rows if r.slide_id == name and r.level == k]
            back = np.zeros_like(image)
            for r in mine:
                assert (r.x, r.y) == (r.block_row * tile, r.block_col * tile) and (r.level_height, r.level_width, r.channels) == image.shape
                back[r.x : r.x + r.height, r.y : r.y + r.width] = np.frombuffer(bytes(r.data), "u1").reshape(r.height, r.width, r.channels)
            assert (back == image).all() and len(mine) == -(-image.shape[0] // tile) * -(-image.shape[1] // tile)
    padded = tiled_images.read_slides(spark, f"{folder}/a.tif", pad=True, levels="1").where("block_row = 2 and block_col = 3").first()
    part = want["a"][0][1][32:, 48:]
    full = np.zeros((16, 16, 3), "u1")
    full[: part.shape[0], : part.shape[1]] = part
    assert (padded.height, padded.width) == (16, 16) and bytes(padded.data) == full.tobytes()


def test_ranges_and_levels(spark, slides):
    folder, _ = slides
    frame = tiled_images.read_slides(spark, f"{folder}/a.tif", levels="0", tilesPerPartition=7)
    assert frame.rdd.getNumPartitions() == 5  # 5 x 7 tiles
    assert sorted((r.slide_id, r.level, r.width, r.height, r.tiles) for r in tiled_images.slide_levels(spark, folder).collect()) == [("a", 0, 101, 70, 35), ("a", 1, 50, 35, 12), ("b", 0, 64, 33, 4), ("b", 1, 32, 16, 1), ("c", 0, 5, 5, 1)]


def test_no_tile_is_read_without_pixels(spark, slides, tmp_path):
    folder, _ = slides
    data = bytearray(open(f"{folder}/a.tif", "rb").read())
    with open(f"{folder}/a.tif", "rb") as f:
        level = tiled_images.levels_of(f)[0]
        at = level.values(tiled_images.TILE_OFFSETS)[0]
    data[at : at + 4] = b"\xff" * 4  # a tile that cannot be decoded
    (tmp_path / "torn.tif").write_bytes(bytes(data))
    assert tiled_images.read_slides(spark, f"{tmp_path}/torn.tif", pixels=False).count() == 47
    with pytest.raises(Exception, match="error|incorrect|invalid"):
        tiled_images.read_slides(spark, f"{tmp_path}/torn.tif").collect()


def test_regions_out_of_blocks(spark, slides):
    folder, want = slides
    image, tile = want["a"][0][0], want["a"][1]
    blocks = tiled_images.read_slides(spark, f"{folder}/a.tif", levels="0")
    grid = tiles.tile_grid(spark.createDataFrame([("a", 101, 70), ("z", 50, 50)], "slide_id string, width int, height int"), 24)
    asked = grid.unionByName(spark.createDataFrame([("a", -5, -7), ("a", 500, 500)], grid.schema)).unionByName(grid.limit(1))
    made = regions.extract_from_blocks(blocks, asked, 24, (tile, tile)).collect()
    assert len(made) == 3 * 5 + 2
    wide = np.zeros((600, 600, 3), "u1")
    wide[10:80, 10:111] = image
    for r in made:
        part = wide[r.x + 10 : r.x + 34, r.y + 10 : r.y + 34]
        assert (np.frombuffer(bytes(r.data), "u1").reshape(24, 24, 3)[: part.shape[0], : part.shape[1]] == part).all()


def test_an_image_twice_is_refused(spark):
    image = spark.createDataFrame([("s", 4, 4, 1, bytearray(16)), ("s", 4, 4, 1, bytearray(16))], "slide_id string, width int, height int, channels int, data binary")
    grid = spark.createDataFrame([("s", 0, 0)], "slide_id string, x int, y int")
    with pytest.raises(Exception, match="twice"):
        regions.extract_tiles(image, grid, 4).collect()


def test_masks_meet_tiles_without_ranges(spark):
    mask = spark.createDataFrame([("s", r, c, (r + c) % 3) for r in range(20) for c in range(20)], "slide_id string, row int, col int, class_id int")
    grid = spark.createDataFrame([("s", 0, 0), ("s", 8, 4), ("s", 16, 16), ("t", 0, 0)], "slide_id string, x int, y int")
    found = regions.extract_masks(mask, grid, 8, 4)
    for r in found.collect():
        want = [(a + b) % 3 if r.slide_id == "s" and a < 20 and b < 20 else 0 for i in range(4) for j in range(4) for a, b in [(r.x + 2 * i + 1, r.y + 2 * j + 1)]]
        assert r.classes == want
    plan = found._jdf.queryExecution().toString()
    assert "row#" in plan and F is not None and "NestedLoop" not in plan
