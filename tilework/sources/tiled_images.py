"""Tiled image pyramids (plain TIFF and BigTIFF, 8 bits a sample) as a Spark data source: a partition reads a range of one level's tiles, so no task holds an image."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the TIFF format: tags, bytes of each field type, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 277, 284, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

#: Tiles that a partition reads, unless the option tilesPerPartition says otherwise.
TILES_A_PARTITION = 256
COLUMNS = "slide_id string, level int, downsample double, level_width int, level_height int, block_row int, block_col int, x int, y int, width int, height int, channels int"


def files_of(path: str):
    """pyarrow's file system and path of a URI or local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Level:
    """One directory of a TIFF: its numbers; lists (tile offsets and sizes) are read in parts."""

    def __init__(self, file, order: str, big: bool, at: int):
        self.file, self.order, self.entries = file, order, {}
        count, size, head = ("Q", 20, 8) if big else ("H", 12, 2)
        n = struct.unpack(order + count, self._bytes(at, head))[0]
        body = self._bytes(at + head, n * size + (8 if big else 4))
        for i in range(n):
            tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), body, i * size)
            room = 8 if big else 4
            held = body[i * size + size - room : i * size + size]
            inside = TYPE_BYTES.get(kind, 1) * many <= room
            where = at + head + i * size + size - room if inside else struct.unpack(order + ("Q" if big else "I"), held)[0]
            self.entries[tag] = (kind, many, where)
        self.next = struct.unpack(order + ("Q" if big else "I"), body[n * size :])[0]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the image file is cut off")
        return data

    def values(self, tag: int, first: int = 0, last: int | None = None, default: int | None = None) -> list[int]:
        """The numbers of a tag from `first` up to `last`; no others are read."""
        if tag not in self.entries:
            return [] if default is None else [default]
        kind, many, where = self.entries[tag]
        last = many if last is None else min(last, many)
        data = self._bytes(where + first * TYPE_BYTES[kind], (last - first) * TYPE_BYTES[kind])
        return list(struct.unpack(f"{self.order}{last - first}{TYPE_CODES[kind]}", data))

    def one(self, tag: int, default: int | None = None) -> int:
        return self.values(tag, 0, 1, default)[0]

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of tiles."""
        return -(-self.one(HEIGHT) // self.one(TILE_HEIGHT)), -(-self.one(WIDTH) // self.one(TILE_WIDTH))


def levels_of(file) -> list[Level]:
    """The tiled directories of a TIFF, in the file's order: level 0 and the smaller ones."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    at, out = struct.unpack_from(f"{order}Q", head, 8)[0] if version == 43 else struct.unpack_from(f"{order}I", head, 4)[0], []
    while at:
        level = Level(file, order, version == 43, at)
        if TILE_OFFSETS in level.entries:
            out.append(level)
        at = level.next
    return out


def decoded(level: Level, data: bytes) -> np.ndarray:
    """A tile's pixels (height x width x channels)."""
    how = level.one(COMPRESSION, PLAIN)
    if how not in (PLAIN, DEFLATE, OLD_DEFLATE) or set(level.values(BITS, default=8)) != {8} or level.one(PLANAR, 1) != 1:
        raise ValueError("only plain or deflated tiles of interleaved 8-bit samples are read")
    raw = data if how == PLAIN else zlib.decompress(data)
    return np.frombuffer(raw, "u1").reshape(level.one(TILE_HEIGHT), level.one(TILE_WIDTH), level.one(SAMPLES, 1))


class TileRange(InputPartition):
    def __init__(self, path: str, level: int, first: int, last: int):
        super().__init__(None)
        self.path, self.level, self.first, self.last = path, level, first, last


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.pad = options.get("pad", "false").lower() == "true"

    def _paths(self) -> list[str]:
        from pyarrow import fs

        files, path = files_of(self.options["path"])
        if files.get_file_info(path).type != fs.FileType.Directory:
            return [self.options["path"]]
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
        return sorted(f"{scheme}{f.path}" for f in found if f.path.lower().endswith((".tif", ".tiff", ".svs")))

    def partitions(self) -> list[InputPartition]:
        """Ranges of tiles; the driver reads files' directories, not their lists of tiles."""
        wanted = self.options.get("levels")
        wanted = None if wanted is None else {int(x) for x in str(wanted).split(",")}
        size, out = int(self.options.get("tilesperpartition", self.options.get("tilesPerPartition", TILES_A_PARTITION))), []
        for path in self._paths():
            files, name = files_of(path)
            with files.open_input_file(name) as f:
                for k, level in enumerate(levels_of(f)):
                    if wanted is None or k in wanted:
                        rows, cols = level.grid
                        out += [TileRange(path, k, at, min(at + size, rows * cols)) for at in range(0, rows * cols, size)]
        return out or [TileRange("", 0, 0, 0)]

    def read(self, partition: TileRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, name = files_of(partition.path)
        slide = os.path.splitext(os.path.basename(name))[0]
        with files.open_input_file(name) as f:
            levels = levels_of(f)
            level = levels[partition.level]
            wide, high, tw, th = level.one(WIDTH), level.one(HEIGHT), level.one(TILE_WIDTH), level.one(TILE_HEIGHT)
            cols, scale, channels = level.grid[1], levels[0].one(WIDTH) / wide, level.one(SAMPLES, 1)
            offsets = level.values(TILE_OFFSETS, partition.first, partition.last) if self.pixels else [0] * (partition.last - partition.first)
            sizes = level.values(TILE_BYTES, partition.first, partition.last) if self.pixels else offsets
            rows: list[tuple] = []
            for i, (at, n) in enumerate(zip(offsets, sizes, strict=True), partition.first):
                r, c = divmod(i, cols)
                h, w = (th, tw) if self.pad else (min(th, high - r * th), min(tw, wide - c * tw))
                row = (slide, partition.level, scale, wide, high, r, c, r * th, c * tw, w, h, channels)
                if self.pixels:
                    tile = decoded(level, level._bytes(at, n)) if n else np.zeros((th, tw, channels), "u1")
                    if self.pad:
                        tile = tile.copy()
                        tile[max(0, high - r * th) :], tile[:, max(0, wide - c * tw) :] = 0, 0
                    row += (np.ascontiguousarray(tile[:h, :w]).tobytes(),)
                rows.append(row)
                if len(rows) == 16 or i + 1 == partition.last:
                    yield self._batch(rows)
                    rows = []

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 9] + [pa.binary()] * self.pixels
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["data"] * self.pixels
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class TiledImages(DataSource):
    """spark.read.format("tiled_image").load(path): a row a tile of every level of every image below the path.

    slide_id is the file's name; x is the tile's first row and y its first column in
    its level's pixels. Options: levels ("0,2"), tilesPerPartition, pad ("true":
    tiles at the border have their full size, 0 beyond the image) and pixels
    ("false": without `data`, no tile is read).
    """

    @classmethod
    def name(cls) -> str:
        return "tiled_image"

    def schema(self) -> str:
        return COLUMNS + (", data binary" if self.options.get("pixels", "true").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return TileReader(dict(self.options))


def read_slides(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tiles of the slides below a path, see TiledImages."""
    spark.dataSource.register(TiledImages)
    return spark.read.format("tiled_image").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def slide_levels(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, level, width, height, downsample, tiles) of every level, from the files' directories alone."""
    from pyspark.sql import functions as F

    return read_slides(spark, path, pixels=False).groupBy("slide_id", "level", F.col("level_width").alias("width"), F.col("level_height").alias("height"), "downsample").agg(F.count("*").alias("tiles"))


def encode_pyramid(levels: list[np.ndarray], tile: int, deflate: bool = True, big: bool = False) -> bytes:
    """Images (height x width x channels, bytes), largest first, as one tiled TIFF."""
    size, wide = ("Q", 8) if big else ("I", 4)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    link = len(out) - wide  # where the next directory's place is to be written
    for image in levels:
        h, w, channels = image.shape
        places, sizes = [], []
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                block = np.zeros((tile, tile, channels), "u1")
                part = image[r : r + tile, c : c + tile]
                block[: part.shape[0], : part.shape[1]] = part
                data = zlib.compress(block.tobytes()) if deflate else block.tobytes()
                places.append(len(out))
                sizes.append(len(data))
                out += data
        fields = {WIDTH: [w], HEIGHT: [h], BITS: [8] * channels, COMPRESSION: [DEFLATE if deflate else PLAIN], PHOTOMETRIC: [2 if channels == 3 else 1], SAMPLES: [channels], PLANAR: [1], TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: places, TILE_BYTES: sizes}
        held = {}
        for tag, values in fields.items():
            data = struct.pack(f"<{len(values)}{size}", *values)
            if len(data) > wide:
                held[tag] = struct.pack("<" + size, len(out))
                out += data
            else:
                held[tag] = data
        out[link : link + wide] = struct.pack("<" + size, len(out))
        out += struct.pack("<Q" if big else "<H", len(fields))
        for tag in sorted(fields):
            out += struct.pack("<HH" + size, tag, 16 if big else 4, len(fields[tag])) + held[tag]
        link = len(out)
        out += bytes(wide)
    return bytes(out)
