"""Feature matrices in NumPy's file format, a file a slide, as a data source that plans ranges of rows: the first n rows of a file cost n rows' bytes."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tiled_images import files_of

MAGIC = b"\x93NUMPY"
ROWS_A_PARTITION = 20_000


def header_of(file) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the rows begin) of an open file; rows must lie one behind another."""
    head = file.read(10)
    if head[:6] != MAGIC:
        raise ValueError("not an array file")
    wide = head[6] >= 2
    n = struct.unpack("<I", head[8:10] + file.read(2))[0] if wide else struct.unpack("<H", head[8:10])[0]
    found = ast.literal_eval(file.read(n).decode("utf-8" if head[6] >= 3 else "latin1"))
    kind = np.dtype(found["descr"])
    if found["fortran_order"] and len(found["shape"]) > 1 or kind.hasobject or not 1 <= len(found["shape"]) <= 2:
        raise ValueError("only matrices and vectors of numbers, row by row, are read")
    return kind, found["shape"], (12 if wide else 10) + n


def array_header(kind: str, shape: tuple[int, ...]) -> bytes:
    text = repr({"descr": kind, "fortran_order": False, "shape": shape}).encode()
    room = -(-(len(text) + 11) // 64) * 64 - 10
    return MAGIC + b"\x01\x00" + struct.pack("<H", room) + text.ljust(room - 1) + b"\n"


class RowRange(InputPartition):
    def __init__(self, path: str, slide: str, first: int, last: int):
        super().__init__(None)
        self.path, self.slide, self.first, self.last = path, slide, first, last


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = files_of(self.options["path"])
        name, most = self.options.get("name", "features.npy"), self.options.get("rows")
        step = int(self.options.get("rowsperpartition", self.options.get("rowsPerPartition", ROWS_A_PARTITION)))
        if files.get_file_info(root).type == fs.FileType.Directory:
            paths = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith("/" + name))
        else:
            paths = [root]
        scheme, out = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else "", []
        for path in paths:
            with files.open_input_file(path) as f:
                n = header_of(f)[1][0]
            n = n if most is None else min(n, int(most))
            out += [RowRange(scheme + path, path.split("/")[-2], at, min(at + step, n)) for at in range(0, n, step)]
        return out or [RowRange("", "", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, path = files_of(partition.path)
        with files.open_input_file(path) as f:
            kind, shape, start = header_of(f)
            width = shape[1] if len(shape) == 2 else 1
            f.seek(start + partition.first * width * kind.itemsize)
            for at in range(partition.first, partition.last, 1000):
                n = min(1000, partition.last - at)
                data = f.read(n * width * kind.itemsize)
                if len(data) < n * width * kind.itemsize:
                    raise ValueError(f"{path} is cut off")
                values = np.frombuffer(data, kind).astype("f8")
                offsets = pa.array(np.arange(0, (n + 1) * width, width) if width else np.zeros(n + 1, int), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([partition.slide] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(offsets, pa.array(values))], ["slide_id", "row", "values"])


class ArrayRows(DataSource):
    """spark.read.format("array_rows").load(path): (slide_id, row, values) of the files called `name` ("features.npy") below the path; slide_id is the folder's name. Options: name, rows (of each file the first so many), rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "slide_id string, row bigint, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(dict(self.options))


def read_arrays(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArrayRows)
    return spark.read.format("array_rows").options(**{k: str(v) for k, v in options.items()}).load(path)


def preload(spark: SparkSession, path: str, n_tiles: int | None = 1000) -> DataFrame:
    """(slide_id, row, level, x, y, features) of each slide's first n_tiles tiles (all for None): the first three columns of features.npy are a tile's address."""
    rows = read_arrays(spark, path, **({} if n_tiles is None else {"rows": n_tiles}))
    at = lambda i: F.get("values", F.lit(i)).cast("int")
    return rows.select("slide_id", "row", at(0).alias("level"), at(1).alias("x"), at(2).alias("y"), F.expr("slice(values, 4, greatest(size(values) - 3, 0))").alias("features"))


def with_coordinates(features: DataFrame, coords: DataFrame) -> DataFrame:
    """Rows of two files of one slide side by side: (slide_id, row, values, coords)."""
    return features.join(coords.select("slide_id", "row", F.col("values").alias("coords")), ["slide_id", "row"])


def write_arrays(rows: DataFrame, path: str, slide: str, order: str, values: str, name: str = "features.npy") -> DataFrame:
    """Writes path/slide/name for each slide, its rows in order; (slide_id, n), lazily.

    Rows stream through their task, one slide behind another; a slide's rows are
    counted first, since the count stands in the file's head. A file appears under
    its name when it is whole.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    source = rows.select(F.col(slide).cast("string").alias("slide_id"), F.col(order).alias("_order"), F.col(values).cast("array<double>").alias("_values"))
    counted = source.withColumn("_n", F.count("*").over(Window.partitionBy("slide_id")))

    def put(batches):
        import uuid

        files, root = files_of(folder)
        now, out, draft, n = None, None, "", 0
        done: list[tuple[str, int]] = []

        def close():
            out.close()
            files.move(draft, f"{root}/{now}/{name}")
            done.append((now, n))

        for batch in batches:
            for key, count, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if out:
                        close()
                    now, n = key, count
                    files.create_dir(f"{root}/{key}", recursive=True)
                    draft = f"{root}/{key}/.{name}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft)
                    out.write(array_header("<f8", (count, len(vector))))
                out.write(np.array(vector, "<f8").tobytes())
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["slide_id", "n"])

    return counted.repartition("slide_id").sortWithinPartitions("slide_id", "_order").select("slide_id", "_n", "_values").mapInArrow(put, "slide_id string, n long")
