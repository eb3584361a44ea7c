"""Stores of tiles and features, and readers of what cohorts are described by; every store is a folder of Parquet or files."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_key(x: Column, y: Column) -> Column:
    return F.concat_ws("_", y, x)


def write_kv(tiles: DataFrame, path: str, mode: str = "append", per_file: int = 0) -> None:
    """Entries (key, shape, dtype, data) of a key-value store; per_file bounds the entries of a file."""
    tiles.select("key", "shape", "dtype", "data").write.mode(mode).option("maxRecordsPerFile", per_file).parquet(path)


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, shape array<int>, dtype string, data binary").parquet(path)


def upsert_kv(spark: SparkSession, tiles: DataFrame, path: str, target: str) -> None:
    """Writes to `target` the store at `path` with these entries in the place of those of the same key; an entry given twice keeps its greatest data."""
    new = tiles.groupBy("key").agg(F.max(F.struct("data", "shape", "dtype")).alias("r")).select("key", "r.shape", "r.dtype", "r.data")
    kept = read_kv(spark, path).join(new.select("key"), "key", "left_anti")
    kept.unionByName(new).write.mode("overwrite").parquet(target)


def tile_metadata(tiles: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """(y, x, path) of tiles saved as folder_y_x.png; written as CSV with a header if there is a path."""
    rows = tiles.select("y", "x", F.concat(F.lit(folder), F.lit("_"), F.concat_ws("_", "y", "x"), F.lit(".png")).alias("path"))
    if path:
        rows.write.mode("overwrite").csv(path, header=True)
    return rows


def get(store: DataFrame, key: str) -> DataFrame:
    """The entry of a key; no row if it is missing. The filter reaches the files' statistics."""
    return store.where(F.col("key") == key)


def write_features(features: DataFrame, path: str, slide: str = "slide_id") -> DataFrame:
    """Appends the slides that the store does not hold yet and returns them; a run that was cut off continues."""
    spark, todo = features.sparkSession, features
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        done = spark.read.parquet(path).select(F.col(slide).cast(features.schema[slide].dataType)).distinct()
        todo = features.join(done, slide, "left_anti")
    slides = todo.select(slide).distinct().checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else todo.select(slide).distinct().persist()
    slides.count()
    todo.write.mode("append").parquet(path)
    return slides


def write_shards(tiles: DataFrame, path: str, n_shards: int, split: Column | None = None) -> None:
    """Parquet shards, by split if given; rows go to shards by the hash of all their keys, so no split or slide makes a shard large."""
    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
    rows = tiles.withColumn("shard", shard).withColumn("split", F.lit("all") if split is None else split)
    rows.repartition(n_shards, "split", "shard").write.mode("overwrite").partitionBy("split", "shard").parquet(path)


def split_of(path: Column, valid: list[str], test: list[str]) -> Column:
    """'test' or 'valid' where the path holds a name of the list (valid first), else 'train'."""
    holds = lambda names: F.exists(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), lambda n: F.contains(path, n))
    return F.when(holds(valid), "valid").when(holds(test), "test").otherwise("train")


def save_annotations(vertices: DataFrame, path: str) -> None:
    vertices.select(F.col("label").alias("labels"), "x", "y").write.mode("overwrite").csv(path, header=True)


def png(data: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """Rows of RGB or grey bytes as a PNG."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    step = width * channels
    lines = b"".join(b"\0" + data[i * step : (i + 1) * step] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_pngs(tiles: DataFrame, folder: str) -> DataFrame:
    """Writes tiles (slide_id, x, y, width, height, data as RGB) to folder/slide/y_x.png; (slide_id, y, x, path), lazily, a file each row.

    A folder without a scheme lies on Spark's default file system.
    """
    spark = tiles.sparkSession
    named = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()

    def put(batches):
        from pyarrow import fs

        files, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for t in batch.to_pylist():
                files.create_dir(f"{root}/{t['slide_id']}", recursive=True)
                paths.append(f"{root}/{t['slide_id']}/{t['y']}_{t['x']}.png")
                with files.open_output_stream(paths[-1]) as out:
                    out.write(png(t["data"], t["width"], t["height"]))
            yield pa.RecordBatch.from_arrays([batch.column("slide_id"), batch.column("y"), batch.column("x"), pa.array(paths, pa.string())], ["slide_id", "y", "x", "path"])

    rows = tiles.select(F.col("slide_id").cast("string").alias("slide_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "data")
    return rows.mapInArrow(put, "slide_id string, y int, x int, path string")


def list_patches(spark: SparkSession, folder: str) -> DataFrame:
    """(path, slide_id, x, y) of files slide/y_x.png below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.png").option("recursiveFileLookup", "true").load(folder).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(?:[^/]*_)?(\d+)_(\d+)\.png$", i)
    return files.select("path", part(1).alias("slide_id"), part(3).cast("int").alias("x"), part(2).cast("int").alias("y"))


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data): decoded images, bytes in the order blue, green, red."""
    i = F.col("image")
    return spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select(i["origin"].alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def read_msi(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, label): 1 for MSI-H; indeterminate ones are left out, a missing label stays null."""
    rows = spark.read.csv(path, schema="patient_id string, label string").where(~F.col("label").eqNullSafe("Indeterminate"))
    return rows.select("patient_id", (F.col("label") == "MSI-H").cast("double").alias("label"))


def read_clinical(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, center, age, gender, ethnicity, stage, grade, os, pfi): times are negative where censored; columns that the file lacks are null."""
    rows = spark.read.csv(path, header=True, nullValue="[Not Available]")
    signed = lambda event: F.when(F.col(event).cast("double") == 1, F.col(f"`{event}.time`").cast("double")).otherwise(-F.col(f"`{event}.time`").cast("double"))
    described = {"age": "age_at_initial_pathologic_diagnosis", "gender": "gender", "ethnicity": "race", "stage": "ajcc_pathologic_tumor_stage", "grade": "histological_grade"}
    more = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(name) for name, c in described.items()]
    return rows.select(F.col("bcr_patient_barcode").alias("patient_id"), F.split("bcr_patient_barcode", "-")[1].alias("center"), *more, signed("OS").alias("os"), signed("PFI").alias("pfi"))


def read_survival(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, center, os, pfi) of the clinical table."""
    return read_clinical(spark, path).select("patient_id", "center", "os", "pfi")


def read_subtypes(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, cohort, subtype), each once; tab-separated, compressed or not."""
    rows = spark.read.csv(path, header=True, sep="\t")
    return rows.select(F.col("Patient ID").alias("patient_id"), F.col("TCGA PanCanAtlas Cancer Type Acronym").alias("cohort"), F.col("Subtype").alias("subtype")).distinct()
