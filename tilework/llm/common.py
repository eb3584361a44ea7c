"""What the operators share: column hygiene, the shared folder, lookups that survive hot keys, and file access in tasks."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A key is hot if it holds more than one in this many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: An Arrow batch of whole texts ends at the row that brings it to so many bytes (Spark's default is 64 MB, which a task holds on both sides of the pipe).
BATCH_BYTES = 4 << 20


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The column as a string, a null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """df and `h`, the key's hash: at most n rows, those of the least hashes.

    Rows are first filtered by a bound that about 4 * n of them lie under, so that
    the task which orders them gets no more of a larger table.
    """
    total, hashed = df.count(), df.withColumn("h", key)
    if total > 4 * n:
        hashed = hashed.where(F.col("h") <= int(-(2**63) + 2**64 * (4 * n / total)))
    return hashed.orderBy("h").limit(n)


def schema_with(df: DataFrame, **added: str) -> StructType:
    """df's schema and the columns added, given as name=type; df's own stays as it is."""
    more = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in added.items()))
    return StructType([*df.schema.fields, *more.fields])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session gives Python batches of BATCH_BYTES, or fewer where it was set so. Rows stay as they are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one set here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        found = tempfile.mkdtemp(prefix="tilework-")
        sc.setCheckpointDir(found)
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of its file system: Spark's default one, where none is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the application ends."""
    path = qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, a_task: int = 100_000) -> DataFrame:
    """df in no more partitions than so many rows need, eight at least: a small table is not written as hundreds of files; a larger one keeps all its tasks."""
    return df.coalesce(max(8, math.ceil(rows / a_task)))


def lookup(left: DataFrame, table: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Left join with a table that has one row a key and in `weight` its number of left rows; the weight is dropped.

    Keys with more than one in HOT_SHARE of those rows (so at most HOT_SHARE
    keys) are broadcast; their left rows are dealt by a salt, all others by key.
    `total`: the number of left rows, where it is known; else the weights are summed.
    """
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in table.columns if c not in (key, weight)]
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = table.where(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = table.where(~is_hot).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*values).alias("_cold"))
    rows = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c != key] or [F.lit(0)]), F.lit(99_991)).cast("int") + 1).otherwise(0)
    joined = rows.withColumn("_salt", salt).join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])


def file_system(uri: str):
    """pyarrow's file system and path for a folder named by a URI (see `qualified`), or by a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def lookup_wide(left: DataFrame, table: DataFrame, key: str, salt_by: str, counted: DataFrame | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """Inner join with a table that has one row a key, where its values can be long: no value is broadcast.

    A key with more than one in hot_share of the left rows is repeated, once for
    each such part of the rows, and its rows meet one of the copies by the hash of
    `salt_by`. Rows a key are counted in `counted`, where that is simpler than
    left and has as many. Broadcast are those keys and their numbers of copies, fewer than
    hot_share rows; copies are fewer than twice hot_share in all.
    """
    counted = left if counted is None else counted
    counts, total = counted.groupBy(key).agg(F.count("*").alias("_n")), counted.count()
    hot = counts.where(F.col("_n") * hot_share > total).select(F.col(key).alias("_hot_key"), F.ceil(F.col("_n") * hot_share / total).cast("int").alias("_copies"))

    def copies(df: DataFrame, on: str) -> DataFrame:
        return df.join(F.broadcast(hot), F.col(on) == F.col("_hot_key"), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))

    values = [c for c in table.columns if c != key]
    asked = copies(left, key).select(*left.columns, F.pmod(F.xxhash64(salt_by), F.col("_copies")).cast("int").alias("_salt"))
    given = copies(table, key).select(F.col(key).alias("_key"), *values, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    return asked.join(given, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_copy"))).select(*left.columns, *values)


@contextlib.contextmanager
def new_file(folder: str, name: str):
    """Writes folder/name under another name first, so that a lost or repeated attempt leaves no half file."""
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        yield out
    files.move(draft, f"{path}/{name}")
