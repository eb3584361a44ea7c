"""Cohort tables: joins, unions, clean-up, folds and dataset statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tiles import hash_order


def merge_chain(frames: list[DataFrame], on: list[str], how: list[str]) -> DataFrame:
    """Left-deep joins, a key and a kind for each step."""
    if not len(frames) == len(on) + 1 == len(how) + 1:
        raise ValueError("each join needs a key and a kind")
    return reduce(lambda left, step: left.join(step[0], step[1], step[2]), zip(frames[1:], on, how, strict=True), frames[0])


def union_cohorts(frames: list[DataFrame], needed: list[str]) -> DataFrame:
    """All rows of the cohorts that have every needed column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.drop(subset=needed)


def not_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


#: Tables of up to so many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """df with `code`: labels numbered from 0 in their order, null stays null. Codes come from the distinct labels."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("code"))
    return df.join(broadcast_if_small(codes), label, "left")


def map_labels(df: DataFrame, label: str, codes: dict) -> DataFrame:
    """df with the label replaced by its code; a label that has none becomes null."""
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return df.withColumn(label, F.element_at(pairs, F.col(label)))


def hash_ranks(df: DataFrame, item: str, keys: list[str], seed: int = 0, into: str = "rank") -> DataFrame:
    """df with the place, from 0, of each row within its keys in the order of the items' hashes: ranked in buckets of the hashes' first signs, whose totals are carried on."""
    hashed = df.withColumn("_hash", hash_order(item, seed=seed)).withColumn("_bucket", F.substring("_hash", 1, 3))
    n = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = n.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_at"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    ranked = hashed.withColumn("_here", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_hash", item)) - 1)
    joined = ranked.join(before, reduce(lambda x, y: x & y, same, F.col("_bucket") == F.col("_at")))
    return joined.withColumn(into, F.col("_before") + F.col("_here")).drop("_hash", "_bucket", "_here", "_at", "_before", *[f"_{i}" for i in range(len(keys))])


def kfold(df: DataFrame, item: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold`: rows of each stratum dealt in turn, in the order of their hashes."""
    return hash_ranks(df, item, [stratum], seed, "_rank").withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold`: all rows of a group in one fold; groups are dealt by the strata of their sizes, in the order of their hashes."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    return df.join(kfold(sizes, group, "size_class", k, seed).select(group, "fold"), group)


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """df with `fold`: all rows of a group in one fold, folds alike in their labels.

    Groups with the same counts of labels are a stratum and are dealt in turn, in
    the order of their hashes, from a fold that the stratum's hash sets; so each
    such stratum is even within one group, and rare ones do not all begin at fold 0.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    shapes = counts.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(F.col(label).cast("string"), F.lit("?")), F.col("n").cast("string")))), ",").alias("shape"))
    first = F.conv(F.substring(F.sha2("shape", 256), 1, 6), 16, 10).cast("long")
    dealt = hash_ranks(shapes, group, ["shape"], seed, "_rank").select(group, ((F.col("_rank") + first) % k).cast("int").alias("fold"))
    return df.join(dealt, group)


def split_cv(df: DataFrame, item: str, k: int, mode: str = "patient_split", label: str | None = None, patient: str = "patient_id", center: str = "center_id", seed: int = 42) -> DataFrame:
    """df with `fold`: 'random_split' by label, 'patient_split' or 'center_split' with whole groups; rows count alone where there are fewer groups than folds, or no label to stratify by."""
    if mode not in ("random_split", "patient_split", "center_split"):
        raise ValueError(f"unknown split mode {mode}")
    group = {"patient_split": patient, "center_split": center}.get(mode)
    if label is not None and group is not None and df.select(group).distinct().limit(k).count() >= k:
        return stratified_group_kfold(df, group, label, k, seed)
    return kfold(df.withColumn("_one", F.lit(0)), item, label or "_one", k, seed).drop("_one")


def training_portion(df: DataFrame, item: str, share: float, seed: int = 0) -> DataFrame:
    """The first int(share * rows) rows in the order of their hashes."""
    ranked = hash_ranks(df.withColumn("_one", F.lit(0)), item, ["_one"], seed, "_rank")
    return ranked.where(F.col("_rank") < int(share * df.count())).drop("_one", "_rank")


def disjoint(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """The groups that lie in more than one fold; none, if splits are disjoint."""
    return df.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")


def labels_distribution(df: DataFrame, label: str, most: int = 10) -> DataFrame:
    """(label, n): rows of each label; of a label with more than `most` values, those up to 0 (as 0) and above (as 1)."""
    value = F.col(label)
    if df.select(label).distinct().limit(most + 1).count() > most:
        value = F.when(F.col(label).isNotNull(), (F.col(label) > 0).cast("int"))
    return df.groupBy(value.cast("string").alias("label")).agg(F.count("*").alias("n"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the first by an order; what it has besides decides ties."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*").select(*df.columns)


def matched_names(images: DataFrame, masks: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Images with the mask of their name, and how many of either have none: (matched, (images_without, masks_without))."""
    matched = images.join(masks, name)
    lone = lambda a, b: a.join(b.select(name).distinct(), name, "left_anti")
    missing = lone(images, masks).select(F.lit("image").alias("side")).unionByName(lone(masks, images).select(F.lit("mask").alias("side")))
    return matched, missing.agg(F.count_if(F.col("side") == "image").alias("images_without"), F.count_if(F.col("side") == "mask").alias("masks_without"))


def permutations(spark, grid: dict) -> DataFrame:
    """A row for each combination of a grid's lists; dicts within are followed (a.b), scalars are constant."""
    flat: dict[str, list] = {}

    def follow(prefix: str, part: dict) -> None:
        for k, v in part.items():
            if isinstance(v, dict):
                follow(f"{prefix}{k}.", v)
            else:
                flat[f"{prefix}{k}"] = v if isinstance(v, list) else [v]

    follow("", grid)
    one = spark.range(1)
    for name, options in flat.items():
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return one.drop("id")


def experiment_name(params: dict[str, Column]) -> Column:
    """A name for a set of parameters: SHA-256 over them (name=value, sorted by name) in base 64, slashes as 0."""
    line = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), params[k].cast("string")) for k in sorted(params)])
    return F.translate(F.base64(F.unhex(F.sha2(line, 256))), "/", "0")


def dataset_stats(df: DataFrame, slide: str, patient: str, label: str) -> DataFrame:
    return df.agg(F.countDistinct(slide).alias("n_slides"), F.countDistinct(patient).alias("n_patients"), F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_rows"))


def shard_plan(files: DataFrame, size: str, shard_bytes: int) -> DataFrame:
    """How many shards of shard_bytes the files need, and files a shard."""
    n = F.greatest(F.ceil(F.sum(size) / shard_bytes), F.lit(1))
    return files.agg(n.cast("long").alias("n_shards"), F.ceil(F.count("*") / n).cast("long").alias("files_per_shard"), F.count("*").alias("n_files"))
