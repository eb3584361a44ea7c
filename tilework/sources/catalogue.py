"""What cohorts are made of: paths found by pattern, labels by cohort, and their joins into one table of slides or tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohorts import map_labels, merge_chain, union_cohorts
from .stores import read_msi, read_subtypes, read_survival

#: A cohort's constant label among those it is compared with, cohorts that are unions, centres of each split, and labels a cohort may have.
CANCER_SUBTYPES = {"TCGA_LUAD": 0, "TCGA_LUSC": 1, "TCGA_COAD": 0, "TCGA_READ": 1, "TCGA_KIRC": 0, "TCGA_KIRP": 1, "TCGA_KICH": 2}
UNIONS = {"TCGA_NSCLC": ("TCGA_LUAD", "TCGA_LUSC"), "TCGA_CRC": ("TCGA_COAD", "TCGA_READ"), "TCGA_RCC": ("TCGA_KIRC", "TCGA_KIRP", "TCGA_KICH"), "CAMELYON16_FULL": ("CAMELYON16_TRAIN", "CAMELYON16_TEST"), "NCT-CRC_FULL": ("NCT-CRC_TRAIN", "NCT-CRC_VALID")}
CENTERS = {"TRAIN": (0, 3, 4), "VALID": (1,), "TEST": (2,), "FULL": (0, 1, 2, 3, 4)}
LABELS = ("OS", "PFI", "MSI", "HRD", "CANCER_SUBTYPE", "MOLECULAR_SUBTYPE")


def _read(spark: SparkSession, path: str, missing: str):
    """spark.read of a path that may match no file: then no row."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias(missing)) if found else spark.createDataFrame([], f"{missing} string")


def scan_paths(spark: SparkSession, root: str, pattern: str, into: str, of: str = "file", cut: str = r"\.[^.]*$", item: str = "slide_id") -> DataFrame:
    """(item, into): files below root by a glob pattern; the id is the file's or its folder's name without what `cut` matches. Contents are not read."""
    part = F.element_at(F.split(into, "/"), -1 if of == "file" else -2)
    return _read(spark, f"{root.rstrip('/')}/{pattern}", into).select(F.regexp_replace(part, cut, "").alias(item), into)


def read_hrd(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, label) of a table with patient_id and HRD."""
    return spark.read.csv(path, header=True).select("patient_id", F.col("HRD").cast("double").alias("label"))


def read_camelyon16_labels(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, label), each once: 1 for Tumor; the ids' column has no name."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col(rows.columns[0]).alias("patient_id"), F.coalesce(F.col("target") == "Tumor", F.lit(False)).cast("double").alias("label")).distinct()


def camelyon17_id(patient: Column, node: Column, x: Column, y: Column) -> Column:
    return F.format_string("patch_patient_%03d_node_%d_x_%d_y_%d", patient, node, x, y)


def camelyon17(metadata: DataFrame, split: str, patches: str = "") -> DataFrame:
    """(image_id, image_path, label, center_id) of the patches (patient, node, x_coord, y_coord, tumor, center) of a split's centres."""
    if split not in CENTERS:
        raise ValueError(f"unknown split {split}")
    at = [F.col(c).cast("int") for c in ("patient", "node", "x_coord", "y_coord")]
    name, folder = camelyon17_id(*at), F.format_string("patient_%03d_node_%d", at[0], at[1])
    return metadata.where(F.col("center").isin(*CENTERS[split])).select(name.alias("image_id"), F.concat(F.lit(patches), F.lit("/"), folder, F.lit("/"), name, F.lit(".png")).alias("image_path"), F.col("tumor").cast("int").alias("label"), F.col("center").cast("int").alias("center_id"))


def read_camelyon17(spark: SparkSession, path: str, split: str, patches: str = "") -> DataFrame:
    return camelyon17(spark.read.csv(path, header=True), split, patches)


def read_nct_crc(spark: SparkSession, folder: str, codes: dict[str, int]) -> DataFrame:
    """(image_id, image_path, label, center_id): tiles class/name.tif below a folder; the class' name is replaced by its code."""
    found = scan_paths(spark, folder, "*/*.tif", "image_path", cut=r"\..*$", item="image_id").withColumn("label", F.element_at(F.split("image_path", "/"), -2))
    return map_labels(found, "label", codes).withColumn("center_id", F.lit(None).cast("int"))


def slide_files(spark: SparkSession, coords: str, features: str | None = None, slides: str | None = None, slide_pattern: str = "*/*.svs") -> DataFrame:
    """(slide_id[, slide_path], coords_path, features_path): files of slides, joined by slide, any of them missing or not."""
    frames = [scan_paths(spark, slides, slide_pattern, "slide_path")] if slides else []
    frames.append(scan_paths(spark, coords, "*/coords.npy", "coords_path", of="folder"))
    if features:
        frames.append(scan_paths(spark, features, "*/features.npy", "features_path", of="folder"))
    found = merge_chain(frames, ["slide_id"] * (len(frames) - 1), ["full_outer"] * (len(frames) - 1))
    return found if features else found.withColumn("features_path", F.lit(None).cast("string"))


def cohort_labels(spark: SparkSession, cohort: str, label: str, path: str) -> DataFrame:
    """(patient_id, label) of a cohort's task from its own table."""
    if label not in LABELS:
        raise ValueError(f"unknown label {label}")
    if label in ("OS", "PFI"):
        return read_survival(spark, path).select("patient_id", F.col(label.lower()).alias("label"))
    if label == "MSI":
        return read_msi(spark, path)
    if label == "HRD":
        return read_hrd(spark, path)
    if label == "CANCER_SUBTYPE":
        return read_survival(spark, path).select("patient_id", F.lit(float(CANCER_SUBTYPES[cohort])).alias("label"))
    return read_subtypes(spark, path).select("patient_id", F.col("subtype").alias("label"))


def load_dataset(spark: SparkSession, cohort: str, known: dict[str, dict[str, str]], label: str | None = None, with_slides: bool = True) -> DataFrame:
    """A cohort's slides with files and labels, or a union of cohorts; rows without coordinates or a label (or a slide, if wanted) are dropped.

    known: cohort -> paths (coords, features, slides, and one for each label). A
    cohort that is neither known nor a union of known ones is an error.
    """
    names = UNIONS.get(cohort, (cohort,))
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown cohorts {missing}")
    frames = []
    for name in names:
        paths = known[name]
        files = slide_files(spark, paths["coords"], paths.get("features"), paths.get("slides") if with_slides else None, "*.tif" if name.startswith("CAMELYON16") else "*/*.svs")
        if name.startswith("CAMELYON16"):
            labels, files = read_camelyon16_labels(spark, paths["labels"]), files.withColumn("patient_id", F.col("slide_id"))
        else:
            if label is None or label not in paths:
                raise ValueError(f"{name} has no label {label}")
            labels, files = cohort_labels(spark, name, label, paths[label]), files.withColumn("patient_id", F.substring("slide_id", 1, 12))
        frames.append(files.join(labels, "patient_id", "right").withColumn("cohort", F.lit(name)))
    return union_cohorts(frames, ["coords_path", "label", *["slide_path"] * with_slides])


def slide_dataset(slides: DataFrame, features: DataFrame, n_tiles: int, seed: int | None = None) -> DataFrame:
    """(slide_id, patient_id, label, features): of each slide with a label the first n_tiles tiles' vectors (by tile_no, or in a seeded order), as an array; slides without features are left out."""
    from ..operators.tiles import first_per_group, sample_per_group

    few = first_per_group(features, "slide_id", "tile_no", n_tiles) if seed is None else sample_per_group(features, "slide_id", ["tile_no"], n_tiles, seed)
    lists = few.groupBy("slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile_no", "embedding"))), lambda t: t["embedding"]).alias("features"))
    return slides.join(lists, "slide_id").select("slide_id", "patient_id", "label", "features")


def completed(experiments: DataFrame, status: str = "status") -> DataFrame:
    """Experiments whose status says that they ended."""
    return experiments.where(F.coalesce(F.col(status)["completed"], F.lit(False)))


def write_results(results: DataFrame, path: str) -> None:
    """A folder of CSV files with a header."""
    results.write.mode("overwrite").csv(path, header=True)
