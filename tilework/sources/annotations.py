"""Readers of annotation files; all give vertices(slide_id, label, roi_id, vertex_id, x, y), where slide_id is the file's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _slide() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]+$", 1)


def _numbered(rois: DataFrame, to_int) -> DataFrame:
    """rois (slide_id, label, place, points) -> vertices, with rois numbered within a slide and label by place."""
    w = Window.partitionBy("slide_id", "label").orderBy("place")
    out = rois.withColumn("roi_id", F.row_number().over(w) - 1).select("slide_id", "label", "roi_id", F.posexplode("points").alias("vertex_id", "p"))
    return out.select("slide_id", "label", "roi_id", "vertex_id", to_int(F.col("p.x")).cast("int").alias("x"), to_int(F.col("p.y")).cast("int").alias("y"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns idx, labels, x, y; a label is one roi; no label counts as 'undefined'."""
    rows = spark.read.csv(path, header=True, schema="idx int, labels string, x int, y int", nullValue="None")
    rows = rows.select(_slide().alias("slide_id"), F.coalesce("labels", F.lit("undefined")).alias("label"), "idx", "x", "y")
    order = Window.partitionBy("slide_id", "label").orderBy("idx")
    return rows.select("slide_id", "label", F.lit(0).alias("roi_id"), (F.row_number().over(order) - 1).alias("vertex_id"), "x", "y")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """{label: {roi: [{x, y}, ...]}}, a file a slide."""
    rows = spark.read.text(path, wholetext=True).select(_slide().alias("slide_id"), F.from_json("value", "map<string,map<string,array<struct<x:double,y:double>>>>").alias("labels"))
    rois = rows.select("slide_id", F.explode("labels").alias("label", "rois")).select("slide_id", "label", F.explode("rois").alias("place", "points"))
    return _numbered(rois, lambda c: c)


def read_qupath(spark: SparkSession, path: str) -> DataFrame:
    """A list of features; lines are a roi, polygons a roi each ring; other geometries are left out. Coordinates are truncated."""
    schema = "array<struct<properties:struct<classification:struct<name:string>>,geometry:struct<type:string,coordinates:string>>>"
    features = spark.read.text(path, wholetext=True).select(_slide().alias("slide_id"), F.posexplode(F.from_json("value", schema)).alias("feature", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    depth = {k: F.from_json(raw, f"{'array<' * d}double{'>' * d}") for k, d in (("LineString", 2), ("Polygon", 3), ("MultiPolygon", 4))}
    rings = F.when(kind == "LineString", F.array(depth["LineString"])).when(kind == "Polygon", depth["Polygon"]).when(kind == "MultiPolygon", F.flatten(depth["MultiPolygon"]))
    rois = features.select("slide_id", F.col("f.properties.classification.name").alias("label"), "feature", F.posexplode(rings).alias("ring", "xy"))
    points = F.transform("xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return _numbered(rois.select("slide_id", "label", F.struct("feature", "ring").alias("place"), points.alias("points")), lambda c: c)


def read_asap(spark: SparkSession, path: str) -> DataFrame:
    """XML with Annotation@PartOfGroup / Coordinates / Coordinate@X,@Y; rounded half to even."""
    schema = "_Name string, _PartOfGroup string, Coordinates struct<Coordinate:array<struct<_Order:bigint,_X:double,_Y:double>>>"
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path)
    points = F.transform(F.array_sort("Coordinates.Coordinate"), lambda c: F.struct(c["_X"].alias("x"), c["_Y"].alias("y")))
    return _numbered(rows.select(_slide().alias("slide_id"), F.col("_PartOfGroup").alias("label"), F.col("_Name").alias("place"), points.alias("points")), lambda c: F.bround(c, 0))


def read_imagej(spark: SparkSession, path: str) -> DataFrame:
    """XML with Annotation@Name / Regions / Region / Vertices / Vertex@X,@Y; rounded half to even."""
    schema = "_Name string, Regions struct<Region:array<struct<_Id:string,Vertices:struct<Vertex:array<struct<_X:double,_Y:double>>>>>>"
    rows = spark.read.format("xml").option("rowTag", "Annotation").schema(schema).load(path)
    rois = rows.select(_slide().alias("slide_id"), F.col("_Name").alias("label"), F.posexplode("Regions.Region").alias("place", "r"))
    points = F.transform("r.Vertices.Vertex", lambda c: F.struct(c["_X"].alias("x"), c["_Y"].alias("y")))
    return _numbered(rois.select("slide_id", "label", "place", points.alias("points")), lambda c: F.bround(c, 0))


READERS = {"csv": read_csv, "json": read_json, "qupath": read_qupath, "asap": read_asap, "imagej": read_imagej}


def read_annotations(spark: SparkSession, source: str | DataFrame | list, kind: str | list[str] = "json", labels: list[str] | None = None) -> DataFrame:
    """Reads a path or glob of a kind, or takes a DataFrame of vertices as it is, or a list of such, each of its own kind if kinds are a list; keeps `labels` if given.

    Files of one slide add to each other: rois of a label are numbered on from
    source to source.
    """
    sources = source if isinstance(source, list) else [source]
    kinds = kind if isinstance(kind, list) else [kind] * len(sources)
    parts = [x if isinstance(x, DataFrame) else READERS[k](spark, x) for x, k in zip(sources, kinds, strict=True)]
    found = parts[0]
    if len(parts) > 1:
        every = [p.select("slide_id", "label", "roi_id", "vertex_id", "x", "y").withColumn("_source", F.lit(i)) for i, p in enumerate(parts)]
        for p in every[1:]:
            every[0] = every[0].unionByName(p)
        number = F.dense_rank().over(Window.partitionBy("slide_id", "label").orderBy("_source", "roi_id")) - 1
        found = every[0].withColumn("roi_id", number).drop("_source")
    return found if labels is None else found.where(F.col("label").isin(labels))
