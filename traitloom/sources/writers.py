"""Sinks of trait tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.operators.linkage import stacked


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    """Entity table partitioned by batch; appends are atomic per job."""
    df.write.mode("append").partitionBy(batch).parquet(path)


def merge_batches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table over batch folders whose columns may differ; duplicates stay."""
    return stacked(*[spark.read.parquet(p) for p in paths])


def write_per_file(df: DataFrame, path: str, name: str = "filename") -> None:
    df.write.mode("append").partitionBy(name).json(path)


def _commit(spark: SparkSession, path: str, name: str, text: str) -> None:
    """A file that is there whole or not at all: written beside, then renamed; one that is there already stays or is replaced whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    hidden, final = hadoop.Path(f"{path}/.{name}-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/{name}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(path))
    out = files.create(hidden, True)
    out.write(text.encode())
    out.close()
    if not files.rename(hidden, final):
        files.delete(hidden, False)
        if not files.exists(final):
            raise OSError(f"could not rename to {final}")


def write_combined(df: DataFrame, path: str) -> str:
    """Append to a combined table that has one header, and name the append.

    Rows go to a folder of their own under ``path/rows``.  They belong to the
    table once a manifest under ``path/manifests``, renamed into place, names the
    folder and its columns.  Concurrent appends have different names, so
    neither can spoil the other's rows; what a failed append left behind is
    never read.  ``path/header`` is the first append's, renamed into place once.
    """
    spark = df.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.option("header", False).csv(f"{path}/rows/{name}")
    _commit(spark, f"{path}/manifests", f"{name}.json", json.dumps({"folder": name, "columns": df.columns}))
    header = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    if not header.getFileSystem(spark._jsc.hadoopConfiguration()).exists(header):
        _commit(spark, path, "header", ",".join(_layouts(spark, path)[0]["columns"]))
    return name


def _layouts(spark: SparkSession, path: str) -> list:
    """Columns and folders of the appends, one row per layout, in order of its first append."""
    found = spark.read.schema("folder string, columns array<string>").json(f"{path}/manifests/*.json")
    return found.groupBy("columns").agg(F.min("folder").alias("first"), F.collect_list("folder").alias("folders")).orderBy("first").collect()


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`write_combined` keeps, all columns strings.

    The header is the first append's; columns that only later ones have come
    after it, and are null where an append lacks them.  Appends with the same
    columns are read together.
    """
    parts = [spark.read.schema(", ".join(f"`{n}` string" for n in r["columns"])).csv([f"{path}/rows/{f}" for f in sorted(r["folders"])]) for r in _layouts(spark, path)]
    return stacked(*parts)


# The columns of the four batch tables, in order.
_SHAPE = (
    "efd_order", "efd_coeffs_features", "efd_a0", "efd_c0", "efd_scale", "efd_angle", "efd_phase", "efd_area", "efd_perimeter", "efd_plot_points",
)
RULER_COLUMNS = (
    "filename", "image_height", "image_width", "ruler_image_name", "ruler_location", "ruler_success", "conversion_mean", "predicted_conversion_factor_cm", "pooled_sd",
    "ruler_class", "ruler_class_confidence", "units", "cross_validation_count", "n_scanlines", "n_data_points_in_avg", "avg_tick_width",
)
MEASUREMENT_COLUMNS = (
    "filename", "image_height", "image_width", "component_name", "conversion_factor_applied", "annotation_name", "bbox", "bbox_min", "rotate_angle", "bbox_min_long_side",
    "bbox_min_short_side", "area", "perimeter", "centroid", "convex_hull", "convexity", "concavity", "circularity", "n_pts_in_polygon", "aspect_ratio", "polygon_closed",
    "polygon_closed_rotated", *_SHAPE, "ruler_image_name", "ruler_success", "conversion_mean", "predicted_conversion_factor_cm", "pooled_sd", "ruler_class",
    "ruler_class_confidence", "units", "cross_validation_count", "n_scanlines", "n_data_points_in_avg", "avg_tick_width",
)
EFD_COLUMNS = ("filename", "image_height", "image_width", "component_name", "conversion_factor_applied", "conversion_mean", "predicted_conversion_factor_cm", "annotation_name", *_SHAPE)
LANDMARK_COLUMNS = (
    "filename", "image_height", "image_width", "component_name", "component_height", "component_width", "conversion_factor_applied", "landmark_status", "leaf_type",
    "has_all_landmarks", "determined_leftright", "lamina_length", "lamina_width", "ordered_midvein_length", "ordered_petiole_length", "lobe_count", "apex_angle_type",
    "apex_angle_degrees", "base_angle_type", "base_angle_degrees", "has_apex", "has_base", "has_lamina_base", "has_lamina_length", "has_lamina_tip", "has_lobes", "has_midvein",
    "has_ordered_petiole", "has_valid_apex_loc", "has_valid_base_loc", "has_width", "apex_center", "apex_left", "apex_right", "base_center", "base_left", "base_right",
    "lamina_tip", "lamina_tip_alt", "lamina_base", "lamina_base_alt", "lobes", "midvein_fit_points", "ordered_midvein", "ordered_petiole", "width_left", "width_right",
    "t_apex_center", "t_apex_left", "t_apex_right", "t_base_center", "t_base_left", "t_base_right", "t_lamina_base", "t_lamina_tip", "t_midvein", "t_midvein_fit_points",
    "t_petiole", "t_width_infer", "t_width_left", "t_width_right", "lamina_fit_ax_b", "midvein_fit_ax_b", "plot_x_shift", "plot_y_shift",
)


def layout(entity: str, order: int = 40, record: tuple[str, ...] = ()) -> list[str]:
    """Columns of a batch table: Ruler, Measurements (with the columns of the specimen's record), EFD (with ``order`` coefficient columns) or Landmarks."""
    fixed = {"Ruler": RULER_COLUMNS, "Measurements": (*MEASUREMENT_COLUMNS, *record), "EFD": (*EFD_COLUMNS, *(f"coeffs_{i}" for i in range(order))), "Landmarks": LANDMARK_COLUMNS}
    return list(fixed[entity])


def write_entity(df: DataFrame, path: str, run: str, entity: str, batch: str, batches: int, order: int = 40, record: tuple[str, ...] = ()) -> None:
    """A batch table in its fixed layout: CSV with a header under ``file=<run>__<entity>__<i>of<n>.csv``, one folder per batch.

    ``batch`` counts from 0.  Columns that ``df`` lacks are null; those that the
    layout lacks are an error, so that nothing is lost silently.  Nested values
    are written as JSON.
    """
    columns = layout(entity, order, record)
    unknown = set(df.columns) - set(columns) - {batch}
    if unknown:
        raise ValueError(f"{entity} has no column for {sorted(unknown)}")
    kinds = dict(df.dtypes)
    cell = lambda c: F.lit(None).cast("string") if c not in kinds else F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    file = F.format_string(f"{run}__{entity}__%dof{batches}.csv", (F.col(batch) + 1).cast("long"))
    df.select(file.alias("file"), *[cell(c).alias(c) for c in columns]).write.mode("append").option("header", True).partitionBy("file").csv(path)


def read_entity(spark: SparkSession, path: str, entity: str, order: int = 40, record: tuple[str, ...] = ()) -> DataFrame:
    """All batches of a table in its fixed layout, with ``file``; all columns strings."""
    schema = ", ".join(f"`{c}` string" for c in [*layout(entity, order, record), "file"])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def save_project(tables: dict[str, DataFrame], project: str, path: str | None = None) -> None:
    """Project tables (images, components, ...) under names of the catalog, ``<project>_<table>``; in ``path`` if it is given."""
    for name, df in tables.items():
        sink = df.write.mode("overwrite").format("parquet")
        (sink.option("path", f"{path}/{name}") if path else sink).saveAsTable(f"{project}_{name}")


def project_rows(spark: SparkSession, project: str, table: str, names: DataFrame, key: str = "name") -> DataFrame:
    """Look-up by name in a project table, for many names at once."""
    return spark.table(f"{project}_{table}").join(names.select(key), key, "left_semi")


def coco_packets(images: DataFrame, annotations: DataFrame, categories: list[str] | tuple[str, ...] = (), info: str = "") -> DataFrame:
    """One JSON text per image: info, categories (numbered in order), the image and its annotations with area and box."""
    boxes = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "area", "bbox"))).alias("annotations"))
    rows = images.join(boxes, F.col("id") == F.col("image_id"), "left")
    named = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(name).alias("name")) for i, name in enumerate(categories)])
    extra = [F.struct(F.lit(info).alias("description")).alias("info"), named.alias("categories")] if categories or info else []
    return rows.select("file_name", F.to_json(F.struct(*extra, "file_name", "width", "height", "annotations")).alias("packet"))


def trackers(log: DataFrame, path: str) -> None:
    """Per-taxon and per-host counts as CSV."""
    for key in ("fullname", "host"):
        log.groupBy(key).count().write.mode("overwrite").option("header", True).csv(f"{path}/{key}")
