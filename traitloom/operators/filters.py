"""Row filters of the specimen pipeline."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Image extensions that count as valid, compared in lower case.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "jp2")
# Points expected of each labelled kind.
EXPECTED_POINTS = {"tip": 1, "base": 1, "width": 2, "angle": 3}


def not_banned(url: Column, stems: list[str]) -> Column:
    """True unless the URL matches a banned stem; null URLs stay."""
    return reduce(and_, [~F.coalesce(F.rlike(url, F.lit(s)), F.lit(False)) for s in stems], F.lit(True))


def resolution(height: Column, width: Column, low: float, high: float, resize: bool = True) -> Column:
    """What becomes of an image of this size: too_small, keep, resize or too_large."""
    mp = F.round(height.cast("double") * width / F.lit(1e6), 1)  # doubles, as the pixels of large images exceed an int
    return F.when(mp < low, "too_small").when(mp <= high, "keep").otherwise("resize" if resize else "too_large")


def download_predicate(df: DataFrame, start_year=None, end_year=None, **equal) -> DataFrame:
    """Rows of a download request: bounds on year and equalities, all optional."""
    if start_year is not None:
        df = df.where(F.col("year") >= start_year)
    if end_year is not None:
        df = df.where(F.col("year") <= end_year)
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def frequent(df: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Rows of keys with at least ``least`` rows.

    Counts are aggregated before they are joined back, so a frequent key is
    never gathered in one task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return df.join(counts, key, "left_semi")


def by_class_and_score(df: DataFrame, cls: int | None = None, least: float | None = None) -> DataFrame:
    if cls is not None:
        df = df.where(F.col("cls") == cls)
    return df if least is None else df.where(F.col("score") >= least)


def included(name: Column, include: list[str]) -> Column:
    """Whether a class is listed; ``save_all`` lists every class."""
    return F.lit(True) if "save_all" in include else name.isin(include)


def reviewed(df: DataFrame, only_reviewed: bool = False) -> DataFrame:
    """Annotations that were not skipped, and reviewed where asked."""
    df = df.where(~F.col("skipped"))
    return df.where(F.col("reviews") > 0) if only_reviewed else df


def expected_count(kind: Column, count: Column) -> Column:
    """Whether a kind of point occurs as often as it must; kinds without a rule, at least once."""
    rule = F.coalesce(*[F.when(kind == k, count == n) for k, n in EXPECTED_POINTS.items()])
    return F.coalesce(rule, count > 0)


def without_overridden(df: DataFrame, image: str = "filename", drop: int = 8, when: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Drop boxes of one class from images that contain one of some others."""
    has = df.where(F.col("cls").isin(*when)).select(image).distinct().withColumn("_has", F.lit(True))
    return df.join(has, image, "left").where(~((F.col("cls") == drop) & F.coalesce("_has", F.lit(False)))).drop("_has")


def routed(df: DataFrame, image: str = "filename", leaflet: int = 2) -> DataFrame:
    """Compound or simple, by whether any object of the image is a leaflet."""
    return df.groupBy(image).agg(F.when(F.bool_or(F.col("cls") == leaflet), "compound").otherwise("simple").alias("route"))


def leaf_annotation(name: Column) -> Column:
    return F.array_contains(F.split(name, "_"), "leaf")


def fetchable(url: Column) -> Column:
    """A URL that is present and no manifest."""
    return url.isNotNull() & ~F.coalesce(F.contains(url, F.lit("manifest")), F.lit(False))


def valid_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*IMAGE_EXTENSIONS)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def first_rows(df: DataFrame, partition: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts groups to n rows before it shuffles them."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
