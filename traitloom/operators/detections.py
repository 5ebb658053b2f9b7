"""Operators on detection boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The plant vocabulary, in class-index order.
PLANT_CLASSES = (
    "leaf_whole", "leaf_partial", "leaflet", "seed_fruit_one", "seed_fruit_many",
    "flower_one", "flower_many", "bud", "specimen", "roots", "wood",
)
# The other vocabularies, in class-index order.
VOCABULARIES = {
    "plant": PLANT_CLASSES,
    "archival": ("ruler", "barcode", "colorcard", "label", "map", "envelope", "photo", "attached_item", "weights"),
    "prep": ("ruler", "barcode", "colorcard", "label", "map", "envelope", "photo", "attached_item", "weights"),
    "acacia": ("prickles", "prickles_skip", "spines", "spines_skip"),
    "landmark": ("apex_angle", "base_angle", "lamina_base", "lamina_tip", "lamina_width", "lobe_tip", "midvein_trace", "petiole_tip", "petiole_trace"),
    "armature": ("tip", "middle", "outer"),
}
FERTILE_CLASSES = ("seed_fruit_one", "seed_fruit_many", "flower_one", "flower_many")


#: Boxes that a task counts by image and class, nearly all of which differ.
COUNTED_ROWS = 1_000_000


def phenology(boxes: DataFrame, image: str = "filename", minimum: int = 0, ideal_only: bool = False) -> DataFrame:
    """Counts of every plant class per image, with leaf and fertility flags.

    A sheet is fertile when a single fertile class exceeds ``minimum``; buds do
    not count.  ``ideal_only`` accepts whole leaves alone as leaves.
    """
    counts = [F.count_if(F.col("cls") == i).alias(name) for i, name in enumerate(PLANT_CLASSES)]
    out = boxes.groupBy(image).agg(*counts)
    leaves = F.col("leaf_whole") if ideal_only else F.col("leaf_whole") + F.col("leaf_partial")
    fertile = F.greatest(*FERTILE_CLASSES) > minimum
    return out.withColumns({"has_leaves": leaves > 0, "is_fertile": fertile})


def class_name(cls: Column, vocabulary: str) -> Column:
    """Name of a class index; ``invalid class`` for an index that the vocabulary lacks, null for null."""
    names = F.array(*[F.lit(n) for n in VOCABULARIES[vocabulary]])
    return F.when(cls.isNotNull(), F.coalesce(F.get(names, F.when(cls >= 0, cls).otherwise(F.lit(-1))), F.lit("invalid class")))


def class_index(name: Column, vocabulary: str) -> Column:
    """Class index of a name, A-Z in either case; null for others."""
    place = F.array_position(F.array(*[F.lit(n) for n in VOCABULARIES[vocabulary]]), F.lower(name)).cast("int") - 1
    return F.when(place >= 0, place)


def crop_box(boxes: DataFrame, image: str, classes: tuple[int, ...], pad: int, width: int, height: int) -> DataFrame:
    """Union of the boxes of some classes per image, padded and clipped to the image."""
    return (
        boxes.where(F.col("cls").isin(*classes))
        .groupBy(image)
        .agg(
            F.greatest(F.min("x1") - pad, F.lit(0)).alias("x1"),
            F.greatest(F.min("y1") - pad, F.lit(0)).alias("y1"),
            F.least(F.max("x2") + pad, F.lit(width)).alias("x2"),
            F.least(F.max("y2") + pad, F.lit(height)).alias("y2"),
        )
    )


def label_quality(labels: DataFrame, images: DataFrame, image: str) -> DataFrame:
    """Images that are missing, found, empty or corrupt by their label rows.

    A label row is bad with negative or over-large coordinates; duplicates count once.
    """
    rows = labels.dropDuplicates([image, "cls", "xc", "yc", "w", "h"])
    bad = F.coalesce(F.least("xc", "yc", "w", "h") < 0, F.lit(False)) | F.coalesce(F.greatest("xc", "yc", "w", "h") > 1, F.lit(False))
    per = rows.groupBy(image).agg(F.count("cls").alias("boxes"), F.bool_or(bad).alias("bad"))
    state = F.when(F.col("bad").isNull(), "missing").when(F.col("bad"), "corrupt").when(F.col("boxes") == 0, "empty").otherwise("found")
    return images.select(image).join(per, image, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def image_statistics(boxes: DataFrame, images: DataFrame, image: str) -> DataFrame:
    """Per split: boxes, images, and images without a box; ``images`` has image and split."""
    counts = boxes.groupBy(image).agg(F.count("*").alias("_boxes"))
    rows = images.select(image, "split").distinct().join(counts, image, "left")
    return rows.groupBy("split").agg(F.coalesce(F.sum("_boxes"), F.lit(0)).alias("instances"), F.count("*").alias("images"), F.count_if(F.col("_boxes").isNull()).alias("unlabelled"))


def side_distances(x: Column, y: Column, box: dict[str, Column]) -> dict[str, Column]:
    """Distances of a point to the left, top, right and bottom side of a box; all positive inside."""
    return {"left": x - box["x1"], "top": y - box["y1"], "right": box["x2"] - x, "bottom": box["y2"] - y}


def split_statistics(boxes: DataFrame, images: DataFrame, image: str) -> DataFrame:
    """Per split and class: boxes and images; images have image and split."""
    dealt = max(-(-boxes.count() // COUNTED_ROWS), 1)
    counts = boxes.where(F.col(image).isNotNull()).repartition(dealt, image).groupBy(image, "cls").agg(F.count("*").alias("_n"))
    rows = counts.join(images.groupBy(image, "split").agg(F.count("*").alias("_times")), image)
    return rows.groupBy("split", "cls").agg(F.sum(F.col("_n") * F.col("_times")).alias("instances"), F.count("*").alias("images"))


def class_weights(boxes: DataFrame) -> DataFrame:
    """Inverse-frequency weights of classes, summing to one."""
    counts = boxes.groupBy("cls").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum(1 / F.col("n")).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("cls", (1 / F.col("n") / F.col("total")).alias("weight"))


def image_weights(boxes: DataFrame, weights: DataFrame, image: str) -> DataFrame:
    return boxes.groupBy(image, "cls").agg(F.count("*").alias("n")).join(weights, "cls").groupBy(image).agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))


def anchor_recall(boxes: DataFrame, anchors: list[tuple[float, float]], least: float = 0.25) -> DataFrame:
    """Best possible recall of an anchor set, and mean best ratio; anchors are few and given."""
    ratio = lambda b, a: F.least(b / a, a / b)
    best = F.greatest(*[F.least(ratio(F.col("w"), F.lit(a)), ratio(F.col("h"), F.lit(b))) for a, b in anchors])
    return boxes.where("w > 0 and h > 0").select(best.alias("best")).agg(F.avg((F.col("best") > least).cast("double")).alias("recall"), F.avg("best").alias("mean_best"))


def with_uncrowded(boxes: DataFrame, image: str) -> DataFrame:
    """Boxes of images that have at least one box that is no crowd."""
    return boxes.join(boxes.where(~F.col("crowd")).select(image), image, "left_semi")


def with_visible(points: DataFrame, image: str, least: int) -> DataFrame:
    """Images with at least ``least`` visible keypoints."""
    return points.groupBy(image).agg(F.count_if("visible").alias("n")).where(F.col("n") >= least)


def histogram(boxes: DataFrame) -> DataFrame:
    """Boxes per class with a total row (null class)."""
    return boxes.rollup("cls").agg(F.count("*").alias("n"))


def repeat_factors(boxes: DataFrame, images: DataFrame, image: str, threshold: float) -> DataFrame:
    """Largest max(1, sqrt(threshold / share of images)) over an image's classes; 1 without labels."""
    pairs = boxes.select(image, "cls").distinct()
    total = images.select(image).distinct().agg(F.count("*").alias("total"))
    shares = pairs.groupBy("cls").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    factors = shares.select("cls", F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / (F.col("n") / F.col("total")))).alias("factor"))
    per = pairs.join(factors, "cls").groupBy(image).agg(F.max("factor").alias("factor"))
    return images.select(image).distinct().join(per, image, "left").select(image, F.coalesce("factor", F.lit(1.0)).alias("factor"))


def box_checks(boxes: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    """Area, clipped corners, emptiness and whether a box lies inside its image with a margin."""
    cut = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(most))
    inside = (F.col("x1") >= -margin) & (F.col("y1") >= -margin) & (F.col("x2") < width + margin) & (F.col("y2") < height + margin)
    return boxes.withColumns(
        {"area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), "cx1": cut("x1", width), "cy1": cut("y1", height), "cx2": cut("x2", width), "cy2": cut("y2", height),
         "nonempty": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), "inside": inside}
    )


def label_lines(boxes: DataFrame, image: str, order: list[str]) -> DataFrame:
    """One text per image with a line ``cls x y w h`` for each box, in order."""
    line = F.concat_ws(" ", "cls", *[F.round(c, 6).cast("string") for c in ("xc", "yc", "w", "h")])
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return boxes.groupBy(image).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"))


def parsed_labels(files: DataFrame, image: str, text: str) -> DataFrame:
    """Boxes (image, cls, xc, yc, w, h, score) from label texts; lines with under five fields go."""
    fields = F.split(F.col("line"), " ")
    rows = files.select(image, F.explode(F.split(text, "\n")).alias("line")).where(F.size(fields) >= 5)
    number = lambda i: F.get(fields, F.lit(i)).try_cast("double")
    return rows.select(image, F.get(fields, F.lit(0)).try_cast("int").alias("cls"), *[number(i + 1).alias(c) for i, c in enumerate(("xc", "yc", "w", "h", "score"))])
