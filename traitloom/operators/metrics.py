"""Scores of predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.lineage import cut, in_ranges


def _running(hits: DataFrame, cls: str, score: str, order: list[str]) -> DataFrame:
    """Rows with tp, fp and the number of their range partition (``_part``).

    A class is spread over range partitions of falling score: sums run inside
    each, and what lies in the partitions before is added from one small row
    per partition and class.
    """
    ranged = in_ranges(hits, [F.col(cls), F.desc(score), *order]).drop("_nth")
    w = W.partitionBy("_part", cls).orderBy(F.desc(score), *order).rowsBetween(W.unboundedPreceding, 0)
    true, false = F.sum(F.col("hit").cast("long")), F.sum((~F.col("hit")).cast("long"))
    ahead = W.partitionBy(cls).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.groupBy("_part", cls).agg(true.alias("_t"), false.alias("_f"))
    before = before.select("_part", cls, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_t", "_f")])
    rows = ranged.withColumns({"tp": true.over(w), "fp": false.over(w)}).join(before, ["_part", cls])
    return rows.withColumns({"tp": F.col("tp") + F.col("_t"), "fp": F.col("fp") + F.col("_f")}).drop("_t", "_f")


def running_hits(predictions: DataFrame, cls: str, score: str, order: list[str]) -> DataFrame:
    """Running true and false positives per class by falling score; ``hit`` says which a row is."""
    return _running(predictions, cls, score, order).drop("_part")


def matched(pairs: DataFrame, image: str, prediction: str, label: str, value: str) -> DataFrame:
    """Greedy one-to-one matches by falling ``value``: best label per prediction, then best prediction per label."""
    best = W.partitionBy(image, prediction).orderBy(F.desc(value), label)
    own = W.partitionBy(image, label).orderBy(F.desc(value), prediction)
    return pairs.withColumn("_a", F.row_number().over(best)).where("_a = 1").withColumn("_b", F.row_number().over(own)).where("_b = 1").drop("_a", "_b")


def handed_over(pairs: DataFrame, image: str, prediction: str, label: str, value: str) -> DataFrame:
    """One-to-one matches taken from all pairs of an image by falling ``value``.

    A pair that is the best of both its ends is taken, its ends leave, and the
    rest is looked at again until no pair is left: what walking all pairs by
    falling value takes, ties in order of prediction and label.
    """
    best = lambda end: F.row_number().over(W.partitionBy(image, end).orderBy(F.desc(value), prediction, label))
    rest, taken = cut(pairs), None
    while not rest.isEmpty():
        both = cut(rest.withColumns({"_a": best(prediction), "_b": best(label)}).where("_a = 1 and _b = 1").drop("_a", "_b"))
        taken = both if taken is None else taken.unionByName(both)
        for end in (prediction, label):
            rest = rest.join(both.select(image, end), [image, end], "left_anti")
        rest = cut(rest)
    return rest if taken is None else taken


def nearest_both_ways(predicted: DataFrame, truth: DataFrame, image: str) -> DataFrame:
    """Distance from every predicted point to the nearest true one, and the other way (image, side, distance).

    A point whose other side is empty has a null distance.
    """

    def one_way(points, others, side):
        near = others.select(image, F.col("x").alias("ox"), F.col("y").alias("oy"))
        rows = points.select(image, "point", "x", "y").join(near, image, "left")
        return rows.groupBy(image, "point").agg(F.min(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).alias("distance")).select(image, F.lit(side).alias("side"), "point", "distance")

    return one_way(predicted, truth, "predicted").unionAll(one_way(truth, predicted, "true"))


def location_scores(distances: DataFrame, radii: int = 15) -> DataFrame:
    """Precision, recall and F of point locations at every radius from 0."""
    rows = distances.withColumn("radius", F.explode(F.sequence(F.lit(0), F.lit(radii))))
    hit = F.coalesce(F.col("distance") <= F.col("radius"), F.lit(False))
    share = lambda side: F.avg(F.when(F.col("side") == side, hit.cast("double")))
    out = rows.groupBy("radius").agg(share("predicted").alias("precision"), share("true").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def averaged_hausdorff(distances: DataFrame, image: str, diagonal: float) -> DataFrame:
    """Sum of both mean nearest distances per image; the diagonal where a side is missing."""
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("distance")))
    return distances.groupBy(image).agg(F.coalesce(mean("predicted") + mean("true"), F.lit(diagonal)).alias("ahd"))


def count_scores(results: DataFrame, predicted: str = "n", truth: str = "m") -> DataFrame:
    """Error measures of predicted counts; a truth of 0 counts its error in full percent."""
    p, t = F.col(predicted).cast("double"), F.col(truth).cast("double")
    e = p - t
    percent = F.when(t == 0, 100 * e).otherwise(100 * e / t)
    out = results.agg(
        F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), F.avg(percent).alias("mpe"), F.avg(F.abs(percent)).alias("mape"), F.avg(e * e).alias("mse"),
        F.corr(p, t).alias("r"), (1 - F.sum(e * e) / (F.sum(t * t) - F.sum(t) ** 2 / F.count(t))).alias("r2"),
    )
    return out.withColumn("rmse", F.sqrt("mse"))


def precision_recall(hits: DataFrame, totals: DataFrame, cls: str, order: list[str], score: str = "score") -> DataFrame:
    """Precision, recall and the envelope of precision per class along falling scores.

    ``totals`` has the class and its number of true boxes.
    """
    rows = _running(hits, cls, score, order).join(totals, cls)
    rows = rows.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("total"), "_turn": F.col("tp") + F.col("fp")})
    # from the end of the class, so that the frame only grows
    own = F.max("precision").over(W.partitionBy("_part", cls).orderBy(F.desc("_turn")).rowsBetween(W.unboundedPreceding, 0))
    beyond = F.max("_best").over(W.partitionBy(cls).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1))
    later = rows.groupBy("_part", cls).agg(F.max("precision").alias("_best")).select("_part", cls, beyond.alias("_beyond"))
    return rows.withColumn("envelope", own).join(later, ["_part", cls]).withColumn("envelope", F.greatest("envelope", "_beyond")).drop("_part", "_beyond")


def average_precision(curve: DataFrame, cls: str, grid: int = 101) -> DataFrame:
    """Area under the envelope by steps of recall, and its mean over a grid of recalls.

    Recall rises by one over the class's total at every hit, and only there.
    """
    exact = curve.groupBy(cls).agg(F.sum(F.when(F.col("hit"), F.col("envelope") / F.col("total")).otherwise(0.0)).alias("ap"))
    best = curve.groupBy(cls, F.floor(F.col("recall") * (grid - 1) + 1e-9).alias("upto")).agg(F.max("envelope").alias("envelope"))
    # the envelope at a grid recall is the best precision at that recall or beyond
    grids = curve.select(cls).distinct().withColumn("upto", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("upto", F.col("upto").cast("long"))
    filled = grids.join(best, [cls, "upto"], "left").withColumn("p", F.coalesce(F.max("envelope").over(W.partitionBy(cls).orderBy("upto").rowsBetween(0, W.unboundedFollowing)), F.lit(0.0)))
    return exact.join(filled.groupBy(cls).agg(F.avg("p").alias("ap_grid")), cls)


def best_f1(curve: DataFrame, cls: str) -> DataFrame:
    """Score threshold with the highest F1 per class."""
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return curve.groupBy(cls).agg(F.max(F.struct(F.round(f1, 9).alias("f1"), "score")).alias("b")).select(cls, "b.f1", "b.score")


def paired(predicted: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Classes of matched and of unmatched boxes (predicted, true; null without a partner)."""
    p = predicted.select(F.col("id").alias("prediction"), F.col("cls").cast("string").alias("predicted"))
    t = truth.select(F.col("id").alias("label"), F.col("cls").cast("string").alias("true"))
    # null labels meet nothing, so they are spread by their prediction instead of filling one task
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(4096))
    said = p.join(matches, "prediction", "left").withColumn("_deal", deal(F.coalesce("label", "prediction")))
    return said.join(t.withColumn("_deal", deal(F.col("label"))), ["label", "_deal"], "full_outer").select("predicted", "true")


def confusion(predicted: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of (predicted class, true class); unmatched boxes meet ``background``.

    ``predicted`` and ``truth`` have id and cls; ``matches`` prediction and label ids.
    """
    ground = lambda c: F.coalesce(c, F.lit("background"))
    return paired(predicted, truth, matches).groupBy(ground("predicted").alias("predicted"), ground("true").alias("true")).agg(F.count("*").alias("n"))


def mean_average_precision(predictions: DataFrame, totals: DataFrame, order: list[str], thresholds: list[int]) -> DataFrame:
    """Average precision per class and overlap threshold in percent (cls, threshold, ap).

    ``predictions`` has cls, score, ``order`` and iou, the overlap with the
    label that it is matched with (null without one); ``totals`` cls and total.

    Rows are ranked once for all thresholds: a row carries how many of them its
    overlap reaches, and every threshold has its own running hits.  The envelope
    of precision at a hit is the best precision of that hit and later ones, so
    that rows that reach no threshold end with the running hits.
    """
    steps = sorted(thresholds)
    reached = sum((F.coalesce(F.round(F.col("iou") * 100, 7) >= t, F.lit(False)).cast("int") for t in steps), F.lit(0))
    ranged = in_ranges(predictions.select("cls", "score", *order, reached.alias("_reached")), [F.col("cls"), F.desc("score"), *order]).drop("_nth")
    true = {f"_tp{i}": F.sum((F.col("_reached") > i).cast("long")) for i in range(len(steps))}
    w = W.partitionBy("_part", "cls").orderBy(F.desc("score"), *order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("cls").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("_part", "cls").agg(F.count("*").alias("_turn"), *[e.alias(c) for c, e in true.items()])
    before = parts.select("_part", "cls", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("_turn", *true)])
    counted = ranged.withColumns({"_turn": F.row_number().over(w), **{c: e.over(w) for c, e in true.items()}}).where("_reached > 0").join(before, ["_part", "cls"])
    turn = F.col("_turn") + F.col("_turn_before")
    hits = counted.select("_part", "cls", "_reached", turn.alias("_turn"), *[((F.col(c) + F.col(f"{c}_before")) / turn).alias(f"_p{i}") for i, c in enumerate(true)])
    own = W.partitionBy("_part", "cls").orderBy(F.desc("_turn")).rowsBetween(W.unboundedPreceding, 0)
    beyond = W.partitionBy("cls").orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    precisions = [f"_p{i}" for i in range(len(steps))]
    later = hits.groupBy("_part", "cls").agg(*[F.max(p).alias(p) for p in precisions]).select("_part", "cls", *[F.max(p).over(beyond).alias(f"{p}_beyond") for p in precisions])
    rows = hits.withColumns({p: F.max(p).over(own) for p in precisions}).join(later, ["_part", "cls"]).join(totals, "cls")
    areas = rows.groupBy("cls").agg(*[F.sum(F.when(F.col("_reached") > i, F.greatest(p, f"{p}_beyond") / F.col("total"))).alias(p) for i, p in enumerate(precisions)])
    found = parts.select("cls").distinct().join(totals, "cls").join(areas, "cls", "left")
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(p, F.lit(0.0)).alias("ap")) for t, p in zip(steps, precisions, strict=True)])
    return found.select(F.col("cls").cast("string").alias("cls"), F.explode(each).alias("_s")).select("cls", "_s.threshold", "_s.ap")


def fitness(map50: Column, map95: Column) -> Column:
    return 0.1 * map50 + 0.9 * map95


def segmentation_scores(matrix: DataFrame) -> DataFrame:
    """Mean and frequency-weighted IoU, mean and overall accuracy from (predicted, true, n)."""
    on = F.sum(F.when(F.col("predicted") == F.col("true"), F.col("n")).otherwise(0))
    true = matrix.groupBy(F.col("true").alias("cls")).agg(F.sum("n").alias("positives"), on.alias("tp"))
    said = matrix.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predictions"))
    rows = true.join(said, "cls", "left").withColumn("predictions", F.coalesce("predictions", F.lit(0)))
    iou = F.col("tp") / (F.col("positives") + F.col("predictions") - F.col("tp"))
    return rows.agg(F.avg(iou).alias("miou"), (F.sum(iou * F.col("positives")) / F.sum("positives")).alias("fwiou"), F.avg(F.col("tp") / F.col("positives")).alias("macc"), (F.sum("tp") / F.sum("positives")).alias("pacc"))


def keypoint_similarity(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over visible points of exp(-d^2 / (2 sigma)^2 / (2 area)).

    ``points`` has px, py, tx, ty, visible, sigma and area.
    """
    d2 = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
    e = F.exp(-d2 / (2 * F.col("sigma")) ** 2 / (F.col("area") * 2 + 1e-7))
    return points.groupBy(*keys).agg((F.sum(F.when(F.col("visible"), e).otherwise(F.lit(0.0))) / (F.count_if("visible") + 1e-7)).alias("oks"))
