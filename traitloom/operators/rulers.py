"""Ruler ticks, spacings, conversion factors and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.filters import first_rows
from traitloom.operators.quantiles import exact_quantiles

# Units with the parts of their system's base unit they count, and the system's divisor.
UNITS = (
    ("cm", 1, 1.0), ("halfcm", 2, 1.0), ("4thcm", 4, 1.0), ("mm", 10, 1.0), ("halfmm", 20, 1.0),
    ("inch", 1, 2.54), ("halfinch", 2, 2.54), ("4th", 4, 2.54), ("8th", 8, 2.54), ("16th", 16, 2.54), ("32nd", 32, 2.54),
)
# Ruler class names that stand for others.
CLASS_ALIASES = {
    "tick_black_4thcm": "tick_black_cm_halfcm_4thcm",
    "tick_black_dual_cm_inch_halfinch_4th_8th": "tick_black_dual_cm_halfinch_4th_8th",
    "blocktick_stagger_white_inch_16th": "blocktick_stagger_white_4th_8th_16th",
    "blocktick_stagger_black_cm_halfcm_mm": "blocktick_stagger_black_halfcm_mm",
    "blocktick_stagger_white_cm_halfcm_mm": "blocktick_stagger_white_halfcm_mm",
}


def best_ruler(rulers: DataFrame, image: str, order: list[str]) -> DataFrame:
    """The most confident ruler of each image; missing confidence last, then source order."""
    return first_rows(rulers, [image], [F.col("confidence").desc_nulls_last(), *order])


def conversion_factor(rulers: DataFrame, image: str, order: list[str]) -> DataFrame:
    """Per image: mean of positive measured factors, else the last positive predicted one, else 0; two digits."""
    last = F.max(F.when(F.col("predicted") > 0, F.struct(*order, F.col("predicted").alias("_p"))))["_p"]
    mean = F.avg(F.when(F.col("conversion_mean") > 0, F.col("conversion_mean")))
    return rulers.groupBy(image).agg(F.round(F.coalesce(mean, last, F.lit(0.0)), 2).alias("factor"))


def nearest_gaps(ticks: DataFrame, keys: list[str], least: float = 2.0) -> DataFrame:
    """Distance from each tick to its nearest neighbour on the line; only gaps above ``least``."""
    line = W.partitionBy(*keys).orderBy("x")
    gap = F.least(F.col("x") - F.lag("x").over(line), F.lead("x").over(line) - F.col("x"))
    return ticks.withColumn("gap", gap).where(F.col("gap") > least)


def geometric_spacing(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Geometric mean of nearest gaps per group."""
    return gaps.groupBy(*keys).agg(F.exp(F.avg(F.ln("gap"))).alias("spacing"), F.count("*").alias("n"))


def trimmed(df: DataFrame, keys: list[str], value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Rows strictly inside the quantiles widened by their distance; quantiles are exact."""
    cuts = exact_quantiles(df, keys, value, {"_lo": low, "_hi": high})
    width = F.col("_hi") - F.col("_lo")
    inside = (F.col(value) > F.col("_lo") - width) & (F.col(value) < F.col("_hi") + width)
    return df.join(cuts, keys).where(inside).drop("_lo", "_hi")


def below_geometric(df: DataFrame, keys: list[str], value: str, spread: float = 0.5) -> DataFrame:
    """Rows up to the geometric mean plus a share of the sample deviation."""
    stats = df.groupBy(*keys).agg((F.exp(F.avg(F.ln(value))) + spread * F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("_top"))
    return df.join(stats, keys).where(F.col(value) <= F.col("_top")).drop("_top")


def strip_summary(gaps: DataFrame) -> DataFrame:
    """Per ruler strip: n, mean, sd, sd over mean, geometric mean."""
    sd = F.coalesce(F.stddev_samp("gap"), F.lit(0.0))
    out = gaps.groupBy("ruler_id", "strip").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), sd.alias("sd"), F.exp(F.avg(F.ln("gap"))).alias("gmean"))
    return out.withColumn("nsd", F.col("sd") / F.col("mean"))


def best_strip(summary: DataFrame, least: int = 3) -> DataFrame:
    """The strip of each ruler with the smallest normalised deviation among those with enough gaps."""
    return summary.where(F.col("n") >= least).groupBy("ruler_id").agg(F.min(F.struct("nsd", "strip")).alias("b")).select("ruler_id", "b.strip", "b.nsd")


def regular(ticks: DataFrame) -> DataFrame:
    """Whether spacings of every second and every third tick are about two and three times the base."""
    order = W.partitionBy("ruler_id", "strip").orderBy("x", "event_id")
    turn = ticks.withColumn("_turn", F.row_number().over(order))

    def spacing(step: int, name: str) -> DataFrame:
        gaps = nearest_gaps(turn.where(F.col("_turn") % step == 0), ["ruler_id", "strip"], 0.0)
        return geometric_spacing(gaps, ["ruler_id", "strip"]).select("ruler_id", "strip", F.col("spacing").alias(name))

    joined = spacing(1, "base").join(spacing(2, "second"), ["ruler_id", "strip"]).join(spacing(3, "third"), ["ruler_id", "strip"])
    near = lambda c, k: F.col(c).between(F.col("base") * (k - 1), F.col("base") * (k + 1))
    return joined.withColumn("is_regular", near("second", 2) & near("third", 3))


def pooled_sd(groups: DataFrame, keys: list[str], minus: int | None = 2) -> DataFrame:
    """Pooled deviation of groups (n, sd): over n - ``minus``, or over n - number of groups for None."""
    lost = F.lit(minus) if minus is not None else F.count("*")
    freedom = F.greatest((F.sum("n") - lost).cast("double"), F.lit(1e-10))
    return groups.groupBy(*keys).agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")) / freedom).alias("pooled_sd"))


def relative_sd(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Deviation in percent of the mean, 0 for single rows."""
    return df.groupBy(*keys).agg(F.when(F.count("*") > 1, F.stddev_samp(value) / F.avg(value) * 100).otherwise(F.lit(0.0)).alias("rsd"))


def percent_errors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return df.join(means, keys).withColumn("percent_error", F.abs(F.col(value) - F.col("_mean")) / F.col("_mean") * 100).drop("_mean")


def units_table(spark) -> DataFrame:
    return spark.createDataFrame(list(UNITS), "unit string, factor int, divisor double")


def to_centimetres(spacings: DataFrame, units: DataFrame, value: str = "spacing") -> DataFrame:
    """Pixels per centimetre of a spacing read in its unit."""
    return spacings.join(F.broadcast(units), "unit").withColumn("px_per_cm", F.col(value) * F.col("factor") / F.col("divisor"))


def consensus(spacings: DataFrame, units: DataFrame, predicted: str, share: float = 0.1) -> DataFrame:
    """Factor that candidate readings agree on: within a share of the predicted one, trimmed, averaged."""
    read = spacings.crossJoin(F.broadcast(units)).withColumn("cm", F.col("spacing") * F.col("factor") / F.col("divisor"))
    near = read.where(F.abs(F.col("cm") - F.col(predicted)) <= share * F.col(predicted))
    return trimmed(near, ["ruler_id"], "cm").groupBy("ruler_id").agg(F.avg("cm").alias("cm"), F.count("*").alias("n"), F.countDistinct("unit").alias("n_units"))


def line_readings(points: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Every labelled unit line read in pixels per centimetre: keys, unit, cm, sd (of all gaps) and n gaps.

    ``points`` has keys, unit, seq, x and y; gaps lie between neighbours in
    order of seq.  A line of one point has no gap and is left out.
    """
    line = W.partitionBy(*keys).orderBy("seq")
    gap = F.hypot(F.lead("x").over(line) - F.col("x"), F.lead("y").over(line) - F.col("y"))
    lines = points.withColumn("_gap", gap).where("_gap is not null").groupBy(*keys, "unit").agg(F.avg("_gap").alias("_mean"), F.stddev_pop("_gap").alias("sd"), F.count("*").alias("n"))
    return to_centimetres(lines, units, "_mean").select(*keys, "unit", F.col("px_per_cm").alias("cm"), "sd", "n")


def label_rollup(readings: DataFrame, sizes: DataFrame, image: str) -> DataFrame:
    """Readings of each image rolled up: mean cm, all gaps, pooled deviation, relative deviation in percent, largest dimension."""
    pooled = F.sqrt(F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")) / F.greatest((F.sum("n") - F.count("*")).cast("double"), F.lit(1e-15)))
    rsd = F.when(F.count("*") > 1, F.stddev_samp("cm") / F.avg("cm") * 100).otherwise(F.lit(0.0))
    out = readings.groupBy(image).agg(F.avg("cm").alias("cm"), F.sum("n").alias("n"), pooled.alias("pooled_sd"), rsd.alias("rsd"))
    return out.join(sizes.select(image, F.greatest("width", "height").alias("max_dim")), image)


# Kinds of ruler blocks in the order in which they are tried, with the mean
# axis ratio that tells them and its band.
BLOCK_KINDS = (("bigCM", 1.75, 0.1), ("smallCM", 4.5, 0.25), ("halfCM", 2.2, 0.1), ("mm", 6.8, 0.1))
# Per kind, blocks' spacing in centimetres is spacing times this, and the spacing
# must lie within these shares of the mean major (mm: minor) axis.
BLOCK_SPACING = {"bigCM": (1.0, 0.8, 1.2), "smallCM": (0.5, 1.6, 2.4), "halfCM": (2.0, 0.8, 1.2), "mm": (10.0, 0.1, 1.1)}


def block_kinds(blobs: DataFrame, ruler: str = "ruler_id") -> DataFrame:
    """Kind of every group of blobs of one size rank, by its mean axis ratio; groups of 2 to 10 only, others and unclear ones go.

    ``blobs`` has ruler, rank, x, major and minor.
    """
    groups = blobs.groupBy(ruler, "rank").agg(F.count("*").alias("n"), F.avg(F.col("major") / F.col("minor")).alias("ratio"), F.avg("major").alias("major"), F.avg("minor").alias("minor"))
    kind = F.coalesce(*[F.when(F.col("ratio").between((1 - band) * ratio, (1 + band) * ratio), name) for name, ratio, band in BLOCK_KINDS])
    return groups.where(F.col("n").between(2, 10)).withColumn("kind", kind).where("kind is not null")


def block_factors(blobs: DataFrame, predicted: DataFrame, ruler: str = "ruler_id", share: float = 0.1) -> DataFrame:
    """Pixels per centimetre of block rulers (ruler, factor, location, options).

    A group's spacing is the mean distance of its blobs to their nearest
    neighbours in x (above one pixel); it must fit the blobs' axes.  Groups are
    taken by size rank up to the first whose kind was met before.  Factors
    within ``share`` of the predicted one (``predicted``: ruler, predicted) are
    valid: one is taken as it is, several are averaged, none gives 0 and ``fail``.
    """
    spacing = nearest_gaps(blobs, [ruler, "rank"], 1.0).groupBy(ruler, "rank").agg(F.avg("gap").alias("spacing"))
    groups = block_kinds(blobs, ruler).join(spacing, [ruler, "rank"])
    fits = lambda name: F.col("spacing").between(BLOCK_SPACING[name][1] * F.col("minor" if name == "mm" else "major"), BLOCK_SPACING[name][2] * F.col("minor" if name == "mm" else "major"))
    factor = F.coalesce(*[F.when((F.col("kind") == name) & fits(name), F.col("spacing") * BLOCK_SPACING[name][0]) for name in BLOCK_SPACING])
    found = groups.withColumn("factor", factor).where("factor is not null")
    again = found.withColumn("_nth", F.row_number().over(W.partitionBy(ruler, "kind").orderBy("rank"))).withColumn("_stop", F.min(F.when(F.col("_nth") > 1, F.col("rank"))).over(W.partitionBy(ruler)))
    valid = again.where("_stop is null or rank < _stop").join(predicted, ruler).where(F.abs(F.col("factor") - F.col("predicted")) <= share * F.col("predicted"))
    place = F.coalesce(*[F.when(F.col("kind") == name, i) for i, name in enumerate(BLOCK_SPACING)])
    names = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "kind"))), lambda s: s["kind"])
    best = valid.groupBy(ruler).agg(F.avg("factor").alias("factor"), F.when(F.count("*") > 1, "average").otherwise(F.first("kind")).alias("location"), F.array_join(names, ", ").alias("options"))
    return predicted.select(ruler).join(best, ruler, "left").select(ruler, F.coalesce("factor", F.lit(0.0)).alias("factor"), F.coalesce("location", F.lit("fail")).alias("location"), F.coalesce("options", F.lit("")).alias("options"))


def converted(value: Column, factor: Column, area: bool = False) -> Column:
    """Pixels to metric with two digits; unchanged without a factor."""
    return F.when(factor > 0, F.round(value / (factor * factor if area else factor), 2)).otherwise(value)


def class_features(ruler_class: Column) -> dict[str, Column]:
    """What a ruler class name says: family, system, and the units it shows, smallest last."""
    name = ruler_class
    for alias, real in CLASS_ALIASES.items():
        name = F.when(ruler_class == alias, real).otherwise(name)
    parts = F.split(name, "_")
    metric = F.array(*[F.lit(u) for u, _, d in UNITS if d == 1.0])
    standard = F.array(*[F.lit(u) for u, _, d in UNITS if d != 1.0])
    has_metric, has_standard = F.arrays_overlap(parts, metric), F.arrays_overlap(parts, standard)
    system = F.when(has_metric & has_standard, "dual").when(has_metric, "metric").when(has_standard, "standard")
    shown = F.array_join(F.concat(F.array_intersect(metric, parts), F.array_intersect(standard, parts)), ",")
    return {"name": name, "family": F.get(parts, F.lit(0)), "system": system, "units": shown}


def two_clusters(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact one-dimensional 2-means per group: the cut with the least within-cluster squares.

    Adds ``low`` (member of the lower cluster); a group of equal values is all low.
    """
    line = W.partitionBy(key).orderBy(value)
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(key)
    sums = df.select(key, value).withColumns(
        {"_n": F.count("*").over(upto), "_s": F.sum(value).over(upto), "_next": F.lead(value).over(line), "_all": F.count("*").over(whole), "_total": F.sum(value).over(whole)}
    )
    gain = F.col("_s") ** 2 / F.col("_n") + (F.col("_total") - F.col("_s")) ** 2 / (F.col("_all") - F.col("_n"))
    cuts = sums.where((F.col("_n") < F.col("_all")) & (F.col("_next") > F.col(value))).groupBy(key).agg(F.max(F.struct(F.round(gain, 6).alias("g"), (-F.col(value)).alias("v"))).alias("_cut"))
    return df.join(cuts, key, "left").withColumn("low", F.coalesce(F.col(value) <= -F.col("_cut.v"), F.lit(True))).drop("_cut")


def _segments(values: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Last index of every cluster of the exact one-dimensional k-means of sorted values.

    The least squares of the first j values in c clusters follow from prefix
    sums and the least squares in c - 1.  The best last cut moves up with j, so
    the middle j's cut bounds those of both halves: k n log n steps.  Equal
    squares take the lower cut.
    """
    n, k = len(values), min(k, len(values))
    w, s, q = (np.append(0.0, np.cumsum(x)) for x in (weights, weights * values, weights * values**2))

    def squares(i, j):
        """Within-cluster squares of values i up to j, both included."""
        total = w[j + 1] - w[i]
        return q[j + 1] - q[i] - (s[j + 1] - s[i]) ** 2 / total

    best = squares(np.zeros(n, int), np.arange(n))
    cuts = []
    for c in range(1, k):
        now, cut = np.full(n, np.inf), np.zeros(n, int)
        todo = [(c, n - 1, c, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j) + 1)
            cost = np.round(best[i - 1] + squares(i, np.full(len(i), j)), 6)
            at = int(np.argmin(cost))
            now[j], cut[j] = best[i[at] - 1] + squares(i[at], j), i[at]
            todo += [(low, j - 1, first, i[at]), (j + 1, high, i[at], last)]
        cuts.append(cut)
        best = now
    ends, j = [n - 1], n - 1
    for cut in reversed(cuts):
        j = int(cut[j]) - 1
        ends.append(j)
    return ends[::-1]


def k_clusters(df: DataFrame, key: str, value: str, k: str) -> DataFrame:
    """Exact one-dimensional k-means per group: the partition with the least within-cluster squares.

    ``k`` names a column with the group's number of clusters (the largest of a
    group counts); with fewer distinct values, each is a cluster.  Adds cluster
    (from 0 by rising centre), centre, and dominant (the cluster of most rows,
    of equal ones the lowest).  Rows with a null value are in no cluster.

    A group's distinct values with their numbers meet in one task, its rows do
    not; one row of cuts per group meets the rows again.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"), F.max(k).alias("_k"))
    kind = dict(counts.dtypes)["_key"]

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_value")
        values, weights = frame["_value"].to_numpy(), frame["_n"].to_numpy(float)
        ends = _segments(values, weights, max(int(frame["_k"].max()), 1))
        begins = [0, *(e + 1 for e in ends[:-1])]
        sizes = np.array([weights[a : b + 1].sum() for a, b in zip(begins, ends)])
        centres = [float((weights[a : b + 1] * values[a : b + 1]).sum() / size) for a, b, size in zip(begins, ends, sizes)]
        return pd.DataFrame({"_key": frame["_key"].iloc[:1], "_ends": [[float(values[e]) for e in ends]], "_centres": [centres], "_most": [int(sizes.argmax())]})

    cuts = counts.groupBy("_key").applyInPandas(cut, f"_key {kind}, _ends array<double>, _centres array<double>, _most int")
    rows = df.join(cuts, F.col(key).eqNullSafe(F.col("_key")), "left")
    cluster = F.when(F.col(value).isNotNull(), F.size(F.filter("_ends", lambda e: e < F.col(value))))
    rows = rows.withColumn("cluster", cluster)
    return rows.withColumns({"centre": F.get("_centres", F.col("cluster")), "dominant": F.col("cluster") == F.col("_most")}).drop("_key", "_ends", "_centres", "_most")
