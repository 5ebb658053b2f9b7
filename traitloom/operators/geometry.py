"""Boxes, polygons, traces and angles on exploded point rows.

Point tables have an object key, ``seq`` from 0, ``x`` and ``y``.  Windows run
per object, whose size is bounded by what one crop can hold.
"""

from __future__ import annotations

from math import pi

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.extension import Aggregator, aggregate_by


def _int(c: Column) -> Column:
    """Truncation towards zero."""
    return c.cast("bigint")


def pixel_box(xc: Column, yc: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Corners in pixels of a normalised centre box."""
    width, height = F.lit(width), F.lit(height)
    return {"x1": _int((xc - w / 2) * width), "y1": _int((yc - h / 2) * height), "x2": _int((xc + w / 2) * width), "y2": _int((yc + h / 2) * height)}


def normalised_box(x1: Column, y1: Column, x2: Column, y2: Column, width, height) -> dict[str, Column]:
    """Normalised centre box of pixel corners."""
    width, height = F.lit(float(width)), F.lit(float(height))
    return {"xc": (x1 + x2) / 2 / width, "yc": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def box_centre(xc: Column, yc: Column, w: Column, h: Column, width, height) -> dict[str, Column]:
    """Centre pixel of a box, truncated after each step."""
    box = pixel_box(xc, yc, w, h, width, height)
    return {"cx": _int((box["x1"] + box["x2"]) / 2), "cy": _int((box["y1"] + box["y2"]) / 2)}


def box_area(a: str) -> Column:
    c = lambda k: F.col(f"{a}.{k}").cast("double")
    return (c("x2") - c("x1")) * (c("y2") - c("y1"))


def overlaps(a: str, b: str, eps: float = 1e-7) -> dict[str, Column]:
    """IoU and its generalised, distance and complete forms, and intersection over the second area.

    ``a`` and ``b`` name struct columns with x1, y1, x2, y2.
    """
    p = lambda s, k: F.col(f"{s}.{k}").cast("double")
    side = lambda k1, k2: F.greatest(F.least(p(a, k2), p(b, k2)) - F.greatest(p(a, k1), p(b, k1)), F.lit(0.0))
    inter = side("x1", "x2") * side("y1", "y2")
    union = box_area(a) + box_area(b) - inter + eps
    iou = inter / union
    cw = F.greatest(p(a, "x2"), p(b, "x2")) - F.least(p(a, "x1"), p(b, "x1"))
    ch = F.greatest(p(a, "y2"), p(b, "y2")) - F.least(p(a, "y1"), p(b, "y1"))
    hull = cw * ch + eps
    diagonal = cw * cw + ch * ch + eps
    dx, dy = p(b, "x1") + p(b, "x2") - p(a, "x1") - p(a, "x2"), p(b, "y1") + p(b, "y2") - p(a, "y1") - p(a, "y2")
    rho = (dx * dx + dy * dy) / 4
    slope = lambda s: F.atan((p(s, "x2") - p(s, "x1")) / (p(s, "y2") - p(s, "y1") + eps))
    v = (4 / pi**2) * F.pow(slope(b) - slope(a), F.lit(2.0))
    alpha = v / (v - iou + (1 + eps))
    return {"iou": iou, "giou": iou - (hull - union) / hull, "diou": iou - rho / diagonal, "ciou": iou - (rho / diagonal + v * alpha), "ioa": inter / (box_area(b) + eps)}


def clipped(box: dict[str, Column], width, height) -> dict[str, Column]:
    """A box cut to its image."""
    cut = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    return {"x1": cut(box["x1"], width), "y1": cut(box["y1"], height), "x2": cut(box["x2"], width), "y2": cut(box["y2"], height)}


# Fixed value: the longest side, in pixels, that counts in a box's area when boxes suppress each other.
SIDE = 10_000


def suppressed(boxes: DataFrame, image: str, order: list, threshold: float, most: int = 50) -> DataFrame:
    """Greedy non-maximum suppression: per image, the kept of its ``most`` best boxes.

    The cap is the operator's own parameter, so an image's fold is short.  In a
    box's area, sides count ``SIDE`` pixels at most.
    """
    top = boxes.withColumn("_rn", F.row_number().over(W.partitionBy(image).orderBy(F.desc("score"), *order))).where(F.col("_rn") <= most)
    box = F.struct("_rn", "x1", "y1", "x2", "y2", "score")
    lists = top.groupBy(image).agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def iou(a, b):
        side = lambda k1, k2: F.greatest(F.least(a[k2], b[k2]) - F.greatest(a[k1], b[k1]), F.lit(0)).cast("double")
        area = lambda s: (F.least(s["x2"] - s["x1"], F.lit(SIDE)) * F.least(s["y2"] - s["y1"], F.lit(SIDE))).cast("double")
        inter = side("x1", "x2") * side("y1", "y2")
        return inter / (area(a) + area(b) - inter)

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda out, b: F.when(F.exists(out, lambda k: iou(k, b) >= threshold), out).otherwise(F.concat(out, F.array(b))))
    return lists.select(image, F.explode(kept).alias("b")).select(image, "b.x1", "b.y1", "b.x2", "b.y2", "b.score")


def _closed(points: DataFrame, key: str) -> DataFrame:
    """Point rows with the next point, the last one followed by the first."""
    order = W.partitionBy(key).orderBy("seq")
    firsts = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(firsts))
    return points.withColumns({"nx": nxt("x"), "ny": nxt("y")})


def polygon_measures(points: DataFrame, key: str) -> DataFrame:
    """Area, perimeter, circularity, centroid, degree and extent of closed polygons.

    The centroid is the truncated mean of the vertices with the first one
    repeated; ``aspect_ratio`` is the largest x over the largest y, and
    ``aspect_ratio_wh`` width over height.
    """
    closed = _closed(points, key)
    first = lambda c: F.min_by(c, "seq")
    area = F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2
    perimeter = F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    n = F.count("*")
    out = closed.groupBy(key).agg(
        area.alias("area"), perimeter.alias("perimeter"), _int((F.sum("x") + first("x")) / (n + 1)).alias("cx"), _int((F.sum("y") + first("y")) / (n + 1)).alias("cy"),
        (n + 1).alias("degree"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
    )
    ratio = lambda a, b: F.when(b != 0, a / b)
    return out.withColumns(
        {
            "circularity": ratio(4 * pi * F.col("area"), F.col("perimeter") ** 2),
            "aspect_ratio": ratio(F.col("max_x"), F.col("max_y")),
            "aspect_ratio_wh": ratio(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")),
        }
    )


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Vertices of the convex hull, counter-clockwise from the lowest x; points on an edge are none.

    One pass over the sorted points per side; every point is taken off the stack once at most.
    """
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def side(run):
        stack: list[tuple[float, float]] = []
        for p in run:
            while len(stack) > 1 and (stack[-1][0] - stack[-2][0]) * (p[1] - stack[-2][1]) - (stack[-1][1] - stack[-2][1]) * (p[0] - stack[-2][0]) <= 0:
                stack.pop()
            stack.append(p)
        return stack

    return side(ordered)[:-1] + side(reversed(ordered))[:-1]


class Hull(Aggregator):
    """The convex hull of points (x, y); the hull of two sets' hulls is the hull of both.

    Rows with a null coordinate do not count.
    """

    state = result = "x array<double>, y array<double>"

    def reduce(self, rows: pa.Table) -> dict:
        rows = rows.select(["x", "y"]).drop_null()
        ends = rows.group_by("x", use_threads=False).aggregate([("y", "min"), ("y", "max")]).to_pydict()
        found = hull_of([(float(x), float(y)) for x, *both in zip(ends["x"], ends["y_min"], ends["y_max"]) for y in both])
        return {"x": [p[0] for p in found], "y": [p[1] for p in found]}

    def merge(self, states: pa.Table) -> dict:
        found = hull_of([p for x, y in zip(states["x"].to_pylist(), states["y"].to_pylist()) for p in zip(x, y)])
        return {"x": [p[0] for p in found], "y": [p[1] for p in found]}

    def finish(self, state: dict) -> dict:
        return state


def hull_points(points: DataFrame, key: str) -> DataFrame:
    """The hull's vertices of every object (key, x, y), in order round it."""
    hulls = aggregate_by(points.select(key, "x", "y"), [key], Hull())
    return hulls.select(key, F.explode(F.arrays_zip("x", "y")).alias("_p")).select(key, "_p.x", "_p.y")


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """Area of the convex hull: partial hulls of what each task reads, and the hull of these."""
    hulls = aggregate_by(points.select(key, "x", "y"), [key], Hull())
    ahead = lambda c: F.concat(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    cross = F.zip_with(F.arrays_zip("x", "y"), F.arrays_zip(ahead("x").alias("x"), ahead("y").alias("y")), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return hulls.select(key, (F.aggregate(cross, F.lit(0.0), lambda n, v: n + v) / 2).alias("convex_hull"))


def convexity(area: Column, hull: Column) -> dict[str, Column]:
    ratio = F.when(hull > 0, area / hull).otherwise(F.lit(-1.0))
    return {"convexity": ratio, "concavity": F.when(hull > 0, 1 - ratio).otherwise(F.lit(-1.0))}


def axis_box(points: DataFrame, key: str) -> DataFrame:
    """Integer bounding box; a box of n pixels runs from min to min + n."""
    out = points.groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    whole = [F.col(c).cast("long") for c in ("y", "x")] + [(F.col("y") + F.col("h")).cast("long"), (F.col("x") + F.col("w")).cast("long")]
    return out.withColumn("component_id", F.concat_ws("_", F.lit("leaf"), F.concat_ws("-", *[c.cast("string") for c in whole])))


def smallest_box(points: DataFrame, key: str, centre: DataFrame) -> DataFrame:
    """Box with the largest long side over all whole-degree rotations about the centroid.

    ``centre`` has the key, cx and cy.  Rotated points are truncated, as
    pixels are; ties go to the smallest angle.  Truncation keeps the order of
    coordinates, so only the hull's vertices are rotated.
    """
    angle = F.radians(F.col("angle").cast("double"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rotated = hull_points(points, key).join(centre.select(key, "cx", "cy"), key).withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(180))))
    rotated = rotated.select(key, "angle", _int(F.col("cx") + F.cos(angle) * dx - F.sin(angle) * dy).alias("rx"), _int(F.col("cy") + F.sin(angle) * dx + F.cos(angle) * dy).alias("ry"))
    sides = rotated.groupBy(key, "angle").agg((F.max("rx") - F.min("rx") + 1).alias("a"), (F.max("ry") - F.min("ry") + 1).alias("b"))
    best = sides.groupBy(key).agg(F.max(F.struct(F.greatest("a", "b").alias("long"), (-F.col("angle")).alias("turn"), F.least("a", "b").alias("short"))).alias("m"))
    return best.select(key, F.col("m.long").alias("long_side"), F.col("m.short").alias("short_side"), (-F.col("m.turn")).alias("angle"))


def rotated_points(points: DataFrame, degrees: float, cx: Column, cy: Column) -> DataFrame:
    """Points turned about a centre, truncated."""
    a = F.radians(F.lit(float(degrees)))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return points.withColumns({"rx": _int(cx + F.cos(a) * dx - F.sin(a) * dy), "ry": _int(cy + F.sin(a) * dx + F.cos(a) * dy)})


def path_lengths(points: DataFrame, key: str) -> DataFrame:
    """Plain length of ordered points, and the length without outlying segments.

    With more than two points, segments of at least half the plain length do
    not count.
    """
    order = W.partitionBy(key).orderBy("seq")
    segments = points.withColumn("segment", F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)))
    whole = W.partitionBy(key)
    segments = segments.withColumns({"_total": F.sum("segment").over(whole), "_n": F.count("*").over(whole)})
    counted = F.when((F.col("_n") <= 2) | (F.col("segment") < F.col("_total") / 2), F.col("segment"))
    return segments.groupBy(key).agg(F.coalesce(F.sum("segment"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(counted), F.lit(0.0)).alias("length"))


def arc_length(points: DataFrame, key: str) -> DataFrame:
    """Cumulative length ``t`` along a closed contour, at each segment's end, with dx, dy, dt."""
    closed = _closed(points, key).withColumns({"dx": F.col("nx") - F.col("x"), "dy": F.col("ny") - F.col("y")})
    dt = F.hypot("dx", "dy")
    closed = closed.withColumn("dt", F.when(dt == 0, F.lit(1e-9)).otherwise(dt))
    return closed.withColumn("t", F.sum("dt").over(W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def fourier_descriptors(points: DataFrame, key: str, order: int = 40) -> DataFrame:
    """Elliptic Fourier coefficients (key, harmonic, a, b, c, d) of closed contours.

    A segment's terms depend only on its ends on the arc, so every (segment,
    harmonic) pair is one row and the coefficients are one aggregation.
    """
    arcs = arc_length(points, key).withColumn("period", F.max("t").over(W.partitionBy(key)))
    rows = arcs.withColumn("harmonic", F.explode(F.sequence(F.lit(1), F.lit(order))))
    phase = lambda t: 2 * pi * F.col("harmonic") * t / F.col("period")
    cosine = F.cos(phase(F.col("t"))) - F.cos(phase(F.col("t") - F.col("dt")))
    sine = F.sin(phase(F.col("t"))) - F.sin(phase(F.col("t") - F.col("dt")))
    scale = F.first("period") / (2 * F.col("harmonic") * F.col("harmonic") * pi**2)
    term = lambda d, wave: F.sum(F.col(d) / F.col("dt") * wave)
    sums = rows.groupBy(key, "harmonic").agg(term("dx", cosine).alias("a"), term("dx", sine).alias("b"), term("dy", cosine).alias("c"), term("dy", sine).alias("d"), F.first("period").alias("period"))
    scale = F.col("period") / (2 * F.col("harmonic") * F.col("harmonic") * pi**2)
    return sums.select(key, "harmonic", *[(F.col(c) * scale).alias(c) for c in "abcd"])


def normalised_descriptors(coefficients: DataFrame, key: str) -> DataFrame:
    """Coefficients without starting phase, rotation and size, from the first harmonic."""
    one = coefficients.where("harmonic = 1").select(key, *[F.col(c).alias(c + "1") for c in "abcd"])
    a, b, c, d = (F.col(k + "1") for k in "abcd")
    theta = 0.5 * F.atan2(2 * (a * b + c * d), a * a - b * b + c * c - d * d)
    one = one.withColumn("theta", theta)
    sx, sy = a * F.cos("theta") + b * F.sin("theta"), c * F.cos("theta") + d * F.sin("theta")
    one = one.withColumns({"psi": F.atan2(sy, sx), "size": F.hypot(sx, sy)}).select(key, "theta", "psi", "size")
    rows = coefficients.join(one, key)
    n = F.col("harmonic") * F.col("theta")
    turned = {
        "a_": F.col("a") * F.cos(n) + F.col("b") * F.sin(n), "b_": -F.col("a") * F.sin(n) + F.col("b") * F.cos(n),
        "c_": F.col("c") * F.cos(n) + F.col("d") * F.sin(n), "d_": -F.col("c") * F.sin(n) + F.col("d") * F.cos(n),
    }
    rows = rows.withColumns(turned)
    cos, sin = F.cos("psi"), F.sin("psi")
    final = {"a": cos * F.col("a_") + sin * F.col("c_"), "b": cos * F.col("b_") + sin * F.col("d_"), "c": -sin * F.col("a_") + cos * F.col("c_"), "d": -sin * F.col("b_") + cos * F.col("d_")}
    return rows.select(key, "harmonic", *[F.when(F.col("size") > 0, v / F.col("size")).alias(k) for k, v in final.items()])


def dc_coefficients(points: DataFrame, key: str) -> DataFrame:
    """Constant terms A0 and C0 of a contour's Fourier series, relative to its first point."""
    arcs = arc_length(points, key)
    upto = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    t0 = F.col("t") - F.col("dt")

    def constant(d: str, name: str):
        slope = F.col(d) / F.col("dt")
        xi = F.sum(d).over(upto) - slope * F.col("t")
        return (slope / 2 * (F.col("t") ** 2 - t0**2) + xi * F.col("dt")).alias(name)

    terms = arcs.select(key, "t", "seq", "x", "y", constant("dx", "ka"), constant("dy", "kc"))
    return terms.groupBy(key).agg((F.sum("ka") / F.max("t") + F.min_by("x", "seq")).alias("a0"), (F.sum("kc") / F.max("t") + F.min_by("y", "seq")).alias("c0"))


def reconstructed(coefficients: DataFrame, dc: DataFrame, key: str, samples: int = 300) -> DataFrame:
    """Contour points that the coefficients describe (key, step, x, y), truncated."""
    rows = coefficients.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    phase = 2 * pi * F.col("harmonic") * F.col("step") / F.lit(float(samples - 1))
    sums = rows.groupBy(key, "step").agg(F.sum(F.col("a") * F.cos(phase) + F.col("b") * F.sin(phase)).alias("sx"), F.sum(F.col("c") * F.cos(phase) + F.col("d") * F.sin(phase)).alias("sy"))
    return sums.join(dc, key).select(key, "step", (F.col("sx") + F.col("a0")).alias("x"), (F.col("sy") + F.col("c0")).alias("y"))


def angle_at(px, py, qx, qy, rx, ry) -> Column:
    """Angle at q between p and r in degrees; 0 for a vector without length."""
    ux, uy, vx, vy = px - qx, py - qy, rx - qx, ry - qy
    cosine = (ux * vx + uy * vy) / F.greatest(F.hypot(ux, uy) * F.hypot(vx, vy), F.lit(1e-9))
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def reflexed(angle: Column, towards: Column) -> Column:
    """The reflex form where the opening points away from the midvein."""
    return F.when(towards, 360 - angle).otherwise(angle)


def line_fit(points: DataFrame, key: str) -> DataFrame:
    """Least-squares line of y over x; null slope for a vertical set."""
    return points.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def quadratic_fit(points: DataFrame, key: str) -> DataFrame:
    """Least-squares parabola y = p2 x^2 + p1 x + p0 from centred normal-equation sums."""
    means = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-9)).alias("sx"))
    rows = points.join(means, key).withColumns({"u": (F.col("x") - F.col("mx")) / F.col("sx"), "v": F.col("y") - F.col("my")})
    u, v = F.col("u"), F.col("v")
    s = rows.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("sx").alias("sx"))
    # sums of u and v vanish, so the system for (q2, q1) is two by two
    k22 = F.col("s4") - F.col("s2") ** 2 / F.col("n")
    det = k22 * F.col("s2") - F.col("s3") ** 2
    q2 = F.when(F.abs(det) > 1e-12, (F.col("t2") * F.col("s2") - F.col("t1") * F.col("s3")) / det)
    q1 = F.when(F.abs(det) > 1e-12, (k22 * F.col("t1") - F.col("s3") * F.col("t2")) / det)
    s = s.withColumns({"q2": q2, "q1": q1}).withColumn("q0", F.col("my") - F.col("q2") * F.col("s2") / F.col("n"))
    return s.select(
        key, (F.col("q2") / F.col("sx") ** 2).alias("p2"), (F.col("q1") / F.col("sx") - 2 * F.col("q2") * F.col("mx") / F.col("sx") ** 2).alias("p1"),
        (F.col("q0") - F.col("q1") * F.col("mx") / F.col("sx") + F.col("q2") * F.col("mx") ** 2 / F.col("sx") ** 2).alias("p0"),
    )


def resampled(points: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` points at equal arc length along each open trace (key, step, x, y)."""
    order = W.partitionBy(key).orderBy("seq")
    rows = points.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    rows = rows.withColumn("dt", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))
    rows = rows.withColumns({"t": F.sum("dt").over(order.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("dt").over(W.partitionBy(key))})
    lo = F.when(F.col("px").isNull(), F.lit(-1)).otherwise(F.floor(F.round((F.col("t") - F.col("dt")) / F.col("total") * (n - 1), 9)))
    hi = F.floor(F.round(F.col("t") / F.col("total") * (n - 1), 9))
    steps = rows.where(F.col("total") > 0).withColumn("step", F.explode(F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<bigint>"))))
    share = F.when(F.col("dt") > 0, (F.col("step") * F.col("total") / (n - 1) - F.col("t") + F.col("dt")) / F.col("dt")).otherwise(F.lit(1.0))
    mixed = lambda a, b: F.coalesce(F.col(a) + share * (F.col(b) - F.col(a)), F.col(b))
    return steps.select(key, "step", mixed("px", "x").alias("x"), mixed("py", "y").alias("y"))


def curvature(points: DataFrame, key: str) -> DataFrame:
    """Curvature 4A/(abc) at every inner point of a trace."""
    order = W.partitionBy(key).orderBy("seq")
    rows = points.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order), "nx": F.lead("x").over(order), "ny": F.lead("y").over(order)}).where("px is not null and nx is not null")
    a = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    b = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    c = F.hypot(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    area = F.abs((F.col("x") - F.col("px")) * (F.col("ny") - F.col("py")) - (F.col("nx") - F.col("px")) * (F.col("y") - F.col("py"))) / 2
    return rows.select(key, "seq", F.when(a * b * c > 0, 4 * area / (a * b * c)).otherwise(F.lit(0.0)).alias("curvature"))


def rolled(points: DataFrame, key: str) -> DataFrame:
    """Contours that start at their top-most point, with y flipped."""
    start = points.groupBy(key).agg(F.min(F.struct("y", "seq"))["seq"].alias("_start"), F.count("*").alias("_n"), F.max("y").alias("_top"))
    rows = points.join(start, key)
    return rows.select(key, F.pmod(F.col("seq") - F.col("_start"), F.col("_n")).alias("seq"), "x", (F.col("_top") - F.col("y")).alias("y"))


def oriented(points: DataFrame, key: str, x: float, y: float) -> DataFrame:
    """Traces reversed where their last point is nearer the reference than their first."""
    d = F.hypot(F.col("x") - F.lit(x), F.col("y") - F.lit(y))
    ends = points.groupBy(key).agg(F.min_by(d, "seq").alias("_first"), F.max_by(d, "seq").alias("_last"), F.max("seq").alias("_n"))
    rows = points.join(ends, key)
    return rows.select(key, F.when(F.col("_last") < F.col("_first"), F.col("_n") - F.col("seq")).otherwise(F.col("seq")).alias("seq"), "x", "y")


def normalised_contour(points: DataFrame, key: str) -> DataFrame:
    """Contours shifted to the origin, scaled by the larger extent and centred on their mean."""
    ends = points.groupBy(key).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_e"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    rows = points.join(ends, key)
    return rows.select(key, "seq", ((F.col("x") - F.col("_mx")) / F.col("_e")).alias("x"), ((F.col("y") - F.col("_my")) / F.col("_e")).alias("y"))


def clockwise(points: DataFrame, key: str) -> DataFrame:
    return _closed(points, key).groupBy(key).agg((F.sum((F.col("nx") - F.col("x")) * (F.col("ny") + F.col("y"))) > 0).alias("clockwise"))


def angular_order(points: DataFrame, key: str) -> DataFrame:
    """Points numbered by their direction from the object's mean."""
    means = points.groupBy(key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    rows = points.join(means, key).withColumn("_a", F.round(F.atan2(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")), 9))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_a", "seq"))).drop("_a", "_mx", "_my")


def side_of_line(slope: Column, intercept: Column, x: Column, y: Column, portrait: Column, centre_y: Column) -> Column:
    """Left or right of a fitted line: by x in portrait, by y about the centre in landscape."""
    flat = F.abs(slope) < 1e-14
    at = (y - intercept) / F.when(flat, F.lit(1e-14)).otherwise(slope)
    return F.when(portrait, F.when(x < at, "left").otherwise("right")).otherwise(F.when(y < centre_y, "left").otherwise("right"))


def best_polygon(polygons: DataFrame, key: str) -> DataFrame:
    """The polygon of each key with most vertices, ties by area."""
    pick = F.struct("degree", "area", (-F.col("polygon")).alias("p"))
    return polygons.groupBy(key).agg(F.max(pick).alias("m")).select(key, (-F.col("m.p")).alias("polygon"), "m.degree", "m.area")
