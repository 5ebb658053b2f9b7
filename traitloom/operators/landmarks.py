"""Landmarks of leaves: flags, completeness, lengths and widths, from labelled point rows.

Point rows have leaf, kind, x and y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.geometry import line_fit, quadratic_fit
from traitloom.operators.linkage import chosen_pair

# Landmark kinds in class-index order.
KINDS = ("apex_angle", "base_angle", "lamina_base", "lamina_tip", "lamina_width", "lobe_tip", "midvein_trace", "petiole_tip", "petiole_trace")
# Slots of a keypoint label line, by name.
SLOT_LINE = ("lamina_tip", "apex_left", "apex_center", "apex_right", "midvein_0", "midvein_1", "midvein_2", "base_left", "base_center", "base_right", "lamina_base", "petiole_tip", "width_left", "width_right")

# The slots that a kind's points take, in their order; a lobe tip has none.
SLOTS_OF_KIND = {
    "lamina_tip": ("lamina_tip",),
    "apex_angle": ("apex_left", "apex_center", "apex_right"),
    "midvein_trace": tuple(f"midvein_{i}" for i in range(15)),
    "base_angle": ("base_left", "base_center", "base_right"),
    "lamina_base": ("lamina_base",),
    "petiole_trace": tuple(f"petiole_{i}" for i in range(5)),
    "petiole_tip": ("petiole_tip",),
    "lamina_width": ("width_left", "width_right"),
}
# The 31 slots of a line with 15 midvein and 5 petiole points.
SLOT_LINE_31 = tuple(slot for slots in SLOTS_OF_KIND.values() for slot in slots)
# The same with 30 midvein and 10 petiole points, 51 slots.
SLOTS_OF_KIND_51 = SLOTS_OF_KIND | {"midvein_trace": tuple(f"midvein_{i}" for i in range(30)), "petiole_trace": tuple(f"petiole_{i}" for i in range(10))}
SLOT_LINE_51 = tuple(slot for slots in SLOTS_OF_KIND_51.values() for slot in slots)


def presence(points: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Counts per kind, presence flags, lobe count and completeness of every leaf."""
    out = points.groupBy(leaf).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    has = lambda k: F.col(f"n_{k}") > 0
    whole = has("apex_angle") & has("base_angle") & has("petiole_trace") & has("midvein_trace")
    status = F.when(whole & has("lamina_width"), "complete_leaf").when(whole, "leaf_no_width").otherwise("incomplete")
    flags = {f"has_{k}": has(k) for k in ("apex_angle", "base_angle", "lamina_tip", "lamina_base", "midvein_trace", "lamina_width")}
    return out.withColumns(flags | {"lobe_count": F.col("n_lobe_tip"), "status": status})


def lamina_length(tip: str = "tip", base: str = "base", apex: str = "apex", base_centre: str = "base_centre") -> Column:
    """Distance from base to tip; a missing end is replaced by its angle's centre (point structs)."""
    top, bottom = F.coalesce(tip, apex), F.coalesce(base, base_centre)
    return F.hypot(top["x"] - bottom["x"], top["y"] - bottom["y"])


def lamina_width(points: DataFrame, sides: DataFrame, midveins: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Width of each leaf between a left and a right width point (leaf, lx, ly, rx, ry, width).

    ``points`` are the width points, ``sides`` has leaf, seq and side of the
    midvein or, without one, of the lamina's axis; ``midveins`` has the leaves
    with a midvein.  These take the pair with the largest ``|dx + dy|``, others
    the shortest.  A leaf without points on both sides is left out.
    """
    rows = points.join(sides, [leaf, "seq"])
    left, right = (rows.where(F.col("side") == side).select(leaf, "x", "y") for side in ("left", "right"))
    known = midveins.select(leaf).distinct()
    slanted = chosen_pair(left.join(known, leaf, "left_semi"), right, leaf, mode="slanted")
    shortest = chosen_pair(left.join(known, leaf, "left_anti"), right, leaf)
    both = slanted.unionByName(shortest).withColumnsRenamed({"x1": "lx", "y1": "ly", "x2": "rx", "y2": "ry"})
    return both.withColumn("width", F.hypot(F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")))


def label_measurements(points: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Label-side measures of every leaf, 0 where its points are absent.

    Lengths: lamina (first tip to first base), width (first two width points),
    petiole (first base to petiole tip), and the traces of midvein and petiole.
    Angles at the second of the first three points: apex, base, deepest sinus.
    """
    from traitloom.operators.geometry import angle_at

    line = W.partitionBy(leaf, "kind").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line))
    rows = points.withColumns({"_nth": F.row_number().over(line), "_step": step})
    at = lambda kind, n, c: F.max(F.when((F.col("kind") == kind) & (F.col("_nth") == n), F.col(c)))
    point = lambda kind, n: (at(kind, n, "x"), at(kind, n, "y"))
    between = lambda p, q: F.coalesce(F.hypot(p[0] - q[0], p[1] - q[1]), F.lit(0.0))
    trace = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_step"))), F.lit(0.0))
    angle = lambda kind: F.coalesce(F.when(at(kind, 3, "x").isNotNull(), angle_at(*point(kind, 1), *point(kind, 2), *point(kind, 3))), F.lit(0.0))
    tip, base = point("lamina_tip", 1), point("lamina_base", 1)
    return rows.groupBy(leaf).agg(
        between(tip, base).alias("lamina_length"), between(point("lamina_width", 1), point("lamina_width", 2)).alias("lamina_width"),
        between(base, point("petiole_tip", 1)).alias("petiole_length"), trace("midvein_trace").alias("midvein_length"), trace("petiole_trace").alias("petiole_trace_length"),
        angle("apex_angle").alias("apex_angle"), angle("base_angle").alias("base_angle"), angle("deepest_sinus_angle").alias("deepest_sinus_angle"),
    )


def angle_points(points: DataFrame, sides: DataFrame, tips: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Centre, left and right point of an angle: nearest to the tip, and farthest from that on either side.

    ``sides`` has leaf, seq and side; ``tips`` leaf, tip_x and tip_y.  An angle
    without both sides is left out.
    """
    rows = points.join(tips, leaf).join(sides, [leaf, "seq"])
    centre = rows.groupBy(leaf).agg(F.min(F.struct(F.hypot(F.col("x") - F.col("tip_x"), F.col("y") - F.col("tip_y")).alias("d"), "seq", "x", "y")).alias("c"))
    far = F.hypot(F.col("x") - F.col("c.x"), F.col("y") - F.col("c.y"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.struct(far.alias("d"), "seq", "x", "y")))
    ends = rows.join(centre, leaf).groupBy(leaf).agg(F.first("c").alias("c"), pick("left").alias("l"), pick("right").alias("r"))
    return ends.where("l is not null and r is not null").select(leaf, *[F.col(f"{p}.{k}").alias(f"{p}{k}") for p in "clr" for k in "xy"])


def tip_choice(candidates: DataFrame, midveins: DataFrame, leaf: str = "leaf") -> DataFrame:
    """The candidate tip of each leaf that is nearest to a midvein point."""
    pairs = candidates.select(leaf, "seq", "x", "y").join(midveins.select(leaf, F.col("x").alias("mx"), F.col("y").alias("my")), leaf)
    near = F.min(F.struct(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")).alias("d"), "seq", "x", "y"))
    return pairs.groupBy(leaf).agg(near.alias("t")).select(leaf, "t.seq", "t.x", "t.y")


def to_sheet(points: DataFrame, name: str = "component_name") -> DataFrame:
    """Points of a crop in coordinates of its sheet, by the offsets in the crop's name."""
    corners = F.split(F.get(F.split(name, "__"), F.lit(2)), "-")
    shift = lambda i: F.get(corners, F.lit(i)).try_cast("double")
    return points.withColumns({"sheet_x": F.col("x") + shift(0), "sheet_y": F.col("y") + shift(1)})


def slotted(points: DataFrame, leaf: str = "leaf", slots_of_kind: dict[str, tuple[str, ...]] = SLOTS_OF_KIND) -> DataFrame:
    """Points with their kind replaced by its slot, by order of seq within the kind; points beyond a kind's slots are left out."""
    nth = F.row_number().over(W.partitionBy(leaf, "kind").orderBy("seq")) - 1
    slots = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(s) for s in names])) for k, names in slots_of_kind.items()])
    return points.withColumn("_nth", nth).withColumn("kind", F.get(slots, F.col("_nth"))).drop("_nth").where("kind is not null")


def keypoint_lines(points: DataFrame, leaves: DataFrame, slots: tuple[str, ...] = SLOT_LINE, leaf: str = "leaf") -> DataFrame:
    """One label line per leaf: x, y and flag of every slot; missing slots are zeros."""
    grid = leaves.select(leaf).withColumn("_slot", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(slots)])))
    given = points.groupBy(leaf, F.col("kind").alias("_name")).agg(F.min(F.struct("seq", "x", "y")).alias("_p"))
    rows = grid.join(given, [grid[leaf] == given[leaf], F.col("_slot.name") == F.col("_name")], "left").select(grid[leaf], "_slot.i", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    cell = F.concat_ws(" ", F.coalesce(F.col("x").cast("long"), F.lit(0)), F.coalesce(F.col("y").cast("long"), F.lit(0)), F.when(F.col("x").isNotNull(), 2).otherwise(0))
    return rows.groupBy(leaf).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("cell")))), lambda s: s["cell"]), " ").alias("line"))


def training_box(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised box around a point, by image size: 27, 15 or 9 pixels; centres outside are reflected."""
    side = F.when(F.greatest(width, height) > 2000, 27).when(F.greatest(width, height) > 1000, 15).otherwise(9)
    into = lambda c: F.when(c < 0, -c).when(c > 1, 2 - c).otherwise(c)
    return {"xc": into(x / width), "yc": into(y / height), "w": side / width, "h": side / height}


def signed_angle(left: list[Column], inner_left: list[Column], inner_right: list[Column], right: list[Column]) -> Column:
    """Angle between the outer arms of four points; negative where the interior angles sum below 180 degrees."""
    from traitloom.operators.geometry import angle_at

    outer = angle_at(left[0], left[1], (inner_left[0] + inner_right[0]) / 2, (inner_left[1] + inner_right[1]) / 2, right[0], right[1])
    inside = angle_at(*left, *inner_left, *inner_right) + angle_at(*inner_left, *inner_right, *right)
    return F.when(inside < 180, -outer).otherwise(outer)


def prickle_traits(curves: DataFrame, key: str = "obj") -> DataFrame:
    """Base width, direct length and curl of a three-point prickle (base left, base right, tip and mid-curve)."""
    mid = lambda k: (F.col(f"l{k}") + F.col(f"r{k}")) / 2
    width = F.hypot(F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly"))
    length = F.hypot(F.col("tx") - mid("x"), F.col("ty") - mid("y"))
    slope = lambda ax, ay, bx, by: F.degrees(F.atan2(by - ay, bx - ax))
    curl = F.abs(slope(mid("x"), mid("y"), F.col("mx"), F.col("my")) - slope(F.col("mx"), F.col("my"), F.col("tx"), F.col("ty")))
    return curves.select(key, width.alias("base_width"), length.alias("direct_length"), F.least(curl, 360 - curl).alias("curl"))


def nearer_root(a: Column, b: Column, c: Column) -> Column:
    """The real root of ax^2 + bx + c with the smaller absolute value, the positive one of two alike; null without one."""
    d = b * b - 4 * a * c
    q = -(b + F.when(b < 0, -F.sqrt(d)).otherwise(F.sqrt(d))) / 2
    return F.when(d >= 0, F.when(q != 0, F.when(b == 0, F.abs(c / q)).otherwise(c / q)).when(c == 0, F.lit(0.0)))


def armature_traits(points: DataFrame, key: str = "obj") -> DataFrame:
    """Base width, direct length, curl, tangent angle and base crossing of armatures.

    ``points`` has ``part`` (outer or middle), seq, x and y; the first middle
    point is the tip.  Outer points above the middle parabola are its right
    side, the others its left.  The base joins both sides' last points; the
    direct length is the tip's distance from it, the curl the angle between its
    perpendicular and the line of the first three middle points.  The tangent
    angle is taken where the parabolas of both sides cross, and the base meets
    the middle parabola at (base_x, base_y); of two roots the one nearer to 0
    counts.  Sides of under three points give nulls; so does a missing root.
    """
    middle, outer = points.where("part = 'middle'"), points.where("part = 'outer'")
    curve = quadratic_fit(middle, key).select(key, *[F.col(f"p{i}").alias(f"m{i}") for i in range(3)])
    above = F.col("y") > F.col("m2") * F.col("x") ** 2 + F.col("m1") * F.col("x") + F.col("m0")
    sides = outer.join(curve, key).withColumn("side", F.when(above, "r").otherwise("l"))
    rows = middle.select(key).distinct().join(curve, key, "left")
    for side in "lr":
        mine = sides.where(F.col("side") == side).select(key, "seq", "x", "y")
        last = mine.groupBy(key).agg(F.max_by(F.struct("x", "y"), "seq").alias("e"), F.count("*").alias("n")).where("n >= 3")
        fit = quadratic_fit(mine, key).select(key, *[F.col(f"p{i}").alias(f"{side}{i}") for i in range(3)])
        rows = rows.join(last.select(key, F.col("e.x").alias(f"{side}x"), F.col("e.y").alias(f"{side}y")).join(fit, key), key, "left")
    first = middle.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where("_nth <= 3")
    tip = first.groupBy(key).agg(F.min_by("x", "seq").alias("tx"), F.min_by("y", "seq").alias("ty"))
    rows = rows.join(tip, key, "left").join(line_fit(first, key).select(key, F.col("slope").alias("m")), key, "left")

    dx, dy = F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")
    width = F.hypot(dx, dy)
    length = F.when(width > 0, F.abs(dx * (F.col("ly") - F.col("ty")) - (F.col("lx") - F.col("tx")) * dy) / width)
    curl = F.degrees(F.atan2(F.abs(dx + dy * F.col("m")), F.abs(dx * F.col("m") - dy)))
    cross = nearer_root(*[F.col(f"l{i}") - F.col(f"r{i}") for i in (2, 1, 0)])
    left, right = (2 * F.col(f"{s}2") * F.col("_cross") + F.col(f"{s}1") for s in "lr")
    tangent = F.degrees(F.atan2(F.abs(right - left), F.abs(1 + left * right)))
    slope = F.when(dx != 0, dy / dx)
    base = nearer_root(F.col("m2"), F.col("m1") - slope, F.col("m0") - F.col("ly") + slope * F.col("lx"))
    rows = rows.withColumns({"_cross": cross, "base_x": base})
    return rows.select(
        key, width.alias("base_width"), length.alias("direct_length"), F.when(width > 0, curl).alias("angle_curl"), tangent.alias("angle_tangent"),
        "base_x", (F.col("ly") + slope * (F.col("base_x") - F.col("lx"))).alias("base_y"),
    )
