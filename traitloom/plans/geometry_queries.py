"""Geometry and measurement functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from traitloom.operators import geometry as G

from ._register import Registry
from .linkage_queries import _POINTS, points
from .views import read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_BOX = ("xc", "yc", "w", "h")


@R.add("SELECT filename, l_linenumber, x1, y1, x2, y2 FROM pixel_boxes", ("pixel_boxes",))
def fn01_pixel_box(spark, sf_dir):
    box = G.pixel_box(*[F.col(c) for c in _BOX], 1000, 1000)
    return view(spark, sf_dir, "detections").select("filename", "l_linenumber", *[c.alias(k) for k, c in box.items()])


@R.add("SELECT filename, l_linenumber, (x1 + x2) / 2.0::DOUBLE / 1000 AS xc, (y1 + y2) / 2.0::DOUBLE / 1000 AS yc, (x2 - x1) / 1000.0::DOUBLE AS w, (y2 - y1) / 1000.0::DOUBLE AS h FROM pixel_boxes", ("pixel_boxes",))
def fn02_normalised_box(spark, sf_dir):
    box = G.normalised_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 1000, 1000)
    return view(spark, sf_dir, "pixel_boxes").select("filename", "l_linenumber", *[c.alias(k) for k, c in box.items()])


@R.add("SELECT filename, l_linenumber, CAST(trunc((x1 + x2) / 2.0::DOUBLE) AS BIGINT) AS cx, CAST(trunc((y1 + y2) / 2.0::DOUBLE) AS BIGINT) AS cy FROM pixel_boxes", ("pixel_boxes",))
def fn03_box_centre(spark, sf_dir):
    centre = G.box_centre(*[F.col(c) for c in _BOX], 1000, 1000)
    return view(spark, sf_dir, "detections").select("filename", "l_linenumber", *[c.alias(k) for k, c in centre.items()])


_PAIRS = """pairs AS (SELECT a.filename, a.l_partkey AS pa, b.l_partkey AS pb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM (SELECT * FROM pixel_boxes WHERE l_linenumber % 2 = 1) a JOIN (SELECT * FROM pixel_boxes WHERE l_linenumber % 2 = 0) b USING (filename)),
  m AS (SELECT *, CAST(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS DOUBLE) AS i, CAST((ax2 - ax1) * (ay2 - ay1) AS DOUBLE) AS sa, CAST((bx2 - bx1) * (by2 - by1) AS DOUBLE) AS sb,
    CAST(greatest(ax2, bx2) - least(ax1, bx1) AS DOUBLE) AS cw, CAST(greatest(ay2, by2) - least(ay1, by1) AS DOUBLE) AS ch,
    CAST((bx1 + bx2 - ax1 - ax2) ** 2 + (by1 + by2 - ay1 - ay2) ** 2 AS DOUBLE) / 4 AS rho,
    4 / pi() ** 2 * (atan((bx2 - bx1) / (by2 - by1 + 1e-7)) - atan((ax2 - ax1) / (ay2 - ay1 + 1e-7))) ** 2 AS v FROM pairs),
  o AS (SELECT *, i / (sa + sb - i + 1e-7) AS iou FROM m)"""


def box_pairs(spark, sf_dir):
    """Odd-numbered boxes beside the even-numbered ones of the same sheet."""
    boxes = view(spark, sf_dir, "pixel_boxes")
    box = F.struct("x1", "y1", "x2", "y2")
    one = boxes.where("l_linenumber % 2 = 1").select("filename", F.col("l_partkey").alias("pa"), box.alias("a"))
    two = boxes.where("l_linenumber % 2 = 0").select("filename", F.col("l_partkey").alias("pb"), box.alias("b"))
    return one.join(two, "filename")


@R.add(f", {_PAIRS} SELECT filename, pa, pb, round(iou, 6) + 0.0::DOUBLE AS iou, round(iou - (cw * ch + 1e-7 - (sa + sb - i + 1e-7)) / (cw * ch + 1e-7), 6) + 0.0::DOUBLE AS giou, round(iou - rho / (cw * cw + ch * ch + 1e-7), 6) + 0.0::DOUBLE AS diou,"
       " round(iou - (rho / (cw * cw + ch * ch + 1e-7) + v * v / (v - iou + (1 + 1e-7))), 6) + 0.0::DOUBLE AS ciou, round(i / (sb + 1e-7), 6) + 0.0::DOUBLE AS ioa FROM o", ("pixel_boxes",))
def fn04_overlaps(spark, sf_dir):
    out = box_pairs(spark, sf_dir).select("filename", "pa", "pb", *[(F.round(c, 6) + F.lit(0.0)).alias(k) for k, c in G.overlaps("a", "b").items()])
    return out


_MET = "list_transform(w.kept, lambda k: {'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2, 'i': CAST(greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0) AS DOUBLE)})"


# the kept boxes of an image walk along its boxes by rank
@R.add(f""", b AS (SELECT filename, x1, y1, x2, y2, score, row_number() OVER (PARTITION BY filename ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM pixel_boxes)
  SELECT filename, s.x1, s.y1, s.x2, s.y2, b.score FROM (WITH RECURSIVE w(filename, rn, kept) AS (
      SELECT filename, 1::BIGINT, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'rn': rn}}] FROM b WHERE rn = 1
      UNION ALL SELECT r.filename, r.rn, CASE WHEN len(list_filter({_MET}, lambda k: k.i / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - k.i) >= 0.3)) = 0
        THEN list_append(w.kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'rn': r.rn}}) ELSE w.kept END
      FROM w JOIN b r ON r.filename = w.filename AND r.rn = w.rn + 1 WHERE r.rn <= 50)
    SELECT filename, unnest(arg_max(kept, rn)) AS s FROM w GROUP BY filename) JOIN b USING (filename) WHERE b.rn = s.rn""", ("pixel_boxes",))
def fn05_suppressed(spark, sf_dir):
    return G.suppressed(view(spark, sf_dir, "pixel_boxes"), "filename", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], 0.3)


_CLOSED = f"""{_POINTS}, c AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY component ORDER BY seq))"""


@R.add(f"""WITH {_CLOSED}, m AS (SELECT component, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) AS perimeter, CAST(trunc((sum(x) + min_by(x, seq)) / (count(*) + 1)) AS BIGINT) AS cx,
    CAST(trunc((sum(y) + min_by(y, seq)) / (count(*) + 1)) AS BIGINT) AS cy, count(*) + 1 AS degree, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM c GROUP BY component)
  SELECT component, round(area, 4) AS area, round(perimeter, 4) AS perimeter, cx, cy, degree, min_x, min_y, max_x, max_y, round(CASE WHEN perimeter ** 2 <> 0 THEN 4 * pi() * area / perimeter ** 2 END, 6) AS circularity,
    round(CASE WHEN max_y <> 0 THEN max_x / max_y END, 6) AS aspect_ratio, round(CASE WHEN max_y - min_y <> 0 THEN (max_x - min_x) / (max_y - min_y) END, 6) AS aspect_ratio_wh FROM m""")
def fn06_polygon_measures(spark, sf_dir):
    out = G.polygon_measures(points(spark, sf_dir), "component")
    return _rounded(_rounded(out, "area", "perimeter", digits=4), "circularity", "aspect_ratio", "aspect_ratio_wh")


# a hull edge has all points on its left; of edges in one direction the longest is the whole one
@R.add(f"""WITH {_CLOSED}, u AS (SELECT DISTINCT component, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM p),
  e AS (SELECT a.component, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM u a JOIN u b ON a.component = b.component AND (a.x <> b.x OR a.y <> b.y)
    WHERE NOT EXISTS (SELECT 1 FROM u c WHERE c.component = a.component AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
  h AS (SELECT component, arg_max(ax * byy - bx * ay, abs(bx - ax) + abs(byy - ay)) AS part FROM e GROUP BY component, (bx - ax) // gcd(bx - ax, byy - ay), (byy - ay) // gcd(bx - ax, byy - ay)),
  hull AS (SELECT component, CAST(sum(part) AS DOUBLE) / 2 AS convex_hull FROM h GROUP BY component), m AS (SELECT component, abs(sum(x * ny - nx * y)) / 2 AS area FROM c GROUP BY component)
  SELECT component, round(convex_hull, 4) AS convex_hull, round(CASE WHEN convex_hull > 0 THEN area / convex_hull ELSE -1 END, 6) AS convexity, round(CASE WHEN convex_hull > 0 THEN 1 - area / convex_hull ELSE -1 END, 6) AS concavity FROM hull JOIN m USING (component)""")
def fn07_convex_hull(spark, sf_dir):
    shapes = points(spark, sf_dir)
    both = G.convex_hulls(shapes, "component").join(G.polygon_measures(shapes, "component").select("component", "area"), "component")
    ratios = G.convexity(F.col("area"), F.col("convex_hull"))
    return both.select("component", F.round("convex_hull", 4).alias("convex_hull"), *[F.round(c, 6).alias(k) for k, c in ratios.items()])


@R.add("""SELECT component, round(CASE WHEN convex_hull > 0 THEN area / convex_hull ELSE -1 END, 6) AS convexity, round(CASE WHEN convex_hull > 0 THEN 1 - area / convex_hull ELSE -1 END, 6) AS concavity FROM measurements""", ("measurements",))
def fn07_convexity(spark, sf_dir):
    ratios = G.convexity(F.col("area"), F.col("convex_hull"))
    return view(spark, sf_dir, "measurements").select("component", *[F.round(c, 6).alias(k) for k, c in ratios.items()])


@R.add(f"""WITH {_POINTS} SELECT component, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h,
  'leaf_' || CAST(min(y) AS BIGINT) || '-' || CAST(min(x) AS BIGINT) || '-' || CAST(max(y) + 1 AS BIGINT) || '-' || CAST(max(x) + 1 AS BIGINT) AS component_id FROM p GROUP BY component""")
def fn10_axis_box(spark, sf_dir):
    return G.axis_box(points(spark, sf_dir), "component")


@R.add(f"""WITH {_POINTS}, ce AS (SELECT component, trunc((sum(x) + min_by(x, seq)) / (count(*) + 1)) AS cx, trunc((sum(y) + min_by(y, seq)) / (count(*) + 1)) AS cy FROM p GROUP BY component),
  r AS (SELECT component, g, trunc(cx + cos(radians(g)) * (x - cx) - sin(radians(g)) * (y - cy)) AS rx, trunc(cy + sin(radians(g)) * (x - cx) + cos(radians(g)) * (y - cy)) AS ry FROM p JOIN ce USING (component), (SELECT CAST(unnest(range(0, 181)) AS DOUBLE) AS g)),
  s AS (SELECT component, g, max(rx) - min(rx) + 1 AS a, max(ry) - min(ry) + 1 AS b FROM r GROUP BY ALL)
  SELECT component, CAST(greatest(a, b) AS BIGINT) AS long_side, CAST(least(a, b) AS BIGINT) AS short_side, CAST(g AS INTEGER) AS angle FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY greatest(a, b) DESC, g) AS rn FROM s) WHERE rn = 1""")
def fn11_smallest_box(spark, sf_dir):
    shapes = points(spark, sf_dir)
    return G.smallest_box(shapes, "component", G.polygon_measures(shapes, "component"))


@R.add(f"WITH {_POINTS} SELECT component, seq, CAST(trunc(500 + cos(radians(30)) * (x - 500) - sin(radians(30)) * (y - 500)) AS BIGINT) AS rx, CAST(trunc(500 + sin(radians(30)) * (x - 500) + cos(radians(30)) * (y - 500)) AS BIGINT) AS ry FROM p")
def fn12_rotated_points(spark, sf_dir):
    return G.rotated_points(points(spark, sf_dir), 30, F.lit(500), F.lit(500)).select("component", "seq", "rx", "ry")


def _unsigned_sql(sql):
    """Engines differ in the sign of a rounded zero, so it is dropped."""
    return re.sub(r"(round\(.*?, \d\)) AS (\w)\b", r"\1 + 0.0 AS \2", sql)


def _unsigned_zero(df, *columns):
    return df.withColumns({c: F.col(c) + 0.0 for c in columns})


_ARCS = f"""{_CLOSED}, e AS (SELECT *, nx - x AS dx, ny - y AS dy, CASE WHEN nx = x AND ny = y THEN 1e-9 ELSE sqrt((nx - x) ** 2 + (ny - y) ** 2) END AS dt FROM c),
  arcs AS (SELECT *, sum(dt) OVER (PARTITION BY component ORDER BY seq) AS t, sum(dt) OVER (PARTITION BY component) AS period FROM e)"""
_EFD = f"""{_ARCS}, w AS (SELECT component, n, period, dx / dt AS sx, dy / dt AS sy, cos(2 * pi() * n * t / period) - cos(2 * pi() * n * (t - dt) / period) AS co, sin(2 * pi() * n * t / period) - sin(2 * pi() * n * (t - dt) / period) AS si
    FROM arcs, (SELECT unnest(range(1, 41)) AS n)),
  efd AS (SELECT component, CAST(n AS INTEGER) AS harmonic, max(period) / (2 * n * n * pi() ** 2) * sum(sx * co) AS a, max(period) / (2 * n * n * pi() ** 2) * sum(sx * si) AS b, max(period) / (2 * n * n * pi() ** 2) * sum(sy * co) AS c, max(period) / (2 * n * n * pi() ** 2) * sum(sy * si) AS d FROM w GROUP BY component, n)"""


@R.add(f"WITH {_ARCS} SELECT component, seq, round(t, 4) AS t FROM arcs")
def wn13_arc_length(spark, sf_dir):
    return _rounded(G.arc_length(points(spark, sf_dir), "component").select("component", "seq", "t"), "t", digits=4)


@R.add(_unsigned_sql(f"WITH {_EFD} SELECT component, harmonic, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(d, 4) AS d FROM efd"))
def fn13_fourier_descriptors(spark, sf_dir):
    return _unsigned_zero(_rounded(G.fourier_descriptors(points(spark, sf_dir), "component"), "a", "b", "c", "d", digits=4), "a", "b", "c", "d")


@R.add(_unsigned_sql(f"""WITH {_EFD}, one AS (SELECT component, 0.5 * atan2(2 * (a * b + c * d), a * a - b * b + c * c - d * d) AS theta, a AS a1, b AS b1, c AS c1, d AS d1 FROM efd WHERE harmonic = 1),
  two AS (SELECT component, theta, a1 * cos(theta) + b1 * sin(theta) AS sx, c1 * cos(theta) + d1 * sin(theta) AS sy FROM one),
  three AS (SELECT component, theta, atan2(sy, sx) AS psi, sqrt(sx * sx + sy * sy) AS size FROM two),
  f AS (SELECT component, harmonic, psi, size, a * cos(harmonic * theta) + b * sin(harmonic * theta) AS a_, -a * sin(harmonic * theta) + b * cos(harmonic * theta) AS b_, c * cos(harmonic * theta) + d * sin(harmonic * theta) AS c_, -c * sin(harmonic * theta) + d * cos(harmonic * theta) AS d_ FROM efd JOIN three USING (component))
  SELECT component, harmonic, round((cos(psi) * a_ + sin(psi) * c_) / size, 6) AS a, round((cos(psi) * b_ + sin(psi) * d_) / size, 6) AS b, round((-sin(psi) * a_ + cos(psi) * c_) / size, 6) AS c, round((-sin(psi) * b_ + cos(psi) * d_) / size, 6) AS d FROM f WHERE harmonic > 1"""))
def fn14_normalised_descriptors(spark, sf_dir):
    out = G.normalised_descriptors(G.fourier_descriptors(points(spark, sf_dir), "component"), "component")
    return _unsigned_zero(_rounded(out.where("harmonic > 1"), "a", "b", "c", "d"), "a", "b", "c", "d")


_DC = f"""{_ARCS}, k AS (SELECT component, seq, x, y, t, dt, dx / dt AS sx, dy / dt AS sy, sum(dx) OVER w - dx / dt * t AS xi, sum(dy) OVER w - dy / dt * t AS yi FROM arcs WINDOW w AS (PARTITION BY component ORDER BY seq)),
  dc AS (SELECT component, sum(sx / 2 * (t * t - (t - dt) * (t - dt)) + xi * dt) / max(t) + min_by(x, seq) AS a0, sum(sy / 2 * (t * t - (t - dt) * (t - dt)) + yi * dt) / max(t) + min_by(y, seq) AS c0 FROM k GROUP BY component)"""


@R.add(f"WITH {_DC} SELECT component, round(a0, 4) AS a0, round(c0, 4) AS c0 FROM dc")
def fn15_dc_coefficients(spark, sf_dir):
    return _rounded(G.dc_coefficients(points(spark, sf_dir), "component"), "a0", "c0", digits=4)


@R.add(_unsigned_sql(f"""WITH {_EFD}, {_DC[len(_ARCS) + 2:]},
  z AS (SELECT component, step, sum(a * cos(2 * pi() * harmonic * step / 299) + b * sin(2 * pi() * harmonic * step / 299)) AS sx, sum(c * cos(2 * pi() * harmonic * step / 299) + d * sin(2 * pi() * harmonic * step / 299)) AS sy FROM efd, (SELECT unnest(range(0, 300)) AS step) GROUP BY component, step)
  SELECT component, CAST(step AS INTEGER) AS step, round(sx + a0, 3) AS x, round(sy + c0, 3) AS y FROM z JOIN dc USING (component)"""))
def fn16_reconstructed(spark, sf_dir):
    shapes = points(spark, sf_dir)
    out = G.reconstructed(G.fourier_descriptors(shapes, "component"), G.dc_coefficients(shapes, "component"), "component")
    return _unsigned_zero(_rounded(out, "x", "y", digits=3), "x", "y")


_WIDE = f"""{_POINTS}, q AS (SELECT component, """ + ", ".join(f"max(CASE WHEN seq = {i} THEN {c} END) AS {c}{i}" for i in range(4) for c in "xy") + " FROM p GROUP BY component)"


def _wide(spark, sf_dir):
    return points(spark, sf_dir).groupBy("component").agg(*[F.max(F.when(F.col("seq") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in "xy"])


_ANGLE = "degrees(acos(greatest(least(((x0 - x1) * (x2 - x1) + (y0 - y1) * (y2 - y1)) / greatest(sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 1e-9), 1.0), -1.0)))"
_AWAY = "((x0 + x2) / 2 - x1) * (x3 - x1) + ((y0 + y2) / 2 - y1) * (y3 - y1) < 0"


@R.add(f"WITH {_WIDE} SELECT component, round({_ANGLE}, 5) AS angle FROM q")
def fn17_angle(spark, sf_dir):
    c = [F.col(f"{k}{i}") for i in range(3) for k in "xy"]
    return _wide(spark, sf_dir).select("component", F.round(G.angle_at(*c), 5).alias("angle"))


@R.add(f"WITH {_WIDE} SELECT component, round(CASE WHEN {_AWAY} THEN 360 - {_ANGLE} ELSE {_ANGLE} END, 5) AS angle FROM q")
def fn18_reflex_angle(spark, sf_dir):
    c = [F.col(f"{k}{i}") for i in range(3) for k in "xy"]
    away = ((F.col("x0") + F.col("x2")) / 2 - F.col("x1")) * (F.col("x3") - F.col("x1")) + ((F.col("y0") + F.col("y2")) / 2 - F.col("y1")) * (F.col("y3") - F.col("y1")) < 0
    return _wide(spark, sf_dir).select("component", F.round(G.reflexed(G.angle_at(*c), away), 5).alias("angle"))


@R.add(f"""WITH {_POINTS}, f AS (SELECT component, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p GROUP BY component)
  SELECT component, seq, CASE WHEN x < (y - intercept) / CASE WHEN abs(slope) < 1e-14 THEN 1e-14 ELSE slope END THEN 'left' ELSE 'right' END AS side FROM p JOIN f USING (component)""")
def fn20_side_of_line(spark, sf_dir):
    shapes = points(spark, sf_dir)
    rows = shapes.join(G.line_fit(shapes, "component"), "component")
    return rows.select("component", "seq", G.side_of_line(F.col("slope"), F.col("intercept"), F.col("x"), F.col("y"), F.lit(True), F.lit(500)).alias("side"))


@R.add(f"WITH {_POINTS} SELECT component, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x) + 1e-9, 4) AS intercept FROM p GROUP BY component")
def fn25_line_fit(spark, sf_dir):
    out = G.line_fit(points(spark, sf_dir), "component")
    return out.select("component", F.round("slope", 6).alias("slope"), F.round(F.col("intercept") + 1e-9, 4).alias("intercept"))


@R.add(f"""WITH {_POINTS}, m AS (SELECT component, avg(x) AS mx, avg(y) AS my, greatest(max(x) - min(x), 1e-9) AS sx FROM p GROUP BY component), c AS (SELECT p.component, mx, my, sx, (x - mx) / sx AS u, y - my AS v FROM p JOIN m USING (component)),
  s AS (SELECT component, CAST(count(*) AS DOUBLE) AS n, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * v) AS t1, sum(u * u * v) AS t2, max(mx) AS mx, max(my) AS my, max(sx) AS sx FROM c GROUP BY component),
  q AS (SELECT *, (t2 * s2 - t1 * s3) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS q2, ((s4 - s2 * s2 / n) * t1 - s3 * t2) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS q1 FROM s)
  SELECT component, round(q2 / sx ** 2, 8) AS p2, round(q1 / sx - 2 * q2 * mx / sx ** 2, 6) AS p1, round(my - q2 * s2 / n - q1 * mx / sx + q2 * mx ** 2 / sx ** 2, 4) AS p0 FROM q""")
def fn25_quadratic_fit(spark, sf_dir):
    out = G.quadratic_fit(points(spark, sf_dir), "component")
    return out.select("component", F.round("p2", 8).alias("p2"), F.round("p1", 6).alias("p1"), F.round("p0", 4).alias("p0"))


_SEG = f"{_POINTS}, g AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS segment FROM p WINDOW w AS (PARTITION BY component ORDER BY seq))"


@R.add(f"""WITH {_SEG}, t AS (SELECT *, sum(segment) OVER (PARTITION BY component) AS total, count(*) OVER (PARTITION BY component) AS n FROM g)
  SELECT component, round(coalesce(sum(segment), 0), 4) AS total, round(coalesce(sum(CASE WHEN n <= 2 OR segment < total / 2 THEN segment END), 0), 4) AS length FROM t GROUP BY component""")
def wn11_path_lengths(spark, sf_dir):
    return _rounded(G.path_lengths(points(spark, sf_dir), "component"), "total", "length", digits=4)


@R.add(f"WITH {_POINTS} SELECT component, seq, x, y FROM (SELECT *, row_number() OVER (PARTITION BY component, floor(x / 100), floor(y / 100) ORDER BY seq) AS rn FROM p) WHERE rn = 1")
def wn14_distinct_points(spark, sf_dir):
    from traitloom.operators.sampling import distinct_in_order

    cells = points(spark, sf_dir).withColumns({"gx": F.floor(F.col("x") / 100), "gy": F.floor(F.col("y") / 100)})
    return distinct_in_order(cells, ["component", "gx", "gy"], ["seq"]).select("component", "seq", "x", "y")


@R.add(f"""WITH {_POINTS}, s AS (SELECT component, arg_min(seq, (y, seq)) AS start, count(*) AS n, max(y) AS top FROM p GROUP BY component)
  SELECT component, CASE WHEN seq - start < 0 THEN seq - start + n ELSE seq - start END AS seq, x, top - y AS y FROM p JOIN s USING (component)""")
def wn20_rolled(spark, sf_dir):
    return G.rolled(points(spark, sf_dir), "component")


@R.add(f"""WITH {_POINTS}, e AS (SELECT component, min_by(sqrt(x * x + y * y), seq) AS f, max_by(sqrt(x * x + y * y), seq) AS l, max(seq) AS n FROM p GROUP BY component)
  SELECT component, CASE WHEN l < f THEN n - seq ELSE seq END AS seq, x, y FROM p JOIN e USING (component)""")
def wn21_oriented(spark, sf_dir):
    return G.oriented(points(spark, sf_dir), "component", 0.0, 0.0)


@R.add(f"""WITH {_SEG}, d AS (SELECT *, coalesce(segment, 0) AS dt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM g WINDOW w AS (PARTITION BY component ORDER BY seq)),
  t AS (SELECT *, sum(dt) OVER (PARTITION BY component ORDER BY seq) AS t, sum(dt) OVER (PARTITION BY component) AS total FROM d),
  s AS (SELECT *, unnest(range(CASE WHEN px IS NULL THEN 0 ELSE CAST(floor(round((t - dt) / total * 9, 9)) AS BIGINT) + 1 END, CAST(floor(round(t / total * 9, 9)) AS BIGINT) + 1)) AS step FROM t WHERE total > 0)
  SELECT component, step, round(coalesce(px + CASE WHEN dt > 0 THEN (step * total / 9 - t + dt) / dt ELSE 1 END * (x - px), x) + 1e-9, 4) AS x, round(coalesce(py + CASE WHEN dt > 0 THEN (step * total / 9 - t + dt) / dt ELSE 1 END * (y - py), y) + 1e-9, 4) AS y FROM s""")
def fn24_resampled(spark, sf_dir):
    return G.resampled(points(spark, sf_dir), "component", 10).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in "xy"})


@R.add(f"""WITH {_POINTS}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY component ORDER BY seq)),
  m AS (SELECT component, seq, sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) * sqrt((nx - px) ** 2 + (ny - py) ** 2) AS abc, abs((x - px) * (ny - py) - (nx - px) * (y - py)) / 2 AS area FROM n WHERE px IS NOT NULL AND nx IS NOT NULL)
  SELECT component, seq, round(CASE WHEN abc > 0 THEN 4 * area / abc ELSE 0 END, 8) AS curvature FROM m""")
def fn24_curvature(spark, sf_dir):
    return _rounded(G.curvature(points(spark, sf_dir), "component"), "curvature", digits=8)


@R.add(f"""WITH {_POINTS}, e AS (SELECT component, greatest(max(x) - min(x), max(y) - min(y)) AS e, avg(x) AS mx, avg(y) AS my FROM p GROUP BY component)
  SELECT component, seq, round((x - mx) / e, 8) AS x, round((y - my) / e, 8) AS y FROM p JOIN e USING (component)""")
def fn33_normalised_contour(spark, sf_dir):
    return _rounded(G.normalised_contour(points(spark, sf_dir), "component"), "x", "y", digits=8)


@R.add(f"WITH {_CLOSED} SELECT component, sum((nx - x) * (ny + y)) > 0 AS clockwise FROM c GROUP BY component")
def fn34_clockwise(spark, sf_dir):
    return G.clockwise(points(spark, sf_dir), "component")


@R.add(f"""WITH {_POINTS}, m AS (SELECT component, avg(x) AS mx, avg(y) AS my FROM p GROUP BY component)
  SELECT component, seq, row_number() OVER (PARTITION BY component ORDER BY round(atan2(x - mx, y - my), 9), seq) AS place FROM p JOIN m USING (component)""")
def fn36_angular_order(spark, sf_dir):
    return G.angular_order(points(spark, sf_dir), "component").select("component", "seq", F.col("place").cast("long").alias("place"))


@R.add("SELECT p_brand, p_partkey AS polygon, p_size AS degree, CAST(p_retailprice AS DOUBLE) AS area FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def fn37_best_polygon(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("polygon"), F.col("p_size").alias("degree"), F.col("p_retailprice").cast("double").alias("area"))
    return G.best_polygon(parts, "p_brand")
