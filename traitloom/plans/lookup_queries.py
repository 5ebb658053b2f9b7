"""Class vocabularies, ruler classes, text cells and label exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.operators import geometry as G
from traitloom.operators import landmarks as K
from traitloom.operators import rulers as U
from traitloom.operators.detections import PLANT_CLASSES

from ._register import Registry
from .geometry_queries import _CLOSED, _WIDE, _wide
from .linkage_queries import _POINTS, points
from .views import read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL

_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(PLANT_CLASSES))


@R.add(f", names(cls, name) AS (VALUES {_NAMES}) SELECT filename, l_linenumber, d.cls, name FROM detections d JOIN names USING (cls)", ("detections",))
def prj13_class_names(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(PLANT_CLASSES)), "cls int, name string")
    return view(spark, sf_dir, "detections").join(F.broadcast(names), "cls").select("filename", "l_linenumber", "cls", "name")


_RULERS = ("tick_black_4thcm", "tick_black_dual_cm_inch_halfinch_4th_8th", "blocktick_stagger_white_inch_16th", "block_white_cm_halfcm_mm", "tick_black_inch_8th", "grid_white_cm", "fail")
_EXPECTED = (
    ("tick_black_cm_halfcm_4thcm", "tick", "metric", "cm,halfcm,4thcm"),
    ("tick_black_dual_cm_halfinch_4th_8th", "tick", "dual", "cm,halfinch,4th,8th"),
    ("blocktick_stagger_white_4th_8th_16th", "blocktick", "standard", "4th,8th,16th"),
    ("block_white_cm_halfcm_mm", "block", "metric", "cm,halfcm,mm"),
    ("tick_black_inch_8th", "tick", "standard", "inch,8th"),
    ("grid_white_cm", "grid", "metric", "cm"),
    ("fail", "fail", None, ""),
)
_EXPECTED_SQL = ", ".join(f"({i}, '{n}', '{f}', {repr(s) if s else 'NULL'}, '{u}')" for i, (n, f, s, u) in enumerate(_EXPECTED))


@R.add(f"WITH e(i, name, family, system, units) AS (VALUES {_EXPECTED_SQL}) SELECT p_partkey, name, family, system, units FROM part JOIN e ON i = p_partkey % 7")
def fn23_ruler_classes(spark, sf_dir):
    classes = F.array(*[F.lit(c) for c in _RULERS])
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(classes, (F.col("p_partkey") % 7).cast("int")).alias("ruler_class"))
    return rows.select("p_partkey", *[c.alias(k) for k, c in U.class_features(F.col("ruler_class")).items()])


@R.add("""SELECT vec_id, j, round(CAST(embedding[2 * j + 1] AS DOUBLE), 5) AS a, round(CAST(embedding[2 * j + 2] AS DOUBLE), 5) AS b FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS j FROM embeddings WHERE vec_id % 3 > 0)""")
def src13_coefficient_cells(spark, sf_dir):
    number = lambda i: F.get("embedding", F.lit(i)).cast("double").cast("string")
    cell = lambda j: F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("["), number(2 * j), F.lit("  "), number(2 * j + 1), F.lit("]"))).otherwise("NA")
    wide = read(spark, sf_dir, "embeddings").select("vec_id", *[cell(j).alias(f"coeffs_{j}") for j in range(4)])
    rows = wide.where("coeffs_0 <> 'NA'").unpivot(["vec_id"], [f"coeffs_{j}" for j in range(4)], "name", "cell")
    values = F.split(F.trim(F.regexp_replace("cell", r"[\[\]]", " ")), r"\s+")
    whole = rows.select("vec_id", F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("j"), F.transform(values, lambda v: v.cast("double")).alias("v"))
    return whole.select("vec_id", "j", F.round(F.get("v", F.lit(0)), 5).alias("a"), F.round(F.get("v", F.lit(1)), 5).alias("b"))


def _angle(p, q, r):
    dot = f"((x{p} - {q}x) * (x{r} - {q}x) + (y{p} - {q}y) * (y{r} - {q}y))"
    return f"degrees(acos(greatest(least({dot} / greatest(sqrt((x{p} - {q}x) ** 2 + (y{p} - {q}y) ** 2) * sqrt((x{r} - {q}x) ** 2 + (y{r} - {q}y) ** 2), 1e-9), 1.0), -1.0)))"



@R.add(f"""WITH {_WIDE}, m AS (SELECT *, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS byy, x2 AS b_x, y2 AS b_y, (x1 + x2) / 2 AS c_x, (y1 + y2) / 2 AS c_y, x1 AS a_x, y1 AS a_y FROM q),
  t AS (SELECT component, {_angle(0, 'c_', 3)} AS o, {_angle(0, 'a_', 2)} + {_angle(1, 'b_', 3)} AS i FROM m)
  SELECT component, round(CASE WHEN i < 180 THEN -o ELSE o END, 5) AS angle FROM t""")
def fn19_signed_angle(spark, sf_dir):
    p = [[F.col(f"x{i}"), F.col(f"y{i}")] for i in range(4)]
    return _wide(spark, sf_dir).select("component", F.round(K.signed_angle(*p), 5).alias("angle"))


@R.add(f"""WITH {_WIDE}, t AS (SELECT component, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS base_width, sqrt((x2 - (x0 + x1) / 2) ** 2 + (y2 - (y0 + y1) / 2) ** 2) AS direct_length,
    abs(degrees(atan2(y3 - (y0 + y1) / 2, x3 - (x0 + x1) / 2)) - degrees(atan2(y2 - y3, x2 - x3))) AS c FROM q)
  SELECT component AS obj, round(base_width, 5) AS base_width, round(direct_length, 5) AS direct_length, round(least(c, 360 - c), 5) AS curl FROM t""")
def fn32_prickle_traits(spark, sf_dir):
    named = {"obj": "component", "lx": "x0", "ly": "y0", "rx": "x1", "ry": "y1", "tx": "x2", "ty": "y2", "mx": "x3", "my": "y3"}
    traits = K.prickle_traits(_wide(spark, sf_dir).select(*[F.col(c).alias(k) for k, c in named.items()]))
    return traits.select("obj", *[F.round(c, 5).alias(c) for c in ("base_width", "direct_length", "curl")])


def _parabola(source, name):
    return f"""{name}a AS (SELECT component, avg(x) AS mx, avg(y) AS my, greatest(max(x) - min(x), 1e-9) AS sx FROM {source} GROUP BY component),
  {name}b AS (SELECT component, mx, my, sx, (x - mx) / sx AS u, y - my AS v FROM {source} JOIN {name}a USING (component)),
  {name}c AS (SELECT component, mx, my, sx, CAST(count(*) AS DOUBLE) AS n, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * v) AS t1, sum(u * u * v) AS t2 FROM {name}b GROUP BY component, mx, my, sx),
  {name}d AS (SELECT *, (s4 - s2 ** 2 / n) * s2 - s3 ** 2 AS det FROM {name}c),
  {name}e AS (SELECT *, CASE WHEN abs(det) > 1e-12 THEN (t2 * s2 - t1 * s3) / det END AS q2, CASE WHEN abs(det) > 1e-12 THEN ((s4 - s2 ** 2 / n) * t1 - s3 * t2) / det END AS q1 FROM {name}d),
  {name} AS (SELECT component, n, q2 / sx ** 2 AS {name}2, q1 / sx - 2 * q2 * mx / sx ** 2 AS {name}1, my - q2 * s2 / n - q1 * mx / sx + q2 * mx ** 2 / sx ** 2 AS {name}0 FROM {name}e)"""


def _root(a, b, c):
    q = f"(-({b} + CASE WHEN {b} < 0 THEN -1 ELSE 1 END * sqrt(greatest({b} ** 2 - 4 * {a} * {c}, 0))) / 2)"
    return f"CASE WHEN {b} ** 2 - 4 * {a} * {c} >= 0 THEN CASE WHEN {q} <> 0 AND {b} = 0 THEN abs({c} / {q}) WHEN {q} <> 0 THEN {c} / {q} WHEN {c} = 0 THEN 0 END END"


@R.add(f"""WITH {_POINTS}, mid AS (SELECT * FROM p WHERE seq % 4 = 0), {_parabola('mid', 'm')},
  o AS (SELECT p.*, y > m2 * x ** 2 + m1 * x + m0 AS above FROM p JOIN m USING (component) WHERE seq % 4 > 0),
  ol AS (SELECT * FROM o WHERE NOT coalesce(above, false)), {_parabola('ol', 'l')}, orr AS (SELECT * FROM o WHERE above), {_parabola('orr', 'r')},
  el AS (SELECT component, arg_max(x, seq) AS lx, arg_max(y, seq) AS ly FROM ol GROUP BY component HAVING count(*) >= 3), er AS (SELECT component, arg_max(x, seq) AS rx, arg_max(y, seq) AS ry FROM orr GROUP BY component HAVING count(*) >= 3),
  tip AS (SELECT component, arg_min(x, seq) AS tx, arg_min(y, seq) AS ty, CASE WHEN max(x) > min(x) THEN regr_slope(y, x) END AS k FROM mid WHERE seq < 12 GROUP BY component),
  j AS (SELECT *, rx - lx AS dx, ry - ly AS dy, (ry - ly) / nullif(rx - lx, 0) AS slope FROM tip JOIN m USING (component) LEFT JOIN (el JOIN l USING (component)) USING (component) LEFT JOIN (er JOIN r USING (component)) USING (component)),
  z AS (SELECT *, {_root('(l2 - r2)', '(l1 - r1)', '(l0 - r0)')} AS cx, {_root('m2', '(m1 - slope)', '(m0 - ly + slope * lx)')} AS bx FROM j)
  SELECT component AS obj, round(sqrt(dx ** 2 + dy ** 2), 3) AS base_width, round(abs(dx * (ly - ty) - (lx - tx) * dy) / nullif(sqrt(dx ** 2 + dy ** 2), 0), 3) AS direct_length,
    round(CASE WHEN dx <> 0 OR dy <> 0 THEN degrees(atan2(abs(dx + dy * k), abs(dx * k - dy))) END, 3) AS angle_curl,
    round(degrees(atan2(abs(2 * r2 * cx + r1 - 2 * l2 * cx - l1), abs(1 + (2 * l2 * cx + l1) * (2 * r2 * cx + r1)))), 3) AS angle_tangent, round(bx, 2) AS base_x, round(ly + slope * (bx - lx), 2) AS base_y FROM z""")
def fn32_armature_traits(spark, sf_dir):
    rows = points(spark, sf_dir).withColumns({"part": F.when(F.col("seq") % 4 == 0, "middle").otherwise("outer"), "obj": F.col("component")})
    traits = K.armature_traits(rows)
    return traits.select("obj", *[F.round(c, d).alias(c) for c, d in (("base_width", 3), ("direct_length", 3), ("angle_curl", 3), ("angle_tangent", 3), ("base_x", 2), ("base_y", 2))])


@R.add(f"""WITH {_CLOSED} SELECT component, min(x) AS x, min(y) AS y, max(x) AS max_x, max(y) AS max_y, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area, string_agg(CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT), ',' ORDER BY seq) AS segmentation FROM c GROUP BY component""")
def fn38_polygon_annotations(spark, sf_dir):
    pair = F.concat_ws(",", F.col("x").cast("long"), F.col("y").cast("long"))
    lists = F.array_sort(F.collect_list(F.struct("seq", pair.alias("p"))))
    shapes = points(spark, sf_dir)
    out = shapes.groupBy("component").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.array_join(F.transform(lists, lambda s: s["p"]), ",").alias("segmentation")
    )
    return out.join(G.polygon_measures(shapes, "component").select("component", F.round("area", 4).alias("area")), "component")
