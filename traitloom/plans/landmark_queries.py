"""Landmark operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.operators import landmarks as K

from ._register import Registry
from .linkage_queries import _POINTS, points
from .views import view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL

# kinds that some leaves lack give their points to another kind: (kind, leaves that lack it, kind instead)
_LACKING = ((4, 4, 2), (8, 5, 7), (3, 3, 5), (6, 7, 5))
_KIND = "CASE " + " ".join(f"WHEN k = {k} AND leaf % {n} = 0 THEN {other}" for k, n, other in _LACKING) + " ELSE k END"
_LEAF = f"WITH {_POINTS}, m AS (SELECT leaf, seq, x, y, {_KIND} AS k FROM (SELECT component AS leaf, seq, x, y, CAST((seq * 7 + component) % 9 AS INTEGER) AS k FROM p))"
_NAMES = "[" + ", ".join(f"'{k}'" for k in K.KINDS) + "]"


def _leaf_points(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in K.KINDS])
    rows = points(spark, sf_dir).select(F.col("component").alias("leaf"), "seq", "x", "y").withColumn("k", ((F.col("seq") * 7 + F.col("leaf")) % 9).cast("int"))
    k = F.coalesce(*[F.when((F.col("k") == kind) & (F.col("leaf") % n == 0), other) for kind, n, other in _LACKING], F.col("k"))
    return rows.select("leaf", "seq", "x", "y", F.get(kinds, k).alias("kind"))


_COUNTS = ", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(K.KINDS))
_WHOLE = "n_apex_angle > 0 AND n_base_angle > 0 AND n_petiole_trace > 0 AND n_midvein_trace > 0"


@R.add(f"""{_LEAF}, c AS (SELECT leaf, {_COUNTS} FROM m GROUP BY leaf) SELECT leaf, n_apex_angle > 0 AS has_apex_angle, n_base_angle > 0 AS has_base_angle, n_lamina_tip > 0 AS has_lamina_tip, n_lamina_base > 0 AS has_lamina_base,
  n_midvein_trace > 0 AS has_midvein_trace, n_lamina_width > 0 AS has_lamina_width, n_lobe_tip AS lobe_count FROM c""")
def ag27_presence(spark, sf_dir):
    found = K.presence(_leaf_points(spark, sf_dir))
    return found.select("leaf", *[c for c in found.columns if c.startswith("has_")], "lobe_count")


@R.add(f"""{_LEAF}, c AS (SELECT leaf, {_COUNTS} FROM m GROUP BY leaf) SELECT leaf, CASE WHEN {_WHOLE} AND n_lamina_width > 0 THEN 'complete_leaf' WHEN {_WHOLE} THEN 'leaf_no_width' ELSE 'incomplete' END AS status FROM c""")
def ag28_completeness(spark, sf_dir):
    return K.presence(_leaf_points(spark, sf_dir)).select("leaf", "status")


def _ends_sql(kind, name):
    return f"{name} AS (SELECT leaf, min_by(x, seq) AS {name}_x, min_by(y, seq) AS {name}_y FROM m WHERE k = {K.KINDS.index(kind)} GROUP BY leaf)"


@R.add(f"""{_LEAF}, {_ends_sql('lamina_tip', 'tip')}, {_ends_sql('lamina_base', 'base')}, {_ends_sql('apex_angle', 'apex')}, {_ends_sql('base_angle', 'bc')}
  SELECT leaf, round(sqrt((coalesce(tip_x, apex_x) - coalesce(base_x, bc_x)) ** 2 + (coalesce(tip_y, apex_y) - coalesce(base_y, bc_y)) ** 2), 6) AS length
  FROM (SELECT DISTINCT leaf FROM m) LEFT JOIN tip USING (leaf) LEFT JOIN base USING (leaf) LEFT JOIN apex USING (leaf) LEFT JOIN bc USING (leaf)""")
def fn27_lamina_length(spark, sf_dir):
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("seq", "x", "y")))
    ends = _leaf_points(spark, sf_dir).groupBy("leaf").agg(pick("lamina_tip").alias("tip"), pick("lamina_base").alias("base"), pick("apex_angle").alias("apex"), pick("base_angle").alias("base_centre"))
    return ends.select("leaf", F.round(K.lamina_length(), 6).alias("length"))


@R.add(f"""{_LEAF}, q AS (SELECT a.leaf, a.seq, a.x, a.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM m a JOIN m b USING (leaf) WHERE a.k = 3 AND b.k = 6)
  SELECT leaf, seq, x, y FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY d, seq) AS rn FROM q) WHERE rn = 1""")
def fn28_tip_choice(spark, sf_dir):
    rows = _leaf_points(spark, sf_dir)
    return K.tip_choice(rows.where("kind = 'lamina_tip'"), rows.where("kind = 'midvein_trace'"))


_SIDED = f"""{_LEAF}, t AS (SELECT leaf, avg(x) AS tip_x, avg(y) AS tip_y FROM m GROUP BY leaf), s AS (SELECT m.leaf, seq, x, y, tip_x, tip_y, CASE WHEN x < 0 THEN 'left' ELSE 'right' END AS side FROM m JOIN t USING (leaf)),
  c AS (SELECT leaf, arg_min(x, (sqrt((x - tip_x) ** 2 + (y - tip_y) ** 2), seq)) AS cx, arg_min(y, (sqrt((x - tip_x) ** 2 + (y - tip_y) ** 2), seq)) AS cy FROM s GROUP BY leaf),
  e AS (SELECT leaf, cx, cy, side, x, y, row_number() OVER (PARTITION BY leaf, side ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2) DESC, seq DESC) AS rn FROM s JOIN c USING (leaf))"""


@R.add(f"""{_SIDED} SELECT l.leaf, l.cx, l.cy, l.x AS lx, l.y AS ly, r.x AS rx, r.y AS ry FROM (SELECT * FROM e WHERE rn = 1 AND side = 'left') l JOIN (SELECT * FROM e WHERE rn = 1 AND side = 'right') r USING (leaf)""")
def fn26_angle_points(spark, sf_dir):
    rows = _leaf_points(spark, sf_dir)
    tips = rows.groupBy("leaf").agg(F.avg("x").alias("tip_x"), F.avg("y").alias("tip_y"))
    sides = rows.select("leaf", "seq", F.when(F.col("x") < 0, "left").otherwise("right").alias("side"))
    return K.angle_points(rows, sides, tips)


@R.add(f"""{_LEAF} SELECT leaf, seq, x + leaf % 50 AS sheet_x, y + leaf % 70 AS sheet_y FROM m""")
def fn30_to_sheet(spark, sf_dir):
    name = F.concat(F.lit("sheet__L__"), F.concat_ws("-", (F.col("leaf") % 50).cast("string"), (F.col("leaf") % 70).cast("string"), F.lit("9"), F.lit("9")))
    return K.to_sheet(_leaf_points(spark, sf_dir).withColumn("component_name", name)).select("leaf", "seq", "sheet_x", "sheet_y")


def _slot_of(line, slots):
    return ", ".join(f"({line.index(s)}, {K.KINDS.index(k)}, {i})" for k, names in slots.items() for i, s in enumerate(names, 1))


def _lines_sql(line, slots, kind):
    """Points of a kind, in order, take its slots."""
    return f"""WITH {_POINTS}, m AS (SELECT component AS leaf, x, y, CAST({kind} AS INTEGER) AS k, row_number() OVER (PARTITION BY component, {kind} ORDER BY seq) AS nth FROM p), s(slot, k, nth) AS (VALUES {_slot_of(line, slots)})
  SELECT leaf, string_agg(coalesce(CAST(x AS BIGINT), 0) || ' ' || coalesce(CAST(y AS BIGINT), 0) || ' ' || CASE WHEN x IS NULL THEN 0 ELSE 2 END, ' ' ORDER BY slot) AS line FROM (SELECT DISTINCT leaf FROM m) CROSS JOIN s LEFT JOIN m USING (leaf, k, nth) GROUP BY leaf"""


@R.add(_lines_sql(K.SLOT_LINE_31, K.SLOTS_OF_KIND, "(seq * 7 + component) % 9"))
def prj20_keypoint_lines(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in K.KINDS])
    rows = points(spark, sf_dir).select(F.col("component").alias("leaf"), "seq", "x", "y", F.get(kinds, ((F.col("seq") * 7 + F.col("component")) % 9).cast("int")).alias("kind"))
    return K.keypoint_lines(K.slotted(rows), rows.select("leaf").distinct(), K.SLOT_LINE_31)


@R.add(_lines_sql(K.SLOT_LINE_51, K.SLOTS_OF_KIND_51, "CASE WHEN seq < 24 THEN 6 ELSE (seq * 7 + component) % 9 END"))
def prj20_keypoint_lines_51(spark, sf_dir):
    """The long layout; the first 24 points of every leaf are its midvein's."""
    kinds = F.array(*[F.lit(k) for k in K.KINDS])
    kind = F.when(F.col("seq") < 24, 6).otherwise((F.col("seq") * 7 + F.col("component")) % 9)
    rows = points(spark, sf_dir).select(F.col("component").alias("leaf"), "seq", "x", "y", F.get(kinds, kind.cast("int")).alias("kind"))
    return K.keypoint_lines(K.slotted(rows, slots_of_kind=K.SLOTS_OF_KIND_51), rows.select("leaf").distinct(), K.SLOT_LINE_51)


@R.add("""SELECT id, l_linenumber, round(CASE WHEN xr > 1 THEN 2 - xr ELSE xr END, 8) AS xc, round(s / width, 8) AS w FROM (SELECT *, l_suppkey * 40.0::DOUBLE / width AS xr, CASE WHEN greatest(width, height) > 2000 THEN 27 WHEN greatest(width, height) > 1000 THEN 15 ELSE 9 END AS s FROM multimedia)""", ("multimedia",))
def fn35_training_box(spark, sf_dir):
    box = K.training_box(F.col("l_suppkey") * 40.0, F.lit(1.0), F.col("width"), F.col("height"))
    return view(spark, sf_dir, "multimedia").select("id", "l_linenumber", F.round(box["xc"], 8).alias("xc"), F.round(box["w"], 8).alias("w"))


@R.add(f"""{_LEAF}, n AS (SELECT *, row_number() OVER w AS nth, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM m WINDOW w AS (PARTITION BY leaf, k ORDER BY seq)),
  f AS (SELECT leaf, {", ".join(f"max(CASE WHEN k = {k} AND nth = {i} THEN {c} END) AS {c}{k}_{i}" for k, i in ((3, 1), (2, 1), (4, 1), (4, 2), (7, 1), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)) for c in "xy")},
    sum(CASE WHEN k = 6 THEN step END) AS vein, sum(CASE WHEN k = 8 THEN step END) AS trace FROM n GROUP BY leaf)
  SELECT leaf, round(coalesce(sqrt((x3_1 - x2_1) ** 2 + (y3_1 - y2_1) ** 2), 0), 5) AS lamina_length, round(coalesce(sqrt((x4_1 - x4_2) ** 2 + (y4_1 - y4_2) ** 2), 0), 5) AS lamina_width, round(coalesce(sqrt((x2_1 - x7_1) ** 2 + (y2_1 - y7_1) ** 2), 0), 5) AS petiole_length,
    round(coalesce(vein, 0), 5) AS midvein_length, round(coalesce(trace, 0), 5) AS petiole_trace_length, {", ".join(f"round(coalesce(degrees(acos(greatest(least(((x{k}_1 - x{k}_2) * (x{k}_3 - x{k}_2) + (y{k}_1 - y{k}_2) * (y{k}_3 - y{k}_2)) / greatest(sqrt((x{k}_1 - x{k}_2) ** 2 + (y{k}_1 - y{k}_2) ** 2) * sqrt((x{k}_3 - x{k}_2) ** 2 + (y{k}_3 - y{k}_2) ** 2), 1e-9), 1.0), -1.0))), 0), 4) AS {name}_angle" for k, name in ((0, "apex"), (1, "base")))} FROM f""")
def fn31_label_measurements(spark, sf_dir):
    out = K.label_measurements(_leaf_points(spark, sf_dir)).drop("deepest_sinus_angle")
    return out.select("leaf", *[F.round(c, 4 if c.endswith("angle") else 5).alias(c) for c in out.columns[1:]])


@R.add(f"""{_LEAF}, v AS (SELECT DISTINCT leaf FROM m WHERE k = 6), q AS (SELECT a.leaf, a.x AS lx, a.y AS ly, b.x AS rx, b.y AS ry, a.leaf IN (SELECT leaf FROM v) AS veined FROM m a JOIN m b USING (leaf) WHERE a.k = 4 AND b.k = 4 AND a.x < 0 AND b.x >= 0)
  SELECT leaf, lx, ly, rx, ry, round(sqrt((rx - lx) ** 2 + (ry - ly) ** 2), 6) AS width FROM (
    SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY CASE WHEN veined THEN -abs(rx - lx + ry - ly) ELSE (lx - rx) ** 2 + (ly - ry) ** 2 END, CASE WHEN veined THEN -lx ELSE lx END, CASE WHEN veined THEN -ly ELSE ly END, CASE WHEN veined THEN -rx ELSE rx END, CASE WHEN veined THEN -ry ELSE ry END) AS rn FROM q) WHERE rn = 1""")
def fn29_lamina_width(spark, sf_dir):
    rows = _leaf_points(spark, sf_dir)
    sides = rows.select("leaf", "seq", F.when(F.col("x") < 0, "left").otherwise("right").alias("side"))
    return K.lamina_width(rows.where("kind = 'lamina_width'"), sides, rows.where("kind = 'midvein_trace'")).withColumn("width", F.round("width", 6))
