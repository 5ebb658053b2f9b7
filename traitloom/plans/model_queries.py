"""Models on trait tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.operators import models as M

from ._register import Registry
from .linkage_queries import points
from .views import view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL


def _training(spark, sf_dir):
    return view(spark, sf_dir, "conversion_training").withColumn("mp", F.col("image_height") * F.col("image_width") / 1e6)


def _fit_sql(source, name):
    return f"""{name}m AS (SELECT avg(mp) AS mx, avg(conversion_mean) AS my FROM {source}), {name}c AS (SELECT mp - mx AS u, conversion_mean - my AS v FROM {source}, {name}m),
      {name}s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(u * u) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * v) AS t1, sum(u * u * v) AS t2 FROM {name}c),
      {name}q AS (SELECT *, (t2 * s2 - t1 * s3) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS q2, ((s4 - s2 * s2 / n) * t1 - s3 * t2) / ((s4 - s2 * s2 / n) * s2 - s3 * s3) AS q1 FROM {name}s),
      {name} AS (SELECT my - q2 * s2 / n - q1 * mx + q2 * mx * mx AS p0, q1 - 2 * q2 * mx AS p1, q2 AS p2 FROM {name}q, {name}m)"""


_POLY = f""", t AS (SELECT component, image_height * image_width / 1e6 AS mp, conversion_mean FROM conversion_training), {_fit_sql('t', 'f')}, r AS (SELECT t.*, abs(conversion_mean - (p0 + p1 * mp + p2 * mp * mp)) AS res FROM t, f),
  kept AS (SELECT * FROM r WHERE res <= 0.5 * (SELECT stddev_pop(res) FROM r)), {_fit_sql('kept', 'g')}"""


@R.add(_POLY + " SELECT round(p0, 4) AS p0, round(p1, 4) AS p1, round(p2, 5) AS p2 FROM g", ("conversion_training",))
def ml01_polynomial(spark, sf_dir):
    p = M.fit_polynomial(_training(spark, sf_dir), "mp", "conversion_mean")
    return spark.createDataFrame([tuple(float(p[k]) for k in ("p0", "p1", "p2"))], "p0 double, p1 double, p2 double").select(*[F.round(k, d).alias(k) for k, d in (("p0", 4), ("p1", 4), ("p2", 5))])


@R.add(_POLY + " SELECT component, round(p0 + p1 * mp + p2 * mp * mp, 3) AS predicted FROM t, g", ("conversion_training",))
def ml02_predicted(spark, sf_dir):
    rows = _training(spark, sf_dir)
    p = M.fit_polynomial(rows, "mp", "conversion_mean")
    return rows.select("component", F.round(M.predict_polynomial(F.col("mp"), p), 3).alias("predicted"))


@R.add()
def ml03_correctness_forest(spark, sf_dir):
    _, scored = M.correctness_forest(_training(spark, sf_dir), ["image_height", "image_width", "conversion_mean", "mp"], "correct")
    return scored.select("component", "correct", "prediction")


@R.add()
def ml09_forest_report(spark, sf_dir):
    columns = ["image_height", "image_width", "conversion_mean", "mp"]
    model, scored = M.correctness_forest(_training(spark, sf_dir), columns, "correct")
    return M.forest_report(model, scored, columns, "correct")


@R.add()
def ml04_fallback(spark, sf_dir):
    rows = _training(spark, sf_dir)
    _, scored = M.correctness_forest(rows, ["image_height", "image_width", "conversion_mean", "mp"], "correct")
    p = M.fit_polynomial(rows.where("correct = 1"), "mp", "conversion_mean")
    return M.with_fallback(scored, "conversion_mean", M.predict_polynomial(F.col("mp"), p)).select("component", "prediction", "pred_mean")


_TRAITS = ["area", "perimeter", "apex_angle", "base_angle"]


def _axis_sql(of, name):
    """The first axis of the symmetric matrix ``m`` in ``of``, by squaring it again and again (v, largest element positive; share)."""
    squared = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / list_sum(list_transform(m, lambda r: list_dot_product(r, r)))))"
    return f"""{name}s AS (WITH RECURSIVE s(i, m) AS (SELECT 0, m FROM {of} UNION ALL SELECT i + 1, {squared} FROM s WHERE i < 45) SELECT m FROM s WHERE i = 45),
      {name}d AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}s),
      {name}r AS (SELECT m[list_position(d, list_max(d))] AS r FROM {name}d),
      {name}v AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {name}r),
      {name} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS weight FROM {name}v, {of})"""


_COMPONENTS = f""", x AS (SELECT class, {', '.join(_TRAITS)} FROM measurements JOIN landmarks USING (component) WHERE {' AND '.join(f'{t} IS NOT NULL' for t in _TRAITS)}),
  c AS (SELECT [{', '.join('[' + ', '.join('1.0' if a == b else f'corr({a}, {b})' for b in _TRAITS) + ']' for a in _TRAITS)}]::DOUBLE[][] AS m FROM x), {_axis_sql('c', 'p')},
  rest AS (SELECT list_transform(range(1, len(m) + 1), lambda a: list_transform(range(1, len(m) + 1), lambda b: m[a][b] - weight * v[a] * v[b])) AS m FROM c, p), {_axis_sql('rest', 'q')}"""
_SCALED = "[" + ", ".join(f"({t} - m{i}) / s{i}" for i, t in enumerate(_TRAITS)) + "]"
_MOMENTS = ", ".join(f"avg({t}) AS m{i}, stddev_samp({t}) AS s{i}" for i, t in enumerate(_TRAITS))


def _all_traits(spark, sf_dir):
    return view(spark, sf_dir, "measurements").join(view(spark, sf_dir, "landmarks"), "component")


@R.add(f"{_COMPONENTS} SELECT class, round(avg(list_dot_product({_SCALED}, p.v)), 6) AS pc1, round(avg(list_dot_product({_SCALED}, q.v)), 6) AS pc2 FROM x, (SELECT {_MOMENTS} FROM x), p, q GROUP BY class", ("measurements", "landmarks"))
def ml05_principal_components(spark, sf_dir):
    """Centroids of the classes on the first two components."""
    rows, _ = M.principal_components(_all_traits(spark, sf_dir), _TRAITS, 2)
    return rows.groupBy("class").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("pc1", "pc2")])


@R.add(f"{_COMPONENTS}, t AS (SELECT unnest({_TRAITS}) AS trait, unnest(p.v) AS pc1, unnest(q.v) AS pc2 FROM p, q UNION ALL SELECT 'explained', p.weight / {len(_TRAITS)}, q.weight / {len(_TRAITS)} FROM p, q) SELECT trait, round(pc1, 5) AS pc1, round(pc2, 5) AS pc2 FROM t", ("measurements", "landmarks"))
def ml05_loadings(spark, sf_dir):
    """Loadings and explained shares of the first two components."""
    return M.component_loadings(_all_traits(spark, sf_dir), _TRAITS, 2).select("trait", *[F.round(c, 5).alias(c) for c in ("pc1", "pc2")])


@R.add()
def ml06_descriptor_components(spark, sf_dir):
    from traitloom.operators.geometry import fourier_descriptors

    coefficients = fourier_descriptors(points(spark, sf_dir), "component")
    wide = coefficients.groupBy("component").pivot("harmonic", list(range(1, 41))).agg(*[F.first(c).alias(c) for c in "abcd"])
    rows, _ = M.principal_components(wide, [c for c in wide.columns if c != "component"], 4)
    return rows.select("component", "pc1", "pc2", "pc3", "pc4")


@R.add()
def ml07_discriminants(spark, sf_dir):
    traits = view(spark, sf_dir, "measurements").join(view(spark, sf_dir, "landmarks"), "component")
    rows, _ = M.discriminant_axes(traits, ["area", "perimeter", "apex_angle", "base_angle"], "class")
    return rows.select("component", "class", "ld1", "ld2")


@R.add()
def vd05_anchors(spark, sf_dir):
    found = M.anchors(view(spark, sf_dir, "detections").select("w", "h"))
    return spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(found)], "anchor int, w double, h double")


@R.add()
def ml10_point_clusters(spark, sf_dir):
    found = M.point_clusters(points(spark, sf_dir).select("x", "y"), 3)
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(found)], "cluster int, x int, y int")
