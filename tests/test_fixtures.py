"""Hand-computed cases."""

from math import pi

import pytest
from pyspark.sql import functions as F

from traitloom.functions import naming as N
from traitloom.operators import geometry as G
from traitloom.operators import linkage as L
from traitloom.operators import rulers as U
from traitloom.operators import sampling as S


def shape(spark, points):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "obj int, seq long, x double, y double")


def test_unit_square(spark):
    square = shape(spark, [(0, 0), (1, 0), (1, 1), (0, 1)])
    m = G.polygon_measures(square, "obj").first()
    assert (m["area"], m["perimeter"], m["degree"]) == (1.0, 4.0, 5)
    assert m["circularity"] == pytest.approx(pi / 4)
    assert (m["cx"], m["cy"]) == (0, 0)
    assert G.convex_hulls(square, "obj").first()["convex_hull"] == 1.0


def test_hull_of_a_star_drops_inner_points(spark):
    star = shape(spark, [(0, 0), (2, 1), (4, 0), (3, 2), (4, 4), (2, 3), (0, 4), (1, 2)])
    assert G.convex_hulls(star, "obj").first()["convex_hull"] == 16.0


def test_pixel_corners(spark):
    row = spark.range(1).select(*[c.alias(k) for k, c in G.pixel_box(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4), 100, 200).items()]).first()
    assert tuple(row) == (40, 60, 60, 140)


def test_iou_of_shifted_squares(spark):
    boxes = spark.sql("SELECT named_struct('x1', 0, 'y1', 0, 'x2', 2, 'y2', 2) AS a, named_struct('x1', 1, 'y1', 1, 'x2', 3, 'y2', 3) AS b")
    assert boxes.select(G.overlaps("a", "b")["iou"]).first()[0] == pytest.approx(1 / 7, abs=1e-6)


def test_right_angle_and_reflex(spark):
    angle = G.angle_at(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1)])
    row = spark.range(1).select(angle, G.reflexed(angle, F.lit(True))).first()
    assert tuple(row) == pytest.approx((90.0, 270.0))


def test_path_without_outlier(spark):
    path = shape(spark, [(0, 0), (1, 0), (2, 0), (3, 0), (40, 0)])
    row = G.path_lengths(path, "obj").first()
    assert (row["total"], row["length"]) == (40.0, 3.0)


def test_tick_spacing_in_centimetres(spark):
    ticks = spark.createDataFrame([("r", 1, float(x), x) for x in (0, 10, 20, 30)], "ruler_id string, strip int, x double, event_id long")
    spacing = U.geometric_spacing(U.nearest_gaps(ticks, ["ruler_id"]), ["ruler_id"])
    assert spacing.first()["spacing"] == pytest.approx(10)
    units = U.units_table(spark)
    got = {u: U.to_centimetres(spacing.withColumn("unit", F.lit(u)), units).first()["px_per_cm"] for u in ("mm", "8th")}
    assert got["mm"] == pytest.approx(100) and got["8th"] == pytest.approx(10 * 8 / 2.54)


def test_pooled_sd_forms(spark):
    groups = spark.createDataFrame([("r", 3, 1.0), ("r", 3, 1.0)], "ruler_id string, n int, sd double")
    for minus in (2, None):
        assert U.pooled_sd(groups, ["ruler_id"], minus).first()["pooled_sd"] == pytest.approx(1)


def test_quota_cascade_keeps_first_rows(spark):
    rows = spark.createDataFrame([(str(i), f"{t}", "g") for i, t in enumerate("aaabb")], "id string, species string, genus string")
    kept = S.quotas(rows, {"species": 2, "genus": 3})
    assert kept.count() == 3 and kept.groupBy("species").count().agg(F.max("count")).first()[0] <= 2


def test_resize_keeps_the_aspect(spark):
    w, h = N.resized(F.lit(6000), F.lit(3000))
    assert tuple(spark.range(1).select(w, h).first()) == (5000, 2500)


def test_numbering_is_global_and_total(spark):
    got = L.numbered(spark.range(1000).repartition(7), ["id"]).collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_herbarium_code_falls_back(spark):
    rows = spark.createDataFrame([(None, "a long name", None, "Some Garden", "x" * 20), ("ABC", "a long name", None, "p", "q"), (None, "UBC Herbarium", None, None, "y" * 9), (None, None, None, None, None)],
                                 "institutionCode string, institutionID string, collectionCode string, publisher string, occurrenceID string")
    assert [r[0] for r in rows.select(N.herbarium_code(rows.columns)).collect()] == ["Some-Garden", "ABC", "UBC", "ERROR"]
