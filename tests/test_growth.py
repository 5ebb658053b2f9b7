"""Steps that must grow no faster than their input."""

import re
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.functions import naming as N
from traitloom.operators import detections as D
from traitloom.operators import filters as X
from traitloom.operators import metrics as M
from traitloom.operators import models as P
from traitloom.operators.lineage import shared_folder
from traitloom.registry import QUERIES
from traitloom.streaming import retries as Y


def test_pixels_of_large_images_do_not_overflow(spark):
    sizes = spark.createDataFrame([(222_600, 120_800), (1_000, 1_500)], "height int, width int")
    got = sizes.select(X.resolution(F.col("height"), F.col("width"), 1.0, 4.0), N.megapixels(F.col("height"), F.col("width"), 1))
    assert [tuple(r) for r in got.collect()] == [("resize", 26_890.1), ("keep", 1.5)]


def test_overlap_thresholds_share_one_ranking(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(c), float(s) / 20, i, None if v < 30 else float(v) / 100) for i, (c, s, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 20, 400), rng.integers(0, 101, 400), strict=True))]
    rows += [(5, 0.5, 400, None), (6, 0.5, 401, 0.9)]  # a class without hits, and one without labels
    totals = {0: 150, 1: 200, 2: 90, 5: 4, 7: 3}
    ranked, steps = [], [50, 65, 80]
    real = M.in_ranges
    monkeypatch.setattr(M, "in_ranges", lambda df, *a: ranked.append(df.count()) or real(df, *a))
    predictions = spark.createDataFrame(rows, "cls int, score double, id long, iou double").repartition(5)
    found = M.mean_average_precision(predictions, spark.createDataFrame(list(totals.items()), "cls int, total long"), ["id"], steps).collect()
    want = {}
    for c in (0, 1, 2, 5):
        mine = sorted((-s, i, v or 0) for k, s, i, v in rows if k == c)
        for t in steps:
            hit = [round(v * 100, 7) >= t for *_, v in mine]
            precision = [sum(hit[: i + 1]) / (i + 1) for i in range(len(hit))]
            want[str(c), t] = sum(max(precision[i:]) / totals[c] for i, h in enumerate(hit) if h)
    assert {(r["cls"], r["threshold"]): r["ap"] for r in found} == pytest.approx(want)
    assert ranked == [len(rows)]


def test_unmatched_boxes_do_not_meet_in_one_task(spark):
    box = lambda side, n: spark.range(n).select(F.concat(F.lit(side), F.col("id").cast("string")).alias("id"), (F.col("id") % 3).alias("cls"))
    matches = spark.createDataFrame([("p1", "t1"), ("p2", "t500"), ("p3", "t3")], "prediction string, label string")
    set_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        counts = [r["count"] for r in M.paired(box("p", 4_000), box("t", 100), matches).groupBy(F.spark_partition_id()).count().collect()]
        found = {(r["predicted"], r["true"]): r["n"] for r in M.confusion(box("p", 4_000), box("t", 100), matches).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(counts) == 4_098 and max(counts) < 1_500
    assert found == {("1", "1"): 1, ("0", "0"): 1, ("0", "background"): 1_333, ("1", "background"): 1_332, ("2", "background"): 1_333, ("background", "0"): 33, ("background", "1"): 32, ("background", "2"): 33}


def test_split_statistics_count_without_distinct(spark):
    boxes = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", None), (None, 1)], "image string, cls int")
    images = spark.createDataFrame([("a", "train"), ("b", "val"), ("b", "val"), ("b", "train"), ("c", "train"), (None, "val")], "image string, split string")
    found = D.split_statistics(boxes, images, "image")
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("train", 1, 3, 2), ("train", 2, 1, 1), ("train", None, 1, 1), ("val", 1, 2, 1)]))


def test_models_are_fitted_on_small_partitions(spark, monkeypatch):
    seen = {}

    def watched(cls):
        real = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, rows: seen.setdefault(cls.__name__, max(rows.rdd.glom().map(len).collect())) and real(self, rows))

    for cls in (P.RandomForestClassifier, P.KMeans, P.GaussianMixture):
        watched(cls)
    monkeypatch.setattr(P, "TRAINED_ROWS", 100)
    monkeypatch.setattr(P, "CLUSTERED_ROWS", 150)
    rows = spark.range(0, 600, 1, 1).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"), (F.col("id") % 2).cast("int").alias("correct"))
    _, scored = P.correctness_forest(rows, ["x", "y"], "correct", trees=3)
    assert scored.count() == 600
    assert len(P.anchors(rows.select((F.col("x") + 1).alias("w"), (F.col("y") + 1).alias("h")), 3)) == 3 and len(P.point_clusters(rows, 2)) == 2
    assert seen["RandomForestClassifier"] <= 110 and seen["KMeans"] <= 165 and seen["GaussianMixture"] <= 165


def test_contour_files_are_written_by_several_tasks(spark):
    root = shared_folder(spark).removeprefix("file:")
    before = set(glob(f"{root}/io-*/contours/*/part-*"))
    assert QUERIES["src09_contours"](spark, "/root/testdata/sf0.1").count() == 1_200
    files = set(glob(f"{root}/io-*/contours/*/part-*")) - before
    assert len(files) == 400 and len({re.search(r"part-(\d+)", f)[1] for f in files}) > 1


def test_a_retry_reads_its_state_once():
    class Counted:
        def __init__(self):
            self.value, self.calls = None, 0

        def getValueState(self, name, schema):
            return self

        def called(self, value=None):
            self.calls += 1
            return value

        def exists(self):
            return self.called(self.value is not None)

        def get(self):
            return self.called(self.value)

        def update(self, value):
            self.value = self.called(value)

        def clear(self):
            self.value = self.called()

        def registerTimer(self, ms):
            self.called()

        def getCurrentProcessingTimeInMs(self):
            return 1_000

    state, processor = Counted(), Y.Retry(4, 0)
    processor.init(state)
    step = lambda n, status: [tuple(r) for r in processor.handleInputRows((5,), iter([{"attempt": n, "status": status}]), state)]
    assert step(1, "retry") == [] and state.calls == 3
    assert [tuple(r) for r in processor.handleExpiredTimer((5,), state, None)] == [(5, 2, "offer")] and state.calls == 4
    assert step(2, "ok") == [(5, 2, "ok")] and state.calls == 6
    assert [tuple(r) for r in processor.handleExpiredTimer((5,), state, None)] == [] and state.calls == 7
