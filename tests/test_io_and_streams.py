"""Sources, sinks and streams on small files; streams equal their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from traitloom.operators import models as M
from traitloom.plans.views import view
from traitloom.sources import readers as S
from traitloom.sources import writers as K
from traitloom.streaming import downloads as T

SF = "/root/testdata/sf0.001"


def test_separator_comes_from_the_header(spark, tmp_path):
    assert [S.separator_of(h, "csv") for h in ("a\tb\tc,d", "a,b", "a|b", "a;b;c", "a")] == ["\t", ",", "|", ";", ","]
    (tmp_path / "occurrence.csv").write_text("gbifID\tfamily\n1\tFagaceae\n2\t\n")
    got = S.read_delimited(spark, str(tmp_path / "occurrence.csv"))
    assert got.dtypes == [("gbifID", "string"), ("family", "string")] and [tuple(r) for r in got.collect()] == [("1", "Fagaceae"), ("2", None)]


def test_archives_keep_their_folder(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "multimedia.txt").write_text("coreid\tidentifier\n1\thttp://x/1.jpg\n")
    got = S.read_archives(spark, f"{tmp_path}/*/multimedia.txt")
    assert sorted(r["archive"] for r in got.collect()) == ["a", "b"]


def test_label_files_become_boxes(spark, tmp_path):
    (tmp_path / "sheet1.txt").write_text("3 0.5 0.5 0.2 0.4 0.9\n0 0.1 0.1 0.1 0.1\nbroken\n")
    got = sorted(map(tuple, S.read_label_files(spark, str(tmp_path)).collect()))
    assert got == [("sheet1", 0, 0.1, 0.1, 0.1, 0.1, None), ("sheet1", 3, 0.5, 0.5, 0.2, 0.4, 0.9)]


def test_annotation_exports_and_coco(spark, tmp_path):
    export = [{"External ID": "s1", "Skipped": False, "Reviews": [{"score": 1}], "Label": {"objects": [{"value": "leaf", "bbox": {"top": 1, "left": 2, "height": 3, "width": 4}}]}}, {"External ID": "s2", "Skipped": True, "Reviews": [], "Label": {"objects": []}}]
    (tmp_path / "e.json").write_text(json.dumps(export))
    rows = {r["filename"]: r for r in S.read_annotation_export(spark, str(tmp_path / "e.json")).collect()}
    assert rows["s1"]["value"] == "leaf" and rows["s1"]["bbox"]["left"] == 2 and rows["s2"]["value"] is None
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg", "width": 5, "height": 6}], "annotations": [{"id": 9, "image_id": 1, "category_id": 2, "iscrowd": 0, "area": 3.0, "bbox": [0, 0, 1, 1]}]}))
    images, annotations = S.read_coco(spark, str(tmp_path / "c.json"))
    packet = json.loads(K.coco_packets(images, annotations).first()["packet"])
    assert packet["annotations"][0]["id"] == 9 and packet["width"] == 5


def test_contours_and_ground_truth(spark, tmp_path):
    (tmp_path / "leaf.txt").write_text("\n".join(["h"] * 11 + ["1,2", "3,4"]) + "\n")
    got = [(r["seq"], r["x"], r["y"], len(r["header"])) for r in S.read_contours(spark, str(tmp_path / "leaf.txt")).orderBy("seq").collect()]
    assert got == [(0, 1.0, 2.0, 11), (1, 3.0, 4.0, 11)]
    gt = tmp_path / "gt"
    gt.mkdir()
    (gt / "tip__train__gt.csv").write_text('filename,count,locations\na,1,"[[1,2]]"\n')
    (gt / "tip__val__gt.csv").write_text('filename,count,locations\nb,1,"[[3,4]]"\n')
    assert [tuple(r) for r in S.read_ground_truth(spark, f"{gt}/*.csv", "tip", "val").collect()] == [("b", 1, [[3.0, 4.0]])]


def test_images_are_listed_without_their_contents(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"yy")
    got = {r["name"]: (r["length"], r["valid"]) for r in S.list_images(spark, str(tmp_path), ("jpg",)).collect()}
    assert got == {"a.JPG": (1, True), "b.txt": (2, False)}


def test_batches_merge_with_unlike_columns(spark, tmp_path):
    K.write_batches(spark.createDataFrame([("a", 1)], "filename string, batch int"), f"{tmp_path}/one")
    K.write_batches(spark.createDataFrame([("a", 1, 2.0)], "filename string, batch int, area double"), f"{tmp_path}/two")
    got = K.merge_batches(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])
    assert got.count() == 2 and set(got.columns) == {"filename", "batch", "area"}


@pytest.fixture
def log_files(spark, tmp_path):
    log = view(spark, SF, "download_log").withColumn("ts", F.col("ts").cast("timestamp"))
    log.repartition(1).sortWithinPartitions("ts", "id").write.parquet(f"{tmp_path}/log")
    return f"{tmp_path}/log", log


def run(stream, mode, name, checkpoint):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_live_quota_equals_the_batch_quota(spark, log_files, tmp_path):
    path, log = log_files
    run(T.live_quota(T.log_stream(spark, path), 3), "append", "quota", f"{tmp_path}/c")
    got = {(r["fullname"], r["id"]) for r in spark.table("quota").collect()}
    from traitloom.operators.filters import first_rows

    want = {(r["fullname"], r["id"]) for r in first_rows(log.where("status = 'ok'"), ["fullname"], ["ts", "id"], 3).collect()}
    assert got == want


def test_strikes_and_windows_equal_batch(spark, log_files, tmp_path):
    path, log = log_files
    run(T.circuit_breaker(T.log_stream(spark, path), 5), "complete", "strikes", f"{tmp_path}/c1")
    want = {tuple(r) for r in log.where("status <> 'ok'").groupBy("host").count().selectExpr("host", "count", "count > 5").collect()}
    assert {tuple(r) for r in spark.table("strikes").collect()} == want
    run(T.windowed_strikes(T.log_stream(spark, path)), "update", "windows", f"{tmp_path}/c2")
    assert spark.table("windows").agg(F.sum("strikes")).first()[0] >= log.where("status <> 'ok'").count()
    run(T.deduplicated(T.log_stream(spark, path)), "append", "once", f"{tmp_path}/c3")
    assert spark.table("once").count() == log.select("id", "host").distinct().count()
    run(T.sessions(T.log_stream(spark, path)), "append", "sessions", f"{tmp_path}/c4")
    assert spark.table("sessions").count() > 0


def test_routing_writes_every_row_once(spark, log_files, tmp_path):
    path, log = log_files
    T.routed(T.log_stream(spark, path), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().count() == log.select("status").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == log.count()


def test_label_stream_reads_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.txt").write_text("1 0.5 0.5 0.2 0.2\n")
    run(T.label_stream(spark, f"{tmp_path}/in"), "append", "labels", f"{tmp_path}/c")
    assert spark.table("labels").first()["filename"] == "s"


def test_forest_saves_and_loads(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    rows = view(spark, SF, "conversion_training")
    model, _ = M.correctness_forest(rows, ["image_height", "image_width"], "correct", trees=3)
    model.save(f"{tmp_path}/rf")
    assert RandomForestClassificationModel.load(f"{tmp_path}/rf").getNumTrees == 3
    assert len(model.featureImportances) == 2


def test_discriminants_separate_classes(spark):
    rows = spark.createDataFrame([(c, c * 10.0 + i % 3, float(i % 5)) for c in (0, 1, 2) for i in range(30)], "cls int, a double, b double")
    out, shares = M.discriminant_axes(rows, ["a", "b"], "cls")
    means = sorted(r["m"] for r in out.groupBy("cls").agg(F.avg("ld1").alias("m")).collect())
    assert shares[0] > 0.95 and means[1] - means[0] > 1 and means[2] - means[1] > 1
