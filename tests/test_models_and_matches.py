"""Models against numpy, matches and running scores against walks, readers and writers on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import geometry as G
from traitloom.operators import landmarks as K2
from traitloom.operators import linkage as L
from traitloom.operators import metrics as M
from traitloom.operators import models as P
from traitloom.operators import rulers as U
from traitloom.operators import stats as T
from traitloom.plans.views import view
from traitloom.registry import QUERIES
from traitloom.sources import readers as S
from traitloom.sources import writers as K

SF = "/root/testdata/sf0.001"
TRAITS = ["area", "perimeter", "apex_angle", "base_angle"]


def traits(spark):
    rows = view(spark, SF, "measurements").join(view(spark, SF, "landmarks"), "component").toPandas().dropna(subset=TRAITS)
    return rows, rows[TRAITS].to_numpy(float)


# models


def test_principal_components_equal_numpy(spark):
    rows, x = traits(spark)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, _, axes = np.linalg.svd(scaled - scaled.mean(axis=0), full_matrices=False)
    got = QUERIES["ml05_principal_components"](spark, SF).toPandas().set_index("class")
    for i in (0, 1):
        want = rows.assign(pc=scaled @ axes[i]).groupby("class")["pc"].mean().reindex(got.index).to_numpy()
        mine = got[f"pc{i + 1}"].to_numpy()
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6


def test_loadings_equal_numpy(spark):
    _, x = traits(spark)
    share, axes = np.linalg.eigh(np.corrcoef(x.T))
    got = {r["trait"]: r for r in QUERIES["ml05_loadings"](spark, SF).collect()}
    for i in (0, 1):
        axis = axes[:, -1 - i]
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert np.abs(axis - [got[t][f"pc{i + 1}"] for t in TRAITS]).max() < 1e-5
        assert abs(got["explained"][f"pc{i + 1}"] - share[-1 - i] / 4) < 1e-5


def test_discriminants_equal_numpy(spark):
    rows, x = traits(spark)
    labels, mean = rows["class"].to_numpy(), x.mean(axis=0)
    within, between = np.zeros((4, 4)), np.zeros((4, 4))
    for c in set(labels):
        mine = x[labels == c]
        within += (mine - mine.mean(axis=0)).T @ (mine - mine.mean(axis=0))
        between += len(mine) * np.outer(mine.mean(axis=0) - mean, mine.mean(axis=0) - mean)
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    got = QUERIES["ml07_discriminants"](spark, SF).toPandas().set_index("component").loc[rows["component"]]
    for i, at in enumerate(np.argsort(-values.real)[:2]):
        projected = x @ vectors.real[:, at]
        assert abs(np.corrcoef(projected, got[f"ld{i + 1}"].to_numpy())[0, 1]) == pytest.approx(1, abs=1e-6)


def test_forest_report_and_fallback(spark):
    scored = QUERIES["ml03_correctness_forest"](spark, SF).toPandas()
    report = QUERIES["ml09_forest_report"](spark, SF).toPandas().set_index("name")["value"]
    assert report["accuracy"] == pytest.approx((scored["correct"] == scored["prediction"]).mean())
    assert report.drop("accuracy").sum() == pytest.approx(1) and len(report) == 5
    fallen = QUERIES["ml04_fallback"](spark, SF).toPandas()
    measured = view(spark, SF, "conversion_training").toPandas().set_index("component")["conversion_mean"]
    right = fallen[fallen["prediction"] == 1]
    assert np.allclose(right["pred_mean"].to_numpy(float), measured.loc[right["component"]].to_numpy(float))
    assert fallen["pred_mean"].notna().all()


def test_anchors_and_clusters_are_centres(spark):
    boxes = view(spark, SF, "detections").select("w", "h").toPandas().to_numpy(float)
    got = QUERIES["vd05_anchors"](spark, SF).toPandas()[["w", "h"]].to_numpy()
    scale = boxes.std(axis=0)
    near = (((boxes / scale)[:, None] - (got / scale)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(got) == 9 and (np.diff(got.prod(axis=1)) >= 0).all()
    assert all(np.allclose(boxes[near == i].mean(axis=0), got[i], rtol=0.05) for i in range(9))
    clusters = QUERIES["ml10_point_clusters"](spark, SF).toPandas()
    noise = np.random.default_rng(6).normal(size=(200, 2))
    rows = spark.createDataFrame([(float(1000 * (i % 2) + a), float(1000 * (i % 2) + b)) for i, (a, b) in enumerate(noise)], "x double, y double")
    assert len(clusters) == 3 and np.abs(np.array(P.point_clusters(rows, 2)) - [[0, 0], [1000, 1000]]).max() <= 2


# matches and running scores


def test_hand_over_gives_losers_their_second_choice(spark):
    pairs = [("i", 1, 1, 0.9), ("i", 2, 1, 0.8), ("i", 2, 2, 0.7), ("i", 3, 2, 0.6), ("i", 3, 3, 0.5), ("j", 1, 1, 0.4)]
    rng = np.random.default_rng(2)
    pairs += [("k", a, b, float(v)) for a in range(12) for b in range(12) if (v := rng.integers(0, 40) / 40) > 0.3]
    want, used = set(), set()
    for image, a, b, _ in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if not {(image, "a", a), (image, "b", b)} & used:
            used |= {(image, "a", a), (image, "b", b)}
            want.add((image, a, b))
    frame = spark.createDataFrame(pairs, "image string, a int, b int, v double")
    got = {(r["image"], r["a"], r["b"]) for r in M.handed_over(frame, "image", "a", "b", "v").collect()}
    assert got == want and {("i", 1, 1), ("i", 2, 2), ("i", 3, 3)} <= got
    assert M.handed_over(frame.limit(0), "image", "a", "b", "v").count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_scores_of_a_hot_class(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(int(c), round(float(s), 2), i, bool(h)) for i, (c, s, h) in enumerate(zip(np.where(rng.random(400) < 0.9, 0, 1), rng.random(400), rng.random(400) < 0.5, strict=True))]
    frame = spark.createDataFrame(rows, "cls int, score double, id int, hit boolean")
    totals = frame.where("hit").groupBy("cls").agg(F.count("*").alias("total"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["id"]: r for r in M.precision_recall(frame, totals, "cls", ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in (0, 1):
        line = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))
        hits = np.cumsum([r[3] for r in line])
        precision = hits / np.arange(1, len(line) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        for r, tp, p, e in zip(line, hits, precision, envelope, strict=True):
            assert got[r[2]]["tp"] == tp and got[r[2]]["precision"] == pytest.approx(p) and got[r[2]]["envelope"] == pytest.approx(e)


def test_numbering_has_no_gaps_over_many_partitions(spark):
    frame = spark.range(1000).selectExpr("id % 7 as key", "id")
    got = [r["position"] for r in L.numbered(frame.repartition(13), ["key", "id"]).orderBy("key", "id").collect()]
    assert got == list(range(1, 1001))


def test_hulls_of_lines_and_squares(spark):
    square = [("s", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 2)])]
    line = [("l", i, float(i), float(2 * i)) for i in range(5)]
    got = {r["k"]: r["convex_hull"] for r in G.convex_hulls(spark.createDataFrame(square + line, "k string, seq int, x double, y double"), "k").collect()}
    assert got == {"s": 16.0, "l": 0.0}


def test_armatures_by_hand(spark):
    from math import atan2, degrees, hypot

    def armature(name, left, right):
        middle = [(name, "middle", i, float(i), 0.0) for i in range(4)]
        return middle + [(name, "outer", 10 * j + i, float(x), float(y)) for j, side in enumerate((left, right)) for i, (x, y) in enumerate(side)]

    below = [(1, -1), (2, -2), (3, -3)]
    rows = armature("upright", below, [(1, 1), (2, 2), (3, 3)]) + armature("tilted", below, [(1, 1), (2, 2), (5, 5)]) + armature("short", below, [(1, 1), (2, 2)])
    got = {r["obj"]: tuple(r)[1:] for r in K2.armature_traits(spark.createDataFrame(rows, "obj string, part string, seq int, x double, y double")).collect()}
    assert got["upright"][:4] == pytest.approx((6, 3, 0, 90)) and got["upright"][4:] == (None, None)
    assert got["tilted"] == pytest.approx((hypot(2, 8), 30 / hypot(2, 8), degrees(atan2(2, 8)), 90, 3.75, 0), abs=1e-6)
    assert got["short"] == (None,) * 6


@pytest.mark.parametrize("terms,root", [((1, -3, 2), 1), ((0, 2, -4), 2), ((1, 0, 1), None), ((1, 0, -4), 2), ((-1, 0, 4), 2), ((0, 0, 0), 0), ((0, 0, 1), None), ((2, 0, 0), 0)])
def test_the_root_nearer_to_zero(spark, terms, root):
    assert spark.range(1).select(K2.nearer_root(*[F.lit(float(t)) for t in terms])).first()[0] == root


def test_block_groups_stop_at_a_repeated_kind(spark):
    def group(rank, ratio, gap, n=4, major=20.0):
        return [("r", rank, float(i * gap), major, major / ratio) for i in range(n)]

    blobs = group(0, 1.75, 20) + group(1, 2.2, 10, major=10.0) + group(2, 1.75, 21) + group(3, 6.8, 2, major=20.0)
    frame = spark.createDataFrame(blobs, "ruler_id string, rank int, x double, major double, minor double")
    predicted = spark.createDataFrame([("r", 20.0), ("none", 20.0)], "ruler_id string, predicted double")
    got = {r["ruler_id"]: tuple(r)[1:] for r in U.block_factors(frame, predicted).collect()}
    assert got == {"r": (20.0, "average", "bigCM, halfCM"), "none": (0.0, "fail", "")}
    kinds = {r["rank"]: r["kind"] for r in U.block_kinds(frame).collect()}
    assert kinds == {0: "bigCM", 1: "halfCM", 2: "bigCM", 3: "mm"}


def test_medians_in_bounded_memory(spark):
    frame = spark.range(1001).selectExpr("'a' as k", "cast(id as double) as v")
    assert T.medians(frame, "k", ["v"]).first()["median_v"] == 500 and abs(T.medians(frame, "k", ["v"], 100).first()["median_v"] - 500) <= 15


# files


def test_the_separator_that_fits_the_lines_is_taken(spark, tmp_path):
    assert S.fitting_separator(["a,b;c", "1,2;3", "x"], "csv") == ","  # none fits all lines
    assert S.fitting_separator(["na,me;val,ue", "1;2", "3;4"], "csv") == ";"
    assert S.fitting_separator(['"a,b"|c', "1|2"], "txt") == "|"
    (tmp_path / "t.csv").write_text("na,me;val,ue\n1;2\n3;4\n")
    assert S.read_delimited(spark, str(tmp_path / "t.csv")).columns == ["na,me", "val,ue"]


def test_archives_of_unlike_separators(spark, tmp_path):
    for name, sep in (("a", "\t"), ("b", "|")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "multimedia.txt").write_text(f"coreid{sep}identifier\n1{sep}http://x/{name}.jpg\n")
    got = {(r["archive"], r["identifier"]) for r in S.read_archives(spark, f"{tmp_path}/*/multimedia.txt").collect()}
    assert got == {("a", "http://x/a.jpg"), ("b", "http://x/b.jpg")}


def test_archives_of_unlike_headers(spark, tmp_path):
    texts = {
        "a b": "id,family,note\n1,Rosaceae,\"x, y\"\n2,,\n",
        "c+d": "Family|ID|id\nFagaceae|3|4\n",
        "e%f": "id\tfamily\t\n5\tPoaceae\tz\n6\n",
        "g": "\"fam,ily\";id;x\nq;7;\n",
        "h": "id\n",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "occurrence.txt").write_text(text)
    got = S.read_archives(spark, f"{tmp_path}/*/occurrence.txt")
    assert got.columns == ["id", "family", "note", "ID1", "id2", "_c2", "fam,ily", "x", "archive"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == {
        ("1", "Rosaceae", "x, y", None, None, None, None, None, "a b"), ("2", None, None, None, None, None, None, None, "a b"), (None, "Fagaceae", None, "3", "4", None, None, None, "c+d"),
        ("5", "Poaceae", None, None, None, "z", None, None, "e%f"), ("6", None, None, None, None, None, None, None, "e%f"), ("7", None, None, None, None, None, "q", None, "g"),
    }


def test_colour_profiles_and_combined_tables(spark, tmp_path):
    (tmp_path / "colours.csv").write_text("Leaf,0,255,55,00FF37\nBud, 1,2,3\nbroken\n")
    assert [tuple(r) for r in S.read_colour_profile(spark, str(tmp_path / "colours.csv")).orderBy("name").collect()] == [("Bud", 1, 2, 3, "010203"), ("Leaf", 0, 255, 55, "00ff37")]
    for i in (1, 2):
        K.write_combined(spark.createDataFrame([(i, "x")], "id int, name string"), f"{tmp_path}/all")
    assert sorted(tuple(r) for r in K.read_combined(spark, f"{tmp_path}/all").collect()) == [("1", "x"), ("2", "x")]
    assert spark.read.text(f"{tmp_path}/all/header").count() == 1


def test_project_tables_are_looked_up_by_name(spark, tmp_path):
    images = spark.createDataFrame([("a", 1), ("b", 2)], "name string, width int")
    K.save_project({"images": images}, "herbarium", str(tmp_path))
    names = spark.createDataFrame([("b",), ("b",), ("z",)], "name string")
    assert [tuple(r) for r in K.project_rows(spark, "herbarium", "images", names).collect()] == [("b", 2)]
    spark.sql("DROP TABLE herbarium_images")


def test_packets_carry_info_and_categories(spark):
    images = spark.createDataFrame([(1, "a.jpg", 5, 6)], "id long, file_name string, width int, height int")
    annotations = spark.createDataFrame([(9, 1, 2, 3.0, [0.0])], "id long, image_id long, category_id int, area double, bbox array<double>")
    packet = K.coco_packets(images, annotations, ("leaf", "bud"), "labels").first()["packet"]
    assert '"categories":[{"id":0,"name":"leaf"},{"id":1,"name":"bud"}]' in packet and '"description":"labels"' in packet
