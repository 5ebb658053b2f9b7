"""Evaluation metrics and label-set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.operators import detections as D
from traitloom.operators import geometry as G
from traitloom.operators import metrics as M

from ._register import Registry
from .geometry_queries import _PAIRS, box_pairs
from .linkage_queries import _POINTS, points
from .views import LINE_ORDER, read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL
_ORDER = LINE_ORDER.split(", ")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_MATCH = f"""{_PAIRS}, hit AS (SELECT filename, pa, pb, max(round(iou, 9)) AS iou FROM o WHERE iou > 0.3 GROUP BY ALL), ma AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, pa ORDER BY iou DESC, pb) AS r FROM hit) WHERE r = 1),
  mb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, pb ORDER BY iou DESC, pa) AS q FROM ma) WHERE q = 1)"""


def _matches(spark, sf_dir):
    pairs = box_pairs(spark, sf_dir).withColumn("iou", F.round(G.overlaps("a", "b")["iou"], 9)).where(G.overlaps("a", "b")["iou"] > 0.3)
    return M.matched(pairs.groupBy("filename", "pa", "pb").agg(F.max("iou").alias("iou")), "filename", "pa", "pb", "iou")


@R.add(f", {_MATCH} SELECT filename, pa, pb, round(iou, 6) AS iou FROM mb", ("pixel_boxes",))
def jn14_matched_boxes(spark, sf_dir):
    return _rounded(_matches(spark, sf_dir), "iou")


_NEAR = f"""{_POINTS}, a AS (SELECT * FROM p WHERE seq < 16), b AS (SELECT * FROM p WHERE seq >= 16 AND seq < 16 + component % 17),
  d AS (SELECT a.component, 'predicted' AS side, a.seq AS point, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS distance FROM a LEFT JOIN b USING (component) GROUP BY ALL
    UNION ALL SELECT b.component, 'true', b.seq, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FROM b LEFT JOIN a USING (component) GROUP BY ALL)"""


def _distances(spark, sf_dir):
    all_points = points(spark, sf_dir).withColumnRenamed("seq", "point")
    return M.nearest_both_ways(all_points.where("point < 16"), all_points.where("point >= 16 and point < 16 + component % 17"), "component")


@R.add(f"WITH {_NEAR} SELECT component, side, point, round(distance, 6) AS distance FROM d")
def jn15_nearest_both_ways(spark, sf_dir):
    return _rounded(_distances(spark, sf_dir), "distance")


@R.add("""SELECT f.filename, n, m FROM (SELECT filename, count(*) AS n FROM detections WHERE l_linenumber % 2 = 1 GROUP BY filename) f JOIN (SELECT filename, count(*) AS m FROM detections WHERE l_linenumber % 2 = 0 GROUP BY filename) g USING (filename)""", ("detections",))
def jn16_results_with_truth(spark, sf_dir):
    return _counts(spark, sf_dir)


def _counts(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections")
    count = lambda odd, name: boxes.where(F.col("l_linenumber") % 2 == odd).groupBy("filename").agg(F.count("*").alias(name))
    return count(1, "n").join(count(0, "m"), "filename")


@R.add(""", c AS (SELECT filename, count(*) FILTER (l_linenumber % 2 = 1) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS m FROM detections GROUP BY filename), e AS (SELECT CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, CAST(n - m AS DOUBLE) AS e FROM c WHERE n > 0 AND m > 0)
  SELECT round(avg(e), 6) AS me, round(avg(abs(e)), 6) AS mae, round(avg(100 * e / m), 6) AS mpe, round(avg(abs(100 * e / m)), 6) AS mape, round(avg(e * e), 6) AS mse, round(corr(n, m), 6) AS r,
    round(1 - sum(e * e) / (sum(m * m) - sum(m) ** 2 / count(m)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse FROM e""", ("detections",))
def ag21_count_scores(spark, sf_dir):
    return _rounded(M.count_scores(_counts(spark, sf_dir)), "me", "mae", "mpe", "mape", "mse", "r", "r2", "rmse")


@R.add(f"""WITH {_NEAR}, s AS (SELECT CAST(radius AS INTEGER) AS radius, avg(CASE WHEN side = 'predicted' THEN CASE WHEN distance <= radius THEN 1.0 ELSE 0.0 END END) AS p, avg(CASE WHEN side = 'true' THEN CASE WHEN distance <= radius THEN 1.0 ELSE 0.0 END END) AS r
    FROM d, (SELECT unnest(range(0, 16)) AS radius) GROUP BY radius)
  SELECT radius, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM s""")
def ag22_location_scores(spark, sf_dir):
    return _rounded(M.location_scores(_distances(spark, sf_dir)), "precision", "recall", "f")


@R.add(f"""WITH {_NEAR} SELECT component, round(coalesce(avg(CASE WHEN side = 'predicted' THEN distance END) + avg(CASE WHEN side = 'true' THEN distance END), 1414.0), 6) AS ahd FROM d GROUP BY component""")
def ag23_averaged_hausdorff(spark, sf_dir):
    return _rounded(M.averaged_hausdorff(_distances(spark, sf_dir), "component", 1414.0), "ahd")


_CURVE = """h AS (SELECT *, l_linenumber % 2 = 1 AS hit FROM detections), w AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER v AS tp, count(*) OVER v AS turn FROM h
    WINDOW v AS (PARTITION BY cls ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING)),
  tot AS (SELECT cls, count(*) AS total FROM h WHERE hit GROUP BY cls), pr AS (SELECT w.*, tp / CAST(turn AS DOUBLE) AS precision, tp / CAST(total AS DOUBLE) AS recall FROM w JOIN tot USING (cls)),
  env AS (SELECT *, max(precision) OVER (PARTITION BY cls ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM pr)"""


def _curve(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").withColumn("hit", F.col("l_linenumber") % 2 == 1)
    return M.precision_recall(boxes, boxes.where("hit").groupBy("cls").agg(F.count("*").alias("total")), "cls", _ORDER)


@R.add(f", {_CURVE} SELECT cls, l_partkey, l_suppkey, filename, l_linenumber, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM env", ("detections",))
def wn10_precision_envelope(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir).select("cls", "l_partkey", "l_suppkey", "filename", "l_linenumber", "precision", "recall", "envelope"), "precision", "recall", "envelope")


@R.add(f""", {_CURVE}, x AS (SELECT cls, sum((recall - coalesce(prev, 0)) * envelope) AS ap FROM (SELECT *, lag(recall) OVER (PARTITION BY cls ORDER BY turn) AS prev FROM env) GROUP BY cls),
  g AS (SELECT c.cls, k, coalesce(max(envelope), 0) AS p FROM (SELECT DISTINCT cls FROM env) c CROSS JOIN (SELECT unnest(range(0, 101)) AS k) LEFT JOIN env e ON e.cls = c.cls AND floor(e.recall * 100 + 1e-9) >= k GROUP BY ALL)
  SELECT cls, round(ap, 6) AS ap, round(avg(p), 6) AS ap_grid FROM x JOIN g USING (cls) GROUP BY cls, ap""", ("detections",))
def ag24_average_precision(spark, sf_dir):
    return _rounded(M.average_precision(_curve(spark, sf_dir), "cls"), "ap", "ap_grid")


@R.add(f""", {_CURVE} SELECT cls, f1, score FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, score DESC) AS rn FROM (SELECT cls, score, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM env)) WHERE rn = 1""", ("detections",))
def ag24_best_f1(spark, sf_dir):
    return M.best_f1(_curve(spark, sf_dir), "cls")


_MATRIX = f"""{_MATCH}, pr AS (SELECT DISTINCT filename || ':' || l_partkey AS id, CAST(cls AS VARCHAR) AS cls FROM pixel_boxes WHERE l_linenumber % 2 = 1), gt AS (SELECT DISTINCT filename || ':' || l_partkey AS id, CAST(cls AS VARCHAR) AS cls FROM pixel_boxes WHERE l_linenumber % 2 = 0),
  ids AS (SELECT filename || ':' || pa AS prediction, filename || ':' || pb AS label FROM mb),
  cm AS (SELECT coalesce(p.cls, 'background') AS predicted, coalesce(t.cls, 'background') AS "true", count(*) AS n FROM (SELECT pr.id, pr.cls, ids.label FROM pr LEFT JOIN ids ON pr.id = ids.prediction) p FULL JOIN gt t ON p.label = t.id GROUP BY ALL)"""


def _matrix(spark, sf_dir):
    boxes = view(spark, sf_dir, "pixel_boxes").withColumn("id", F.concat_ws(":", "filename", F.col("l_partkey").cast("string")))
    side = lambda odd: boxes.where(F.col("l_linenumber") % 2 == odd).select("id", "cls").distinct()
    found = _matches(spark, sf_dir).select(F.concat_ws(":", "filename", F.col("pa").cast("string")).alias("prediction"), F.concat_ws(":", "filename", F.col("pb").cast("string")).alias("label"))
    return M.confusion(side(1), side(0), found)


@R.add(f', {_MATRIX} SELECT predicted, "true", n FROM cm', ("pixel_boxes",))
def ag25_confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


_HITS = f"""{_PAIRS}, hit AS (SELECT filename, pa, pb, max(round(iou, 9)) AS iou FROM o WHERE iou >= 0.5 AND pa % 11 = pb % 11 GROUP BY ALL), ma AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, pa ORDER BY iou DESC, pb) AS r FROM hit) WHERE r = 1),
  mb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, pb ORDER BY iou DESC, pa) AS q FROM ma) WHERE q = 1), pr AS (SELECT filename, l_partkey AS pa, cls, max(score) AS score FROM pixel_boxes WHERE l_linenumber % 2 = 1 GROUP BY ALL),
  tot AS (SELECT cls, count(*) AS total FROM (SELECT DISTINCT filename, l_partkey, cls FROM pixel_boxes WHERE l_linenumber % 2 = 0) GROUP BY cls), h AS (SELECT pr.*, t, coalesce(round(iou * 100, 7) >= t, false) AS hit FROM pr LEFT JOIN mb USING (filename, pa), (SELECT unnest(range(50, 100, 5)) AS t)),
  w AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER v AS tp, count(*) OVER v AS turn FROM h WINDOW v AS (PARTITION BY cls, t ORDER BY score DESC, filename, pa ROWS UNBOUNDED PRECEDING)),
  env AS (SELECT *, max(tp / CAST(turn AS DOUBLE)) OVER (PARTITION BY cls, t ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM w), x AS (SELECT cls, t, sum(CASE WHEN hit THEN envelope / total ELSE 0 END) AS ap FROM env JOIN tot USING (cls) GROUP BY cls, t)"""


def _overlap_precision(spark, sf_dir):
    """Average precision per class at overlaps of 50, 55, .. 95 percent of odd boxes with even ones of their class."""
    pairs = box_pairs(spark, sf_dir).withColumn("iou", G.overlaps("a", "b")["iou"]).where("iou >= 0.5 and pa % 11 = pb % 11").withColumn("iou", F.round("iou", 9))
    found = M.matched(pairs.groupBy("filename", "pa", "pb").agg(F.max("iou").alias("iou")), "filename", "pa", "pb", "iou").select("filename", "pa", "iou")
    boxes = view(spark, sf_dir, "pixel_boxes").withColumnRenamed("l_partkey", "pa")
    said = boxes.where("l_linenumber % 2 = 1").groupBy("filename", "pa", "cls").agg(F.max("score").alias("score"))
    totals = boxes.where("l_linenumber % 2 = 0").select("filename", "pa", "cls").distinct().groupBy("cls").agg(F.count("*").alias("total"))
    return M.mean_average_precision(said.join(found, ["filename", "pa"], "left"), totals, ["filename", "pa"], list(range(50, 100, 5)))


@R.add(f", {_HITS} SELECT round(0.1 * avg(ap) FILTER (t = 50) + 0.9 * avg(ap), 6) AS fitness FROM x", ("pixel_boxes",))
def ag26_fitness(spark, sf_dir):
    ap = _overlap_precision(spark, sf_dir)
    means = ap.agg(F.avg(F.when(F.col("threshold") == 50, F.col("ap"))).alias("a"), F.avg("ap").alias("b"))
    return means.select(F.round(M.fitness(F.col("a"), F.col("b")), 6).alias("fitness"))


@R.add(f", {_HITS} SELECT CAST(cls AS VARCHAR) AS cls, CAST(t AS INTEGER) AS threshold, round(ap, 6) AS ap FROM x", ("pixel_boxes",))
def ag24_precision_by_overlap(spark, sf_dir):
    return _rounded(_overlap_precision(spark, sf_dir), "ap")


@R.add(f""", {_MATRIX}, tr AS (SELECT "true" AS cls, sum(n) AS pos, sum(CASE WHEN predicted = "true" THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1), sd AS (SELECT predicted AS cls, sum(n) AS said FROM cm GROUP BY 1),
  j AS (SELECT cls, CAST(pos AS DOUBLE) AS pos, CAST(tp AS DOUBLE) AS tp, CAST(coalesce(said, 0) AS DOUBLE) AS said FROM tr LEFT JOIN sd USING (cls))
  SELECT round(avg(tp / (pos + said - tp)), 6) AS miou, round(sum(tp / (pos + said - tp) * pos) / sum(pos), 6) AS fwiou, round(avg(tp / pos), 6) AS macc, round(sum(tp) / sum(pos), 6) AS pacc FROM j""", ("pixel_boxes",))
def vd10_segmentation_scores(spark, sf_dir):
    return _rounded(M.segmentation_scores(_matrix(spark, sf_dir)), "miou", "fwiou", "macc", "pacc")


@R.add(f"""WITH {_POINTS} SELECT a.component, round(sum(CASE WHEN a.seq % 3 > 0 THEN exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * 0.5) ** 2 / (50000 * 2 + 1e-7)) ELSE 0 END) / (count(*) FILTER (a.seq % 3 > 0) + 1e-7), 6) AS oks
  FROM p a JOIN p b ON a.component = b.component AND b.seq = a.seq + 16 WHERE a.seq < 16 GROUP BY a.component""")
def vd12_keypoint_similarity(spark, sf_dir):
    all_points = points(spark, sf_dir)
    said = all_points.where("seq < 16").select("component", "seq", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("seq") % 3 > 0).alias("visible"), F.lit(0.5).alias("sigma"), F.lit(50000.0).alias("area"))
    true = all_points.where("seq >= 16").select("component", (F.col("seq") - 16).alias("seq"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return _rounded(M.keypoint_similarity(said.join(true, ["component", "seq"]), ["component"]), "oks")


@R.add("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN bad IS NULL THEN 'missing' WHEN bad THEN 'corrupt' ELSE 'found' END AS state FROM (SELECT id FROM occurrence) o
  FULL JOIN (SELECT filename, bool_or(least(xc, yc, w, h) < 0 OR greatest(xc, yc, w, h) > 1) AS bad FROM (SELECT filename, cls, xc, yc, w * 2.1 AS w, h FROM detections) GROUP BY filename) d ON d.filename = o.id) GROUP BY state""", ("detections", "occurrence"))
def vd01_label_quality(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").withColumn("w", F.col("w") * 2.1)
    return D.label_quality(boxes, view(spark, sf_dir, "occurrence").select(F.col("id").alias("filename")), "filename")


_SPLIT = "CASE WHEN u < 0.9 THEN 'train' ELSE 'val' END"


@R.add(f"""SELECT id, {_SPLIT} AS split FROM (SELECT id, CAST(('0x' || substr(md5(id || ':7'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM occurrence) WHERE id IN (SELECT filename FROM detections)""", ("detections", "occurrence"))
def vd02_weighted_split(spark, sf_dir):
    from traitloom.operators.sampling import split

    labelled = view(spark, sf_dir, "occurrence").select("id").join(view(spark, sf_dir, "detections").select(F.col("filename").alias("id")), "id", "left_semi")
    return split(labelled, {"train": 0.9, "val": 0.1}, seed=7)


@R.add("""SELECT CASE WHEN CAST(filename AS BIGINT) % 5 = 0 THEN 'val' ELSE 'train' END AS split, cls, count(*) AS instances, count(DISTINCT filename) AS images FROM detections GROUP BY ALL""", ("detections",))
def vd03_split_statistics(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections")
    images = boxes.select("filename").distinct().withColumn("split", F.when(F.col("filename").cast("long") % 5 == 0, "val").otherwise("train"))
    return D.split_statistics(boxes.select("filename", "cls"), images, "filename")


_WEIGHTS = "cw AS (SELECT cls, 1 / CAST(count(*) AS DOUBLE) AS iw FROM detections GROUP BY cls), cn AS (SELECT cls, iw / sum(iw) OVER () AS weight FROM cw)"


@R.add(f", {_WEIGHTS} SELECT cls, round(weight, 8) AS weight FROM cn", ("detections",))
def vd04_class_weights(spark, sf_dir):
    return _rounded(D.class_weights(view(spark, sf_dir, "detections")), "weight", digits=8)


@R.add(f", {_WEIGHTS} SELECT filename, round(sum(weight), 8) AS weight FROM detections JOIN cn USING (cls) GROUP BY filename", ("detections",))
def vd04_image_weights(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections")
    return _rounded(D.image_weights(boxes, D.class_weights(boxes), "filename"), "weight", digits=8)


@R.add("""SELECT round(avg(CASE WHEN best > 0.25 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(best), 6) AS mean_best FROM (SELECT greatest(least(least(w / 0.1, 0.1 / w), least(h / 0.05, 0.05 / h)), least(least(w / 0.3, 0.3 / w), least(h / 0.08, 0.08 / h))) AS best FROM detections WHERE w > 0 AND h > 0)""", ("detections",))
def vd05_anchor_recall(spark, sf_dir):
    return _rounded(D.anchor_recall(view(spark, sf_dir, "detections"), [(0.1, 0.05), (0.3, 0.08)]), "recall", "mean_best")


@R.add("SELECT filename, cls, l_linenumber FROM detections WHERE filename IN (SELECT filename FROM detections WHERE cls > 2)", ("detections",))
def vd06_with_uncrowded(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").select("filename", "cls", "l_linenumber").withColumn("crowd", F.col("cls") <= 2)
    return D.with_uncrowded(boxes, "filename").drop("crowd")


@R.add("SELECT filename, count(*) FILTER (score > 0.3) AS n FROM detections GROUP BY filename HAVING count(*) FILTER (score > 0.3) >= 3", ("detections",))
def vd07_with_visible(spark, sf_dir):
    return D.with_visible(view(spark, sf_dir, "detections").withColumn("visible", F.col("score") > 0.3), "filename", 3)


@R.add("SELECT cls, count(*) AS n FROM detections GROUP BY ROLLUP (cls)", ("detections",))
def vd08_histogram(spark, sf_dir):
    return D.histogram(view(spark, sf_dir, "detections"))


@R.add(""", pr AS (SELECT DISTINCT filename, cls FROM detections), f AS (SELECT cls, greatest(1.0::DOUBLE, sqrt(0.5 / (count(*) / CAST((SELECT count(DISTINCT id) FROM occurrence) AS DOUBLE)))) AS factor FROM pr GROUP BY cls)
  SELECT id AS filename, round(coalesce(max(factor), 1), 6) AS factor FROM occurrence LEFT JOIN pr ON pr.filename = occurrence.id LEFT JOIN f USING (cls) GROUP BY id""", ("detections", "occurrence"))
def vd09_repeat_factors(spark, sf_dir):
    images = view(spark, sf_dir, "occurrence").select(F.col("id").alias("filename"))
    return _rounded(D.repeat_factors(view(spark, sf_dir, "detections"), images, "filename", 0.5), "factor")


@R.add(f", {_CURVE}, g AS (SELECT c.cls, k, coalesce(max(envelope), 0) AS p FROM (SELECT DISTINCT cls FROM env) c CROSS JOIN (SELECT unnest(range(0, 11)) AS k) LEFT JOIN env e ON e.cls = c.cls AND floor(e.recall * 10 + 1e-9) >= k GROUP BY ALL) SELECT cls, round(avg(p), 6) AS ap_grid FROM g GROUP BY cls", ("detections",))
def vd11_eleven_point_precision(spark, sf_dir):
    return _rounded(M.average_precision(_curve(spark, sf_dir), "cls", grid=11).select("cls", "ap_grid"), "ap_grid")


@R.add("""SELECT filename, l_partkey, l_linenumber, (x2 - x1) * (y2 - y1) AS area, least(greatest(x1, 0), 1000) AS cx1, least(greatest(y1, 0), 1000) AS cy1, least(greatest(x2, 0), 1000) AS cx2, least(greatest(y2, 0), 1000) AS cy2,
  x2 > x1 AND y2 > y1 AS nonempty, x1 >= -5 AND y1 >= -5 AND x2 < 1005 AND y2 < 1005 AS inside FROM pixel_boxes""", ("pixel_boxes",))
def vd13_box_checks(spark, sf_dir):
    return D.box_checks(view(spark, sf_dir, "pixel_boxes"), 1000, 1000, 5).select("filename", "l_partkey", "l_linenumber", "area", "cx1", "cy1", "cx2", "cy2", "nonempty", "inside")


# all pairs of a sheet by falling overlap; a pair is taken where neither end was taken before
@R.add(f""", {_PAIRS}, hit AS (SELECT filename, pa, pb, max(round(iou, 9)) AS iou FROM o WHERE iou > 0.3 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY iou DESC, pa, pb) AS rn FROM hit)
  SELECT filename, pb AS track, pa AS identity FROM (WITH RECURSIVE w(filename, rn, used_a, used_b, took) AS (
      SELECT filename, 1::BIGINT, [pa], [pb], true FROM r WHERE rn = 1
      UNION ALL SELECT r.filename, r.rn, CASE WHEN list_contains(used_a, pa) OR list_contains(used_b, pb) THEN used_a ELSE list_append(used_a, pa) END,
        CASE WHEN list_contains(used_a, pa) OR list_contains(used_b, pb) THEN used_b ELSE list_append(used_b, pb) END, NOT (list_contains(used_a, pa) OR list_contains(used_b, pb)) FROM w JOIN r ON r.filename = w.filename AND r.rn = w.rn + 1)
    SELECT filename, rn FROM w WHERE took) JOIN r USING (filename, rn)""", ("pixel_boxes",))
def vd14_handed_over(spark, sf_dir):
    pairs = box_pairs(spark, sf_dir).withColumn("iou", G.overlaps("a", "b")["iou"]).where("iou > 0.3").groupBy("filename", "pa", "pb").agg(F.round(F.max("iou"), 9).alias("iou"))
    return M.handed_over(pairs, "filename", "pa", "pb", "iou").select("filename", F.col("pb").alias("track"), F.col("pa").alias("identity"))


@R.add("SELECT filename, cls, round(xc, 6) AS xc, l_linenumber FROM detections", ("detections",))
def src06_parsed_labels(spark, sf_dir):
    line = F.concat_ws(" ", "cls", *[F.col(c).cast("string") for c in ("xc", "yc", "w", "h", "score")])
    files = view(spark, sf_dir, "detections").select("filename", "l_linenumber", line.alias("text"))
    keyed = files.withColumn("key", F.concat_ws("|", "filename", F.col("l_linenumber").cast("string")))
    boxes = D.parsed_labels(keyed, "key", "text")
    return boxes.select(F.get(F.split("key", r"\|"), F.lit(0)).alias("filename"), "cls", F.round("xc", 6).alias("xc"), F.get(F.split("key", r"\|"), F.lit(1)).cast("int").alias("l_linenumber"))


@R.add(f"SELECT filename, string_agg(cls || ' ' || l_partkey, chr(10) ORDER BY {LINE_ORDER}) AS text FROM detections GROUP BY filename", ("detections",))
def snk05_label_lines(spark, sf_dir):
    line = F.concat_ws(" ", "cls", "l_partkey")
    lines = F.array_sort(F.collect_list(F.struct(*_ORDER, line.alias("line"))))
    return view(spark, sf_dir, "detections").groupBy("filename").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"))


@R.add("""SELECT host, CAST(id // 10000 AS BIGINT) AS part, '[' || string_agg('{"id":' || id || ',"status":"' || status || '"}', ',' ORDER BY id) || ']' AS failures FROM download_log WHERE status <> 'ok' GROUP BY ALL""", ("download_log",))
def snk08_failures_by_host(spark, sf_dir):
    from traitloom.operators.stats import failures_by_host

    return failures_by_host(view(spark, sf_dir, "download_log"))


@R.add("SELECT coalesce(a.k, b.k) AS archive, coalesce(n, 0) AS occurrences, coalesce(m, 0) AS images FROM (SELECT family AS k, count(*) AS n FROM occurrence GROUP BY 1) a FULL JOIN (SELECT family AS k, count(*) AS m FROM multimedia JOIN occurrence USING (id) GROUP BY 1) b ON a.k = b.k", ("occurrence", "multimedia"))
def src14_row_counts(spark, sf_dir):
    occurrence = view(spark, sf_dir, "occurrence")
    images = view(spark, sf_dir, "multimedia").join(occurrence.select("id", "family"), "id")
    one = occurrence.groupBy(F.col("family").alias("archive")).agg(F.count("*").alias("occurrences"))
    return one.join(images.groupBy(F.col("family").alias("archive")).agg(F.count("*").alias("images")), "archive", "full_outer").na.fill(0)
