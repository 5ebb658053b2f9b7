"""Named functions, table functions, caller-supplied functions and aggregates, streamed tracks, clusters."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.functions import registered
from traitloom.operators import detections as D
from traitloom.operators import extension as E
from traitloom.operators import judges as J
from traitloom.operators import rulers as U
from traitloom.sources import readers as S
from traitloom.sources import writers as W_
from traitloom.streaming import retries as Y
from traitloom.streaming import tracking as K

from ._register import Registry
from .io_queries import _finished, _folder
from .metrics_queries import _NEAR, _counts, _distances, _rounded
from .metrics_queries import ORACLE_SQL as METRICS_SQL
from .views import read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL

# every 17th line lacks fields, every 19th has a word for a number
_LINES = """CASE WHEN l_partkey % 17 = 0 THEN CAST(cls AS STRING) || ' 0.5' WHEN l_partkey % 19 = 0 THEN CAST(cls AS STRING) || ' 0.5 x 0.25 0.25'
  ELSE CAST(cls AS STRING) || ' ' || CAST(l_partkey % 997 AS STRING) || ' ' || CAST(l_suppkey % 89 AS STRING) || ' ' || CAST(l_linenumber AS STRING) || ' 0.25' || CASE WHEN l_suppkey % 2 = 0 THEN ' 0.75' ELSE '' END END"""


@R.add(f""", l AS (SELECT filename, l_linenumber, {_LINES.replace("STRING", "VARCHAR")} AS line, row_number() OVER (PARTITION BY filename ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS ln FROM detections),
  f AS (SELECT filename, ln, string_split(line, ' ') AS p FROM l),
  y AS (SELECT filename, ln, CASE WHEN len(p) < 5 THEN 'fields' WHEN p[3] = 'x' THEN 'number' END AS problem, p FROM f),
  n AS (SELECT filename, CAST(ln AS INTEGER) AS line, problem, CASE WHEN problem IS NULL THEN CAST(p[1] AS INTEGER) END AS cls, CASE WHEN problem IS NULL THEN CAST(p[2] AS DOUBLE) END AS xc, CASE WHEN problem IS NULL THEN CAST(p[3] AS DOUBLE) END AS yc,
    CASE WHEN problem IS NULL THEN CAST(p[4] AS DOUBLE) END AS w, CASE WHEN problem IS NULL THEN CAST(p[5] AS DOUBLE) END AS h, CASE WHEN problem IS NULL AND len(p) > 5 THEN CAST(p[6] AS DOUBLE) END AS score FROM y)
  SELECT *, CAST(trunc((xc - w / 2) * 1000) AS BIGINT) AS x1, CAST(trunc((yc + h / 2) * 2000) AS BIGINT) AS y2 FROM n""", ("detections",))
def ud04_label_rows(spark, sf_dir):
    """A table function over label texts and a named row function, as SQL alone."""
    registered.register(spark)
    view(spark, sf_dir, "detections").createOrReplaceTempView("detections_")
    return spark.sql(f"""
        WITH files AS (SELECT filename, array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, {_LINES} AS line))), s -> s.line), '\n') AS text
                       FROM detections_ GROUP BY filename)
        SELECT filename, line, problem, cls, xc, yc, w, h, score, corners.x1, corners.y2
        FROM (SELECT f.filename, y.*, pixel_corners(y.xc, y.yc, y.w, y.h, 1000, 2000) AS corners FROM files f, LATERAL parse_yolo(f.text) y)""")


@R.add(""", n AS (SELECT filename, string_split('H_' || filename || '_' || 'fam' || CAST(cls AS VARCHAR) || CASE WHEN cls % 2 = 0 THEN '_gen_spec' ELSE '' END, '_') AS p, cls FROM detections)
  SELECT filename, cls, CASE WHEN len(p) >= 4 THEN p[3] END AS family, CASE WHEN len(p) >= 4 THEN p[3] || '_' || p[4] || '_' || p[5] END AS fullname, CAST(cls * 20 AS INTEGER) AS r FROM n""", ("detections",))
def ud01_named_functions(spark, sf_dir):
    """Row functions with several results under SQL names."""
    registered.register(spark)
    view(spark, sf_dir, "detections").createOrReplaceTempView("detections_")
    return spark.sql("""
        SELECT filename, cls, parts.family, parts.fullname, hex_to_rgb(concat('#', lpad(hex(cls * 20), 2, '0'), '0000')).r AS r
        FROM (SELECT filename, cls, file_name_parts(concat('H_', filename, '_fam', cls, CASE WHEN cls % 2 = 0 THEN '_gen_spec' ELSE '' END)) AS parts FROM detections_)""")


def _longest(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows, summed quantity and the five highest prices of some rows of a group."""
    best = frame.sort_values(["l_extendedprice", "l_orderkey", "l_linenumber"], ascending=[False, True, True]).head(5)
    return pd.DataFrame({"n": [len(frame)], "quantity": [float(frame["w"].sum())], "orders": [best["l_orderkey"].tolist()], "prices": [[float(p) for p in best["l_extendedprice"]]], "lines": [best["l_linenumber"].tolist()]})


def _longest_of_all(parts: pd.DataFrame) -> pd.DataFrame:
    every = sorted((-p, o, n) for ps, os, ns in zip(parts["prices"], parts["orders"], parts["lines"]) for p, o, n in zip(ps, os, ns))[:5]
    return pd.DataFrame({"n": [int(parts["n"].sum())], "quantity": [float(parts["quantity"].sum())], "orders": [[x[1] for x in every]], "prices": [[-x[0] for x in every]], "lines": [[x[2] for x in every]]})


@R.add(""", g AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 'half' ELSE 'k' || CAST(cls AS VARCHAR) END AS g FROM detections),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM g)
  SELECT g, count(*) AS n, round(sum(w), 6) AS quantity, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 5) AS orders FROM r GROUP BY g""", ("detections",))
def ud02_group_function(spark, sf_dir):
    """A caller's group function where one group has half of all rows, of which no task holds more than a part."""
    rows = view(spark, sf_dir, "detections").withColumn("g", F.when(F.col("l_orderkey") % 2 == 0, "half").otherwise(F.concat(F.lit("k"), "cls")))
    schema = "n long, quantity double, orders array<long>, prices array<double>, lines array<long>"
    done = E.apply_in_parts(rows.select("g", "w", "l_orderkey", "l_linenumber", "l_extendedprice"), ["g"], _longest, _longest_of_all, schema, rows=5_000)
    return done.select("g", "n", F.round("quantity", 6).alias("quantity"), F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@R.add(METRICS_SQL["ag21_count_scores"])
def ud03_count_judge(spark, sf_dir):
    """The count errors by an aggregate whose states merge."""
    return _rounded(E.aggregate_by(_counts(spark, sf_dir).select("n", "m"), [], J.CountJudge()), "me", "mae", "mpe", "mape", "mse", "r", "r2", "rmse")


@R.add(METRICS_SQL["ag22_location_scores"])
def ud03_place_judge(spark, sf_dir):
    """Precision, recall and F at every radius by an aggregate whose states merge."""
    judged = E.aggregate_by(_distances(spark, sf_dir).select("side", "distance"), [], J.PlaceJudge())
    rows = judged.select(F.posexplode(F.arrays_zip("precision", "recall", "f")).alias("radius", "s"))
    return rows.select("radius", *[F.round(F.col("s")[c], 6).alias(c) for c in ("precision", "recall", "f")])


@R.add(METRICS_SQL["ag23_averaged_hausdorff"])
def ud03_hausdorff_judge(spark, sf_dir):
    """The averaged Hausdorff distance of every leaf by the same aggregate, per group."""
    judged = E.aggregate_by(_distances(spark, sf_dir).select("component", "side", "distance"), ["component"], J.PlaceJudge(0))
    return judged.select("component", F.round(F.coalesce(F.col("mean_predicted") + F.col("mean_true"), F.lit(1414.0)), 6).alias("ahd"))


# least squares of the first j values in c clusters, with the ends of the clusters before the last
@R.add(""", s AS (SELECT ruler_id, strip, avg(x) AS mean FROM ticks GROUP BY ALL), d AS (SELECT ruler_id, mean AS v, count(*) AS n FROM s GROUP BY ALL),
  p AS MATERIALIZED (SELECT ruler_id, v, row_number() OVER w AS j, sum(n) OVER w AS sn, sum(n * v) OVER w AS sv, sum(n * v * v) OVER w AS sq, CAST(ruler_id AS INTEGER) % 3 + 2 AS k FROM d WINDOW w AS (PARTITION BY ruler_id ORDER BY v)),
  dp AS (WITH RECURSIVE dp(ruler_id, c, j, cost, ends) AS (
      SELECT ruler_id, 1, j, sq - sv * sv / sn, CAST([] AS BIGINT[]) FROM p
      UNION ALL
      SELECT b.ruler_id, a.c + 1, b.j, min(a.cost + b.sq - e.sq - (b.sv - e.sv) ** 2 / (b.sn - e.sn)),
        arg_min(list_append(a.ends, a.j), (round(a.cost + b.sq - e.sq - (b.sv - e.sv) ** 2 / (b.sn - e.sn), 6), a.j))
      FROM dp a JOIN p e ON e.ruler_id = a.ruler_id AND e.j = a.j JOIN p b ON b.ruler_id = a.ruler_id AND b.j > a.j WHERE a.c < b.k GROUP BY b.ruler_id, a.c, b.j)
    SELECT * FROM dp),
  last AS (SELECT ruler_id, max(j) AS top, least(max(j), max(k)) AS kk FROM p GROUP BY ruler_id),
  best AS (SELECT dp.ruler_id, ends FROM dp JOIN last ON dp.ruler_id = last.ruler_id AND dp.j = top AND dp.c = kk),
  cl AS (SELECT s.ruler_id, s.strip, s.mean, CAST(len(list_filter(ends, lambda e: e < p.j)) AS INTEGER) AS cluster FROM s JOIN p ON p.ruler_id = s.ruler_id AND p.v = s.mean JOIN best ON best.ruler_id = s.ruler_id),
  z AS (SELECT ruler_id, cluster, count(*) AS size, avg(mean) AS centre FROM cl GROUP BY ALL), m AS (SELECT ruler_id, arg_max(cluster, (size, -cluster)) AS most FROM z GROUP BY ruler_id)
  SELECT cl.ruler_id, strip, cl.cluster, round(centre, 9) AS centre, cl.cluster = most AS dominant FROM cl JOIN z ON z.ruler_id = cl.ruler_id AND z.cluster = cl.cluster JOIN m ON m.ruler_id = cl.ruler_id""", ("ticks",))
def ml08_k_clusters(spark, sf_dir):
    """Strip means in one cluster more than a ruler has units, exact, with the dominant one."""
    strips = view(spark, sf_dir, "ticks").groupBy("ruler_id", "strip").agg(F.avg("x").alias("mean"))
    units = F.col("ruler_id").cast("int") % 3 + 1
    found = U.k_clusters(strips.withColumn("k", units + 1), "ruler_id", "mean", "k")
    return found.select("ruler_id", "strip", "cluster", F.round("centre", 9).alias("centre"), "dominant")


_FRAMES = """f AS (SELECT 'camera' || CAST(l_suppkey AS VARCHAR) AS source, year(l_shipdate) * 12 + month(l_shipdate) AS frame, x1, y1, x2, y2,
    row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) ORDER BY CAST(filename AS BIGINT), l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS box FROM pixel_boxes)"""


@R.add(f""", {_FRAMES},
  o AS (SELECT a.source, b.frame, a.box AS pa, b.box AS pb, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)::DOUBLE * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter,
        (a.x2 - a.x1)::DOUBLE * (a.y2 - a.y1) + (b.x2 - b.x1)::DOUBLE * (b.y2 - b.y1) AS whole FROM f a JOIN f b ON a.source = b.source AND b.frame = a.frame + 1),
  hit AS (SELECT source, frame, pa, pb, inter / (whole - inter) AS iou FROM o WHERE whole > inter AND inter / (whole - inter) >= 0.3),
  r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, frame ORDER BY iou DESC, pa, pb) AS rn FROM hit),
  took AS (WITH RECURSIVE w(source, frame, rn, used_a, used_b, took) AS (
      SELECT source, frame, 1::BIGINT, [pa], [pb], true FROM r WHERE rn = 1
      UNION ALL SELECT r.source, r.frame, r.rn, CASE WHEN list_contains(used_a, pa) OR list_contains(used_b, pb) THEN used_a ELSE list_append(used_a, pa) END,
        CASE WHEN list_contains(used_a, pa) OR list_contains(used_b, pb) THEN used_b ELSE list_append(used_b, pb) END, NOT (list_contains(used_a, pa) OR list_contains(used_b, pb))
      FROM w JOIN r ON r.source = w.source AND r.frame = w.frame AND r.rn = w.rn + 1) SELECT source, frame, rn FROM w WHERE took),
  link AS MATERIALIZED (SELECT source, frame, pa, pb FROM took JOIN r USING (source, frame, rn)),
  chain AS (WITH RECURSIVE c(source, frame, box, since, first_box) AS (
      SELECT source, frame, box, frame, box FROM f WHERE NOT EXISTS (SELECT 1 FROM link WHERE link.source = f.source AND link.frame = f.frame AND link.pb = f.box)
      UNION ALL SELECT l.source, l.frame, l.pb, c.since, c.first_box FROM c JOIN link l ON l.source = c.source AND l.frame = c.frame + 1 AND l.pa = c.box) SELECT * FROM c)
  SELECT source, CAST(frame AS INTEGER) AS frame, box, CAST(since AS INTEGER) AS since, first_box FROM chain""", ("pixel_boxes",))
def vd14_tracked(spark, sf_dir):
    """Boxes of many cameras as a stream of files, a frame a month: identities handed over from frame to frame."""
    boxes = view(spark, sf_dir, "pixel_boxes").withColumn("image", F.col("filename").cast("long")).drop("filename")
    years = boxes.agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    january = lambda year: F.make_timestamp(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    place = W.partitionBy("l_suppkey", "ts").orderBy("image", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    corners = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    framed = lambda some: some.repartition("l_suppkey").withColumn("ts", F.date_trunc("month", "l_shipdate")).select(F.concat(F.lit("camera"), F.col("l_suppkey").cast("string")).alias("source"), "ts", F.row_number().over(place).cast("long").alias("box"), *corners)
    folder = _folder(spark)
    for year in range(years[0], years[1] + 1):  # files arrive year by year, a camera's year in one file
        framed(boxes.where((F.col("l_shipdate") >= january(year)) & (F.col("l_shipdate") < january(year + 1)))).write.mode("append").parquet(f"{folder}/frames")
    beat = spark.range(1, numPartitions=1).select(F.lit("").alias("source"), january(years[1] + 9).alias("ts"), F.lit(None).cast("long").alias("box"), *[F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    beat.write.mode("append").parquet(f"{folder}/frames")  # a heartbeat, so that the last frames come out
    files = len(spark.read.schema(beat.schema).parquet(f"{folder}/frames").inputFiles())
    at_once = max(16, math.ceil(files / (years[1] - years[0] + 1)))  # about a year a micro-batch, however many files that is
    stream = spark.readStream.schema(beat.schema).option("maxFilesPerTrigger", at_once).parquet(f"{folder}/frames")
    with K.state_store(spark):
        done = _finished(spark, K.tracked(stream, threshold=0.3, hold=31 * 86_400_000, late="800 days"))
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    return done.select("source", month("ts").alias("frame"), "box", month("since").alias("since"), "first_box")


@R.add(""", t AS (SELECT id, status, [k FOR k IN [2, 3, 4] IF (id + k) % 4 = 0] AS ok FROM download_log WHERE status = 'retry')
  SELECT id, CAST(CASE WHEN len(ok) > 0 THEN ok[1] ELSE 4 END AS INTEGER) AS attempts, CASE WHEN len(ok) > 0 THEN 'ok' ELSE 'given_up' END AS action FROM t""", ("download_log",))
def st04_retried(spark, sf_dir):
    """Failed downloads offered again until they succeed or have been tried four times; every micro-batch's offers are taken and reported back."""
    folder = _folder(spark)
    first = view(spark, sf_dir, "download_log").where("status = 'retry'").select("id", F.lit(1).alias("attempt"), "status")
    first.write.parquet(f"{folder}/results")
    asked = first.select("id").distinct().count()
    results = spark.readStream.schema("id long, attempt int, status string").parquet(f"{folder}/results")

    def take(batch, batch_id):
        batch = batch.persist()
        batch.where("action <> 'offer'").write.mode("overwrite").parquet(f"{folder}/ended/batch={batch_id}")
        offers = batch.where("action = 'offer'")
        if not offers.isEmpty():
            took = F.when((F.col("id") + F.col("attempt")) % 4 == 0, "ok").otherwise("retry")
            offers.select("id", "attempt", took.alias("status")).write.mode("append").parquet(f"{folder}/results")
        batch.unpersist()

    with K.state_store(spark):
        stream = Y.retried(results, most=4, delay_ms=0).writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").start()
    ended = spark.createDataFrame([], Y.OUTPUT)
    try:
        while stream.isActive and ended.count() < asked:  # timers keep the stream alive, so it is stopped from here
            stream.awaitTermination(1)
            if stream.lastProgress is not None:
                ended = spark.read.schema(Y.OUTPUT).parquet(f"{folder}/ended")
    finally:
        stream.stop()
    return spark.read.schema(Y.OUTPUT).parquet(f"{folder}/ended").select("id", F.col("attempt").alias("attempts"), "action")


@R.add(""", e AS (SELECT 'Ruler' AS entity, filename, CAST(l_linenumber % 3 AS INTEGER) AS batch, CAST(conversion_mean AS VARCHAR) AS value, 16 AS columns FROM ruler_records
    UNION ALL SELECT 'Measurements', component, CAST(CAST(component AS INTEGER) % 3 AS INTEGER), CAST(area AS VARCHAR), 44 FROM measurements
    UNION ALL SELECT 'EFD', component, CAST(CAST(component AS INTEGER) % 3 AS INTEGER), '[1.5,2.5]', 58 FROM measurements
    UNION ALL SELECT 'Landmarks', component, CAST(CAST(component AS INTEGER) % 3 AS INTEGER), CAST(lobes AS VARCHAR), 65 FROM (SELECT component, CAST(component AS INTEGER) % 7 AS lobes FROM measurements))
  SELECT entity, filename, 'run__' || entity || '__' || CAST(batch + 1 AS VARCHAR) || 'of3.csv' AS file, CASE WHEN entity IN ('Ruler', 'Measurements') THEN CAST(round(CAST(value AS DOUBLE), 6) AS VARCHAR) ELSE value END AS value, columns FROM e""", ("ruler_records", "measurements"))
def snk01_entity_layouts(spark, sf_dir):
    """The four batch tables written in their fixed layouts and read back."""
    folder, out = _folder(spark), None
    rulers = view(spark, sf_dir, "ruler_records").select("filename", "conversion_mean", (F.col("l_linenumber") % 3).alias("batch"))
    leaves = view(spark, sf_dir, "measurements").select(F.col("component").alias("filename"), (F.col("component").cast("int") % 3).alias("batch"), "area")
    tables = {
        "Ruler": (rulers, "conversion_mean"),
        "Measurements": (leaves, "area"),
        "EFD": (leaves.select("filename", "batch", F.array(F.lit(1.5), F.lit(2.5)).alias("coeffs_0")), "coeffs_0"),
        "Landmarks": (leaves.select("filename", "batch", (F.col("filename").cast("int") % 7).alias("lobe_count")), "lobe_count"),
    }
    for entity, (rows, value) in tables.items():
        W_.write_entity(rows, f"{folder}/{entity}", "run", entity, "batch", 3)
        found = W_.read_entity(spark, f"{folder}/{entity}", entity)
        text = F.round(F.col(value).cast("double"), 6).cast("string") if entity in ("Ruler", "Measurements") else F.col(value)
        found = found.select(F.lit(entity).alias("entity"), "filename", "file", text.alias("value"), F.lit(len(found.columns) - 1).alias("columns"))
        out = found if out is None else out.unionByName(found)
    return out


def _vocabularies() -> str:
    return "v(vocabulary, cls, name) AS (VALUES " + ", ".join(f"('{v}', {i}, '{n}')" for v, names in D.VOCABULARIES.items() for i, n in enumerate(names)) + ")"


@R.add(f""", {_vocabularies()}, k AS (SELECT DISTINCT vocabulary FROM v)
  SELECT filename, l_linenumber, l_partkey, vocabulary, coalesce(name, 'invalid class') AS name, CASE WHEN name IS NOT NULL THEN d.cls END AS back
  FROM detections d CROSS JOIN k LEFT JOIN v USING (vocabulary, cls)""", ("detections",))
def prj13_vocabularies(spark, sf_dir):
    """Class names in every vocabulary, and their indexes again."""
    boxes, out = view(spark, sf_dir, "detections").select("filename", "l_linenumber", "l_partkey", "cls"), None
    for vocabulary in D.VOCABULARIES:
        named = boxes.withColumn("name", D.class_name(F.col("cls"), vocabulary))
        named = named.select("filename", "l_linenumber", "l_partkey", F.lit(vocabulary).alias("vocabulary"), "name", D.class_index(F.col("name"), vocabulary).alias("back"))
        out = named if out is None else out.unionByName(named)
    return out


@R.add("""SELECT CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(coalesce(sum(n), 0) AS BIGINT) AS instances, count(*) AS images, count(*) FILTER (n IS NULL) AS unlabelled
  FROM (SELECT DISTINCT id FROM occurrence) LEFT JOIN (SELECT filename AS id, count(*) AS n FROM detections WHERE cls > 8 GROUP BY filename) USING (id) GROUP BY 1""", ("occurrence", "detections"))
def vd03_image_statistics(spark, sf_dir):
    """Boxes, images and images without a box per split."""
    images = view(spark, sf_dir, "occurrence").select("id", F.when(F.col("id").cast("long") % 5 == 0, "val").otherwise("train").alias("split"))
    boxes = view(spark, sf_dir, "detections").where("cls > 8").select(F.col("filename").alias("id"))
    return D.image_statistics(boxes, images, "id")


@R.add("SELECT filename, l_partkey, l_linenumber, 500 - x1 AS left, 400 - y1 AS top, x2 - 500 AS right, y2 - 400 AS bottom FROM pixel_boxes".replace(" left,", ' "left",').replace(" right,", ' "right",'), ("pixel_boxes",))
def vd13_side_distances(spark, sf_dir):
    boxes = view(spark, sf_dir, "pixel_boxes")
    sides = D.side_distances(F.lit(500), F.lit(400), {c: F.col(c) for c in ("x1", "y1", "x2", "y2")})
    return boxes.select("filename", "l_partkey", "l_linenumber", *[c.alias(k) for k, c in sides.items()])


@R.add("SELECT filename, cls, count(*) AS n, round(sum(score), 6) AS score FROM detections WHERE cls < 3 GROUP BY ALL", ("detections",))
def snk03_per_file(spark, sf_dir):
    """One folder of JSON per class of file, read back."""
    path, rows = f"{_folder(spark)}/json", view(spark, sf_dir, "detections").where("cls < 3")
    found = rows.groupBy("filename", "cls").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))
    W_.write_per_file(found, path, "cls")
    return spark.read.schema("filename string, n long, score double, cls int").json(path)


# one file per row: Spark writes a folder for each part, whose name stands for the file's
@R.add("SELECT CAST(p_partkey AS VARCHAR) AS filename, k AS seq, CAST(k + p_size AS DOUBLE) AS x, CAST(k * 2 AS DOUBLE) AS y FROM part, (SELECT unnest(range(0, 3)) AS k) WHERE p_partkey % 50 = 0".replace("k AS seq", "CAST(k AS INTEGER) AS seq"))
def src09_contours(spark, sf_dir):
    """Contour files of eleven header lines and three points, each a file of its own."""
    path = f"{_folder(spark)}/contours"
    part = read(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    lines = [F.lit(f"head {i}") for i in range(11)] + [F.concat_ws(",", F.lit(k) + F.col("p_size"), F.lit(2 * k)) for k in range(3)]
    files = part.select("p_partkey", F.concat_ws("\n", *lines).alias("value")).repartition(max(-(-part.count() // 100), 1), "p_partkey")
    # a task writes about a hundred folders and moves them itself, instead of one task and then the driver all of them
    files.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("p_partkey").text(path)
    found = S.read_contours(spark, f"{path}/*")
    return found.select(F.regexp_extract(F.input_file_name(), "p_partkey=([0-9]+)", 1).alias("filename"), "seq", "x", "y")


@R.add("SELECT CAST(n_nationkey AS VARCHAR) AS folder, true AS valid FROM nation")
def src10_image_list(spark, sf_dir):
    """A folder of files, one per nation, listed with their validity by extension."""
    path = f"{_folder(spark)}/images"
    read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = S.list_images(spark, path, ("txt",))
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).alias("folder"), "valid").where("folder <> ''")


@R.add("SELECT component AS filename, CAST(CAST(component AS INTEGER) % 7 AS INTEGER) AS count, 1.5 + CAST(component AS INTEGER) AS x FROM measurements".replace("1.5", "CAST(1.5 AS DOUBLE)"), ("measurements",))
def src15_ground_truth(spark, sf_dir):
    """Ground truth of one landmark and split beside another's, picked by the file's name."""
    path, rows = f"{_folder(spark)}/truth", view(spark, sf_dir, "measurements").withColumn("n", F.col("component").cast("int"))
    table = rows.select(F.col("component").alias("filename"), (F.col("n") % 7).alias("count"), F.format_string("[[%.1f,2.0]]", F.col("n") + 1.5).alias("locations"))
    for name in ("tip__train__gt.csv", "tip__test__gt.csv"):
        table.write.option("header", True).csv(f"{path}/{name}")
    found = S.read_ground_truth(spark, f"{path}/*", "tip", "train", level=-2)
    return found.select("filename", "count", F.col("locations")[0][0].alias("x"))
