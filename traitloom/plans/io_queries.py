"""Sources, sinks and streams over files that are written from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traitloom.operators.detections import PLANT_CLASSES
from traitloom.operators.lineage import shared_folder
from traitloom.sources import readers as S
from traitloom.sources import writers as K
from traitloom.streaming import downloads as T

from ._register import Registry
from .views import read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL


def _folder(spark):
    """A new folder that all executors reach; the file system removes it when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/io-{uuid.uuid4()}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


_OCCURRENCE = ("id", "family", "genus", "specificEpithet", "institutionCode")


@R.add("""SELECT id, family, genus, "specificEpithet", "institutionCode" FROM occurrence""", ("occurrence",))
def src01_delimited(spark, sf_dir):
    """Occurrences written with a separator that the folder's name does not tell, and read back."""
    path = f"{_folder(spark)}/occurrence.csv"
    view(spark, sf_dir, "occurrence").select(*_OCCURRENCE).write.option("header", True).option("sep", "|").csv(path)
    return S.read_delimited(spark, path)


@R.add("SELECT family AS archive, id FROM occurrence", ("occurrence",))
def src03_archives(spark, sf_dir):
    """An archive folder per family, each read by its own separator."""
    folder, rows = _folder(spark), view(spark, sf_dir, "occurrence")
    families = sorted(r["family"] for r in rows.select("family").distinct().collect())  # as many as there are regions
    for i, family in enumerate(families):
        mine = rows.where(F.col("family") == family).select("id", "genus")
        mine.write.option("header", True).option("sep", S.SEPARATORS[i % len(S.SEPARATORS)]).csv(f"{folder}/{family}")
    return S.read_archives(spark, f"{folder}/*/*.csv").select("archive", "id")


@R.add("SELECT id, genus, 'a' AS part FROM occurrence UNION ALL SELECT id, genus, 'b' FROM occurrence WHERE year > 1995", ("occurrence",))
def snk02_combined(spark, sf_dir):
    """Two appends to one combined table."""
    path, rows = f"{_folder(spark)}/combined", view(spark, sf_dir, "occurrence")
    K.write_combined(rows.select("id", "genus", F.lit("a").alias("part")), path)
    K.write_combined(rows.where("year > 1995").select("id", "genus", F.lit("b").alias("part")), path)
    return K.read_combined(spark, path)


@R.add("SELECT filename, l_linenumber, CAST(l_linenumber % 3 AS INTEGER) AS batch, confidence, NULL::DOUBLE AS predicted FROM ruler_records UNION ALL SELECT filename, l_linenumber, CAST(l_linenumber % 3 AS INTEGER), NULL, predicted FROM ruler_records", ("ruler_records",))
def snk04_merged_batches(spark, sf_dir):
    """Batches of two entity layouts, merged into one table."""
    folder = _folder(spark)
    rows = view(spark, sf_dir, "ruler_records").withColumn("batch", (F.col("l_linenumber") % 3).cast("int"))
    for name in ("confidence", "predicted"):
        K.write_batches(rows.select("filename", "l_linenumber", "batch", name), f"{folder}/{name}")
    return K.merge_batches(spark, [f"{folder}/confidence", f"{folder}/predicted"])


@R.add("SELECT id, genus, identifier FROM occurrence JOIN multimedia USING (id)", ("occurrence", "multimedia"))
def src02_paired_archive(spark, sf_dir):
    """Both tables of an archive, each with a separator of its own."""
    folder = _folder(spark)
    for name, columns, sep in (("occurrence", ("id", "genus"), "\t"), ("multimedia", ("id", "identifier"), ";")):
        view(spark, sf_dir, name).select(*columns).write.option("header", True).option("sep", sep).csv(f"{folder}/{name}.txt")
    occurrence, images = S.read_archive(spark, f"{folder}/occurrence.txt", f"{folder}/multimedia.txt")
    return occurrence.join(images, "id")


@R.add("SELECT identifier AS url, id || '_' || l_linenumber AS name FROM multimedia WHERE identifier IS NOT NULL", ("multimedia",))
def src04_url_table(spark, sf_dir):
    """A table whose columns of URLs and names the user names."""
    path = f"{_folder(spark)}/links.csv"
    rows = view(spark, sf_dir, "multimedia").where("identifier is not null")
    rows.select("width", F.col("identifier").alias("link"), F.concat_ws("_", "id", "l_linenumber").alias("label")).write.option("header", True).csv(path)
    return S.read_url_table(spark, path, "link", "label")


@R.add("SELECT filename, CAST(cls AS VARCHAR) AS cls, CAST(l_partkey AS VARCHAR) AS l_partkey FROM detections", ("detections",))
def src05_all_strings(spark, sf_dir):
    """Numbers come back as the texts that were written."""
    path = f"{_folder(spark)}/boxes.tsv"
    view(spark, sf_dir, "detections").select("filename", "cls", "l_partkey").write.option("header", True).option("sep", "\t").csv(path)
    return S.read_delimited(spark, path)


#: Order keys of one export file.
_EXPORTED = 10_000


def _exported(df, path):
    """One JSON document per file: rows have ``part`` and ``value``."""
    df.repartition("part").write.partitionBy("part").text(path)


@R.add("SELECT filename, 'class' || cls AS value, round(xc, 6) AS x, round(yc, 6) AS y FROM detections", ("detections",))
def src07_annotation_export(spark, sf_dir):
    """Boxes in the JSON form of a labelling platform, one array of sheets per file."""
    path, rows = f"{_folder(spark)}/exports", view(spark, sf_dir, "detections")
    thing = F.struct(F.concat(F.lit("class"), F.col("cls")).alias("value"), F.struct(F.round("xc", 6).alias("x"), F.round("yc", 6).alias("y")).alias("point"))
    sheets = rows.groupBy("filename", F.floor(F.col("l_orderkey") / _EXPORTED).alias("part")).agg(F.struct(F.collect_list(thing).alias("objects")).alias("Label"))
    sheet = F.struct(F.col("filename").alias("External ID"), F.lit(False).alias("Skipped"), "Label")
    _exported(sheets.groupBy("part").agg(F.to_json(F.collect_list(sheet)).alias("value")), path)
    return S.read_annotation_export(spark, path).select("filename", "value", "point.x", "point.y")


@R.add("SELECT filename AS file_name, cls AS category_id, CAST(l_partkey AS BIGINT) AS id, x1, y1 FROM pixel_boxes", ("pixel_boxes",))
def src08_coco(spark, sf_dir):
    """Label sets of images and annotations, read and joined."""
    path, rows = f"{_folder(spark)}/coco", view(spark, sf_dir, "pixel_boxes").withColumn("image_id", F.col("filename").cast("long"))
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox")
    annotation = F.struct(F.col("l_partkey").cast("long").alias("id"), "image_id", F.col("cls").alias("category_id"), F.lit(0).alias("iscrowd"), box)
    part = F.floor(F.col("image_id") / _EXPORTED).alias("part")
    images = F.collect_set(F.struct(F.col("image_id").alias("id"), F.col("filename").alias("file_name"))).alias("images")
    _exported(rows.groupBy(part).agg(F.to_json(F.struct(images, F.collect_list(annotation).alias("annotations"))).alias("value")), path)
    found, annotations = S.read_coco(spark, path)
    named = annotations.join(found.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return named.select("file_name", "category_id", "id", *[F.get("bbox", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("x1", "y1"))])


@R.add("SELECT id, genus FROM occurrence WHERE id IN (SELECT filename FROM detections WHERE cls = 3)", ("occurrence", "detections"))
def src11_project_rows(spark, sf_dir):
    """Look-up by name in a project's managed table."""
    project = f"p{uuid.uuid4().hex}"
    K.save_project({"images": view(spark, sf_dir, "occurrence").select("id", "genus")}, project, f"{_folder(spark)}/project")
    names = view(spark, sf_dir, "detections").where("cls = 3").select(F.col("filename").alias("id"))
    return K.project_rows(spark, project, "images", names, "id")


@R.add("SELECT 'colour' || c_custkey AS name, CAST(c_custkey % 256 AS INTEGER) AS r, CAST(c_nationkey AS INTEGER) AS g, 7 AS b, printf('%02x%02x07', c_custkey % 256, c_nationkey) AS hex FROM customer")
def src12_colour_profile(spark, sf_dir):
    """Colours whose hexadecimal form is missing in every second line."""
    path, rows = f"{_folder(spark)}/colours", read(spark, sf_dir, "customer")
    r, g = (F.col("c_custkey") % 256).cast("int"), F.col("c_nationkey").cast("int")
    given = F.when(F.col("c_custkey") % 2 == 0, F.format_string("%02X%02X07", r, g))
    rows.select(F.concat_ws(",", F.concat(F.lit("colour"), F.col("c_custkey")), r, g, F.lit(7), given)).write.text(path)
    return S.read_colour_profile(spark, path)


@R.add("SELECT 'fullname' AS kind, fullname AS name, count(*) AS n FROM download_log GROUP BY fullname UNION ALL SELECT 'host', host, count(*) FROM download_log GROUP BY host", ("download_log",))
def snk06_trackers(spark, sf_dir):
    path = f"{_folder(spark)}/trackers"
    K.trackers(view(spark, sf_dir, "download_log"), path)
    one = lambda kind: S.read_delimited(spark, f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.col("count").cast("long").alias("n"))
    return one("fullname").unionAll(one("host"))


@R.add("SELECT filename AS file_name, cls AS category_id, CAST(l_partkey AS BIGINT) AS id, 'leaf labels' AS description, CAST(11 AS INTEGER) AS categories FROM pixel_boxes", ("pixel_boxes",))
def snk07_coco_packets(spark, sf_dir):
    """Packets of all sheets, parsed again."""
    rows = view(spark, sf_dir, "pixel_boxes").withColumn("image_id", F.col("filename").cast("long"))
    images = rows.select(F.col("image_id").alias("id"), F.col("filename").alias("file_name"), F.lit(1000).alias("width"), F.lit(1000).alias("height")).distinct()
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("double").alias("area")
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox")
    packets = K.coco_packets(images, rows.select(F.col("l_partkey").cast("long").alias("id"), "image_id", F.col("cls").alias("category_id"), area, box), PLANT_CLASSES, "leaf labels")
    schema = "info struct<description:string>, categories array<struct<id:int,name:string>>, annotations array<struct<id:long,category_id:int>>"
    parsed = packets.select("file_name", F.from_json("packet", schema).alias("p"))
    found = parsed.select("file_name", F.col("p.info.description").alias("description"), F.size("p.categories").alias("categories"), F.explode("p.annotations").alias("a"))
    return found.select("file_name", "a.category_id", "a.id", "description", "categories")


def _log(spark, sf_dir):
    """The download log as files, read as a stream."""
    path = f"{_folder(spark)}/log"
    view(spark, sf_dir, "download_log").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange("ts", "id").write.parquet(path)
    return T.log_stream(spark, path)


def _totals(spark, stream):
    """The last state of an aggregated stream, each batch replacing the one before."""
    folder = _folder(spark)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _finished(spark, stream):
    """The rows that a stream appends until its source is used up."""
    folder = _folder(spark)
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@R.add("SELECT id, fullname FROM (SELECT *, row_number() OVER (PARTITION BY fullname ORDER BY ts, id) AS rn FROM download_log WHERE status = 'ok') WHERE rn <= 3", ("download_log",))
def st02_live_quota(spark, sf_dir):
    return _finished(spark, T.live_quota(_log(spark, sf_dir), 3)).select("id", "fullname")


@R.add("SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM download_log GROUP BY status", ("download_log",))
def st04_routed(spark, sf_dir):
    folder = _folder(spark)
    T.routed(_log(spark, sf_dir), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@R.add("SELECT DISTINCT id, host FROM download_log", ("download_log",))
def st05_deduplicated(spark, sf_dir):
    return _finished(spark, T.deduplicated(_log(spark, sf_dir))).select("id", "host")


@R.add("SELECT cls, round(xc, 6) AS xc, round(yc, 6) AS yc FROM detections", ("detections",))
def st01_label_ingest(spark, sf_dir):
    """Label lines as a stream of files."""
    path = f"{_folder(spark)}/labels"
    view(spark, sf_dir, "detections").select(F.concat_ws(" ", "cls", "xc", "yc", "w", "h", "score")).write.text(path)
    return _finished(spark, T.label_stream(spark, path)).select("cls", F.round("xc", 6).alias("xc"), F.round("yc", 6).alias("yc"))


@R.add("SELECT host, count(*) AS strikes, count(*) > 50 AS banned FROM download_log WHERE status <> 'ok' GROUP BY host", ("download_log",))
def st03_circuit_breaker(spark, sf_dir):
    return _totals(spark, T.circuit_breaker(_log(spark, sf_dir)))


@R.add(""", g AS (SELECT fullname, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM download_log), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY fullname ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM g),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY fullname ORDER BY t ROWS UNBOUNDED PRECEDING) AS nth FROM f)
  SELECT fullname, count(*) AS n, CAST(max(t) - min(t) AS BIGINT) AS micros FROM s GROUP BY fullname, nth""", ("download_log",))
def st06_sessions(spark, sf_dir):
    """Progress of each taxon's download sessions."""
    found = _totals(spark, T.sessions(_log(spark, sf_dir)))
    return found.select("fullname", "n", (F.unix_micros("last") - F.unix_micros("first")).alias("micros"))
