"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.functions import naming as N
from traitloom.operators import filters as X
from traitloom.operators import linkage as L

from ._register import Registry
from .views import view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL

_HERB = """CASE WHEN "institutionID" = 'UBC Herbarium' THEN 'UBC' WHEN "institutionID" = 'Naturalis Biodiversity Center' THEN 'L'
  WHEN "institutionID" = 'Forest Herbarium Ibadan (FHI)' THEN 'FHI' WHEN contains("occurrenceID", 'id.luomus.fi') THEN 'FinBIF'
  ELSE coalesce(CASE WHEN length("institutionCode") <= 8 THEN "institutionCode" END, CASE WHEN length("institutionID") <= 8 THEN "institutionID" END,
       CASE WHEN length(publisher) <= 8 THEN publisher END, CASE WHEN length("occurrenceID") <= 8 THEN "occurrenceID" END, replace(publisher, ' ', '-')) END"""
_CLEAN = "regexp_replace({0}, '[^a-zA-Z0-9_-]', '', 'g')"
_NAMED = f"""named AS (SELECT *, {_CLEAN.format(_HERB)} AS herb, {_CLEAN.format("split_part(family, ' ', 1)")} AS family_name, {_CLEAN.format("split_part(genus, ' ', 1)")} AS genus_name,
  coalesce({_CLEAN.format('''split_part("specificEpithet", ' ', 1)''')}, '') AS species_name FROM occurrence)"""


@R.add("SELECT id, family, genus FROM occurrence", ("occurrence",))
def prj01_resolve_id(spark, sf_dir):
    return N.resolve_id(view(spark, sf_dir, "occurrence").withColumnRenamed("id", "coreid")).select("id", "family", "genus")


@R.add(f"SELECT id, {_HERB} AS herb FROM occurrence", ("occurrence",))
def prj02_herbarium_code(spark, sf_dir):
    occurrence = view(spark, sf_dir, "occurrence")
    return occurrence.select("id", N.herbarium_code(occurrence.columns).alias("herb"))


@R.add(f"""SELECT id, {_CLEAN.format('"institutionID"')} AS cleaned, split_part("specificEpithet", ' ', 1) AS first FROM occurrence""", ("occurrence",))
def prj03_clean_names(spark, sf_dir):
    return view(spark, sf_dir, "occurrence").select("id", N.legal(F.col("institutionID")).alias("cleaned"), N.first_word(F.col("specificEpithet")).alias("first"))


@R.add(f""", {_NAMED} SELECT id, herb, family_name, genus_name, species_name, family_name || '_' || genus_name || '_' || species_name AS fullname,
  herb || '_' || id || '_' || family_name || '_' || genus_name || '_' || species_name AS filename_image,
  herb || '_' || id || '_' || family_name || '_' || genus_name || '_' || species_name || '.jpg' AS filename_image_jpg FROM named""", ("occurrence",))
def prj04_specimen_names(spark, sf_dir):
    names = N.specimen_names(view(spark, sf_dir, "occurrence"))
    return names.select("id", "herb", "family_name", "genus_name", "species_name", "fullname", "filename_image", "filename_image_jpg")


@R.add("""SELECT id, family || '_' || genus || '_' || coalesce("specificEpithet", '') AS taxon FROM occurrence""", ("occurrence",))
def prj05_taxon_key(spark, sf_dir):
    return view(spark, sf_dir, "occurrence").select("id", N.taxon_key().alias("taxon"))


@R.add("SELECT id AS id_images, identifier AS url FROM multimedia", ("multimedia",))
def prj06_rename(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").select("id", "identifier").withColumnsRenamed({"id": "id_images", "identifier": "url"})


@R.add(f""", {_NAMED}, f AS (SELECT id AS row_id, herb || '_' || id || '_' || family_name || '_' || genus_name || '_' || species_name AS name FROM named)
  SELECT row_id, split_part(name, '_', 1) AS herb, split_part(name, '_', 2) AS id, split_part(name, '_', 3) AS family, split_part(name, '_', 4) AS genus, split_part(name, '_', 5) AS species,
  split_part(name, '_', 3) || '_' || split_part(name, '_', 4) || '_' || split_part(name, '_', 5) AS fullname, split_part(name, '_', 3) || '_' || split_part(name, '_', 4) AS class FROM f""", ("occurrence",))
def prj07_name_parts(spark, sf_dir):
    names = N.specimen_names(view(spark, sf_dir, "occurrence"))
    return names.select(F.col("id").alias("row_id"), *[c.alias(k) for k, c in N.name_parts(F.col("filename_image")).items()])


# every third name looks like a cleaned and numbered one from the start
@R.add(r"""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(p_brand, '[^a-zA-Z0-9_-]', '-', 'g') || '_' || CAST(p_partkey % 40 AS VARCHAR) ELSE p_brand END AS name FROM part),
  c AS (SELECT p_partkey, name, regexp_replace(name, '[^a-zA-Z0-9_-]', '-', 'g') AS v FROM f),
  t AS (SELECT p_partkey, v, row_number() OVER (PARTITION BY v ORDER BY v <> name, p_partkey) - 1 AS r FROM c),
  taken AS (SELECT regexp_extract(v, '^(.*)_([1-9][0-9]*)$', 1) AS v, CAST(regexp_extract(v, '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT) AS number FROM (SELECT DISTINCT v FROM c) WHERE regexp_matches(v, '^(.*)_([1-9][0-9]*)$')),
  gap AS (SELECT v, number - row_number() OVER (PARTITION BY v ORDER BY number) + 1 AS g FROM taken)
  SELECT p_partkey, CASE WHEN r = 0 THEN v ELSE v || '_' || CAST(r + (SELECT count(*) FROM gap WHERE gap.v = t.v AND g <= r) AS VARCHAR) END AS valid_name FROM t""")
def prj08_unique_file_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    natural = F.concat(F.regexp_replace("p_brand", "[^a-zA-Z0-9_-]", "-"), F.lit("_"), (F.col("p_partkey") % 40).cast("string"))
    files = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, natural).otherwise(F.col("p_brand")).alias("name"))
    return L.unique_file_names(files, "name", ["p_partkey"]).select("p_partkey", "valid_name")


@R.add("SELECT component, image_height * image_width / 1e6 AS mp, round(image_height * image_width / 1e6, 1) AS mp_rounded FROM conversion_training", ("conversion_training",))
def prj09_megapixels(spark, sf_dir):
    h, w = F.col("image_height"), F.col("image_width")
    return view(spark, sf_dir, "conversion_training").select("component", N.megapixels(h, w).alias("mp"), N.megapixels(h, w, 1).alias("mp_rounded"))


@R.add("""SELECT id, width, height, CASE WHEN height > width THEN CAST(round_even(5000 / (height / CAST(width AS DOUBLE)), 0) AS INTEGER) ELSE 5000 END AS new_width,
  CASE WHEN height > width THEN 5000 ELSE CAST(round_even(5000 / (width / CAST(height AS DOUBLE)), 0) AS INTEGER) END AS new_height FROM multimedia""", ("multimedia",))
def prj10_resized(spark, sf_dir):
    w, h = N.resized(F.col("width"), F.col("height"))
    return view(spark, sf_dir, "multimedia").select("id", "width", "height", w.alias("new_width"), h.alias("new_height"))


@R.add("SELECT page_id, CASE WHEN url IS NOT NULL THEN coalesce(CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[3] END, 'invalid_url') END AS host FROM pages")
def prj11_url_host(spark, sf_dir):
    return view(spark, sf_dir, "url_pages").select("page_id", N.url_host(F.col("url")).alias("host"))


@R.add("""SELECT filename, name, split_part(name, '__', 1) AS file, split_part(name, '__', 2) AS code, x1, y1, x2, y2 FROM (
  SELECT filename, filename || '__L__' || abs(x1) || '-' || abs(y1) || '-' || abs(x2) || '-' || abs(y2) AS name,
  CAST(abs(x1) AS INTEGER) AS x1, CAST(abs(y1) AS INTEGER) AS y1, CAST(abs(x2) AS INTEGER) AS x2, CAST(abs(y2) AS INTEGER) AS y2 FROM pixel_boxes)""", ("pixel_boxes",))
def prj12_component_names(spark, sf_dir):
    boxes = view(spark, sf_dir, "pixel_boxes")
    named = boxes.select("filename", N.component_name(F.col("filename"), F.lit("L"), [F.abs(c).cast("string") for c in ("x1", "y1", "x2", "y2")]).alias("name"))
    return named.select("filename", "name", *[c.alias(k) for k, c in N.component_parts(F.col("name")).items()])


@R.add("""SELECT p_partkey, colour, CAST('0x' || substr(colour, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(colour, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(colour, 6, 2) AS INTEGER) AS b
  FROM (SELECT p_partkey, '#' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS colour FROM part)""")
def prj14_hex_colour(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6)).alias("colour"))
    return part.select("*", *[c.alias(k) for k, c in N.hex_colour(F.col("colour")).items()])


@R.add("SELECT id, greatest(height, width) AS height, least(height, width) AS width, height < width AS rotated FROM multimedia", ("multimedia",))
def prj15_upright(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").select("id", *[c.alias(k) for k, c in N.upright(F.col("height"), F.col("width")).items()])


_WISHES = """wishes AS (SELECT r_name AS family, replace(n_name, '_', '') || ' ' || replace(lower(r_name), ' ', '') || CASE WHEN n_nationkey % 2 = 0 THEN ', ' || replace(n_name, '_', '') || '_alba' ELSE '' END AS taxon
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)"""


def wishes(spark, sf_dir):
    sql = _WISHES.format(nation=f"parquet.`{sf_dir}/nation.parquet`", region=f"parquet.`{sf_dir}/region.parquet`")
    return spark.sql(f"WITH {sql} SELECT * FROM wishes")


@R.add(f"""WITH {_WISHES.format(nation="nation", region="region")}, c AS (SELECT family, taxon, unnest(string_split(taxon, ', ')) AS candidate FROM wishes)
  SELECT family, split_part(candidate, ' ', 1) AS a, candidate, regexp_split_to_array(candidate, '[_ ]')[1] AS wish_genus, regexp_split_to_array(candidate, '[_ ]')[2] AS wish_species
  FROM c WHERE (NOT contains(taxon, ', ') OR length(candidate) > 5) AND len(regexp_split_to_array(candidate, '[_ ]')) = 2""")
def prj16_wished_taxa(spark, sf_dir):
    return N.wished_taxa(wishes(spark, sf_dir)).select("family", F.get(F.split("candidate", " "), F.lit(0)).alias("a"), "candidate", "wish_genus", "wish_species")


@R.add("SELECT id, strftime(make_date(2000, CAST(month AS INTEGER), 1), '%B') AS month_name, CAST(month AS INTEGER) AS month FROM occurrence", ("occurrence",))
def prj17_month_lookup(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in N.MONTHS])
    named = view(spark, sf_dir, "occurrence").select("id", F.get(names, F.col("month") - 1).alias("month_name"))
    return named.withColumn("month", N.month_number(F.col("month_name")))


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def prj18_from_json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.add("SELECT filename, coalesce(confidence, 0) AS confidence, CASE WHEN conversion_mean > 0 THEN round(ln(conversion_mean), 9) END AS log_conversion, l_linenumber FROM ruler_records", ("ruler_records",))
def prj19_impute_and_log(spark, sf_dir):
    rows = view(spark, sf_dir, "ruler_records").na.fill(0.0, subset=["confidence"])
    return rows.select("filename", "confidence", F.round(N.positive_log(F.col("conversion_mean")), 9).alias("log_conversion"), "l_linenumber")


@R.add("SELECT id, identifier FROM multimedia WHERE NOT coalesce(regexp_matches(identifier, 'host7\\.|host13\\.'), false)", ("multimedia",))
def flt01_banned_hosts(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").where(X.not_banned(F.col("identifier"), [r"host7\.", r"host13\."])).select("id", "identifier")


@R.add("""SELECT id, CASE WHEN round(height * width / 1e6, 1) < 1.0 THEN 'too_small' WHEN round(height * width / 1e6, 1) <= 4.0 THEN 'keep' ELSE 'resize' END AS verdict FROM multimedia""", ("multimedia",))
def flt02_resolution(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").select("id", X.resolution(F.col("height"), F.col("width"), 1.0, 4.0).alias("verdict"))


@R.add("SELECT id, year, month, family FROM occurrence WHERE year >= 1994 AND year <= 1996 AND month = 3 AND family = 'ASIA'", ("occurrence",))
def flt03_download_predicate(spark, sf_dir):
    return X.download_predicate(view(spark, sf_dir, "occurrence"), 1994, 1996, month=3, family="ASIA", genus=None).select("id", "year", "month", "family")


@R.add("SELECT id, genus FROM occurrence WHERE genus IN (SELECT genus FROM occurrence GROUP BY genus HAVING count(*) >= 590)", ("occurrence",))
def flt04_frequent_classes(spark, sf_dir):
    return X.frequent(view(spark, sf_dir, "occurrence").select("id", "genus"), "genus", 590)


@R.add("SELECT filename, cls, score FROM detections WHERE cls = 3 AND score >= 0.5", ("detections",))
def flt05_class_and_score(spark, sf_dir):
    return X.by_class_and_score(view(spark, sf_dir, "detections"), 3, 0.5).select("filename", "cls", "score")


@R.add("SELECT filename, cls FROM detections WHERE cls IN (0, 1, 8)", ("detections",))
def flt06_include_list(spark, sf_dir):
    return view(spark, sf_dir, "detections").where(X.included(F.col("cls").cast("string"), ["0", "1", "8"])).select("filename", "cls")


@R.add("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P') AND o_orderkey % 3 > 0")
def flt07_reviewed(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderkey", (F.col("o_orderstatus") == "P").alias("skipped"), (F.col("o_orderkey") % 3).alias("reviews"))
    return X.reviewed(rows, only_reviewed=True).select("o_orderkey")


@R.add("""SELECT filename, kind, n FROM (SELECT filename, CASE cls WHEN 0 THEN 'tip' WHEN 1 THEN 'base' WHEN 2 THEN 'width' WHEN 3 THEN 'angle' ELSE 'trace' END AS kind, count(*) AS n FROM detections GROUP BY ALL)
  WHERE n = CASE kind WHEN 'tip' THEN 1 WHEN 'base' THEN 1 WHEN 'width' THEN 2 WHEN 'angle' THEN 3 ELSE n END""", ("detections",))
def flt08_expected_counts(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("cls") == i, k) for i, k in enumerate(("tip", "base", "width", "angle"))], F.lit("trace"))
    counts = view(spark, sf_dir, "detections").groupBy("filename", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.where(X.expected_count(F.col("kind"), F.col("n")))


@R.add("SELECT filename, cls, l_linenumber FROM (SELECT *, max(CASE WHEN cls IN (0, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY filename) AS has FROM detections) WHERE NOT (cls = 8 AND has = 1)", ("detections",))
def flt09_overridden_boxes(spark, sf_dir):
    return X.without_overridden(view(spark, sf_dir, "detections").select("filename", "cls", "l_linenumber"))


@R.add("SELECT filename, CASE WHEN bool_or(cls = 2) THEN 'compound' ELSE 'simple' END AS route FROM detections GROUP BY filename", ("detections",))
def flt10_routes(spark, sf_dir):
    return X.routed(view(spark, sf_dir, "detections"))


@R.add("SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'leaf_whole' WHEN 1 THEN 'leaflet_part' ELSE 'simple_leaf' END AS name FROM part) WHERE list_contains(string_split(name, '_'), 'leaf')")
def flt11_leaf_annotations(spark, sf_dir):
    kinds = F.array(F.lit("leaf_whole"), F.lit("leaflet_part"), F.lit("simple_leaf"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 3).cast("int")).alias("name"))
    return part.where(X.leaf_annotation(F.col("name")))


@R.add("SELECT id, identifier FROM multimedia WHERE identifier IS NOT NULL AND NOT contains(identifier, 'manifest')", ("multimedia",))
def flt12_fetchable_urls(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").where(X.fetchable(F.col("identifier"))).select("id", "identifier")


@R.add("SELECT id, identifier FROM multimedia WHERE lower(regexp_extract(identifier, '\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'jp2')", ("multimedia",))
def flt13_image_extensions(spark, sf_dir):
    return view(spark, sf_dir, "multimedia").where(X.valid_image(F.col("identifier"))).select("id", "identifier")


@R.add("SELECT filename, confidence, conversion_mean FROM ruler_records WHERE confidence IS NOT NULL AND conversion_mean IS NOT NULL", ("ruler_records",))
def flt14_complete_cases(spark, sf_dir):
    return X.complete_cases(view(spark, sf_dir, "ruler_records").select("filename", "confidence", "conversion_mean"), ["confidence", "conversion_mean"])
