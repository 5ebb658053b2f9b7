"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.functions.naming import wished_taxa
from traitloom.operators import filters as X
from traitloom.operators import linkage as L

from ._register import Registry
from .naming_queries import _NAMED, _WISHES, wishes
from .views import LINE_ORDER, read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL
_ORDER = LINE_ORDER.split(", ")


@R.add(f", {_NAMED} SELECT id, identifier, family_name || '_' || genus_name || '_' || species_name AS fullname FROM multimedia JOIN named USING (id)", ("occurrence", "multimedia"))
def jn01_combined(spark, sf_dir):
    return L.combined(view(spark, sf_dir, "multimedia"), view(spark, sf_dir, "occurrence")).select("id", "identifier", "fullname")


@R.add("SELECT id, identifier FROM multimedia WHERE id IN (SELECT id FROM occurrence WHERE family = 'ASIA')", ("occurrence", "multimedia"))
def jn02_known_images(spark, sf_dir):
    asia = view(spark, sf_dir, "occurrence").where("family = 'ASIA'")
    return L.known_images(view(spark, sf_dir, "multimedia").select("id", "identifier"), asia)


@R.add("""SELECT 'occurrence' AS side, count(*) AS n FROM occurrence WHERE id IN (SELECT id FROM multimedia) UNION ALL
  SELECT 'multimedia', count(*) FROM multimedia WHERE id IN (SELECT id FROM occurrence)""", ("occurrence", "multimedia"))
def jn03_mutual(spark, sf_dir):
    one, two = L.mutual(view(spark, sf_dir, "occurrence"), view(spark, sf_dir, "multimedia"))
    count = lambda df, side: df.groupBy(F.lit(side).alias("side")).agg(F.count("*").alias("n"))
    return count(one, "occurrence").unionAll(count(two, "multimedia"))


@R.add("SELECT o.id, identifier FROM (SELECT id FROM occurrence WHERE month = 3) o JOIN multimedia m USING (id)", ("occurrence", "multimedia"))
def jn04_matched_by_id(spark, sf_dir):
    return view(spark, sf_dir, "occurrence").where("month = 3").select("id").join(view(spark, sf_dir, "multimedia").select("id", "identifier"), "id")


_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {LINE_ORDER}) AS rn FROM multimedia) WHERE rn = 1)"


@R.add(f"SELECT o.id, m.identifier, m.width FROM occurrence o LEFT JOIN {_FIRST} m USING (id)", ("occurrence", "multimedia"))
def jn05_first_record(spark, sf_dir):
    return L.first_match(view(spark, sf_dir, "occurrence").select("id"), view(spark, sf_dir, "multimedia"), "id", _ORDER).select("id", "identifier", "width")


@R.add(f"SELECT id, identifier FROM {_FIRST}", ("multimedia",))
def jn06_first_image(spark, sf_dir):
    return X.first_rows(view(spark, sf_dir, "multimedia"), ["id"], _ORDER).select("id", "identifier")


# Every image id; the SQL cuts each occurrence id at all its lengths, so that DuckDB need not compare all pairs.
@R.add("""SELECT i.id, o.id AS occurrence_id FROM (SELECT DISTINCT id FROM multimedia) i
  JOIN (SELECT id, unnest(range(1, length(id) + 1)) AS n FROM occurrence) o ON i.id = left(o.id, o.n)""", ("occurrence", "multimedia"))
def jn07_prefix_lookup(spark, sf_dir):
    return L.id_lookup(view(spark, sf_dir, "multimedia").select("id").distinct(), view(spark, sf_dir, "occurrence"), prefix=True)


@R.add(f"""WITH {_WISHES.format(nation="nation", region="region")}, c AS (SELECT family, taxon, unnest(string_split(taxon, ', ')) AS candidate FROM wishes),
  w AS (SELECT family, regexp_split_to_array(candidate, '[_ ]')[1] AS wish_genus, regexp_split_to_array(candidate, '[_ ]')[2] AS wish_species FROM c
        WHERE (NOT contains(taxon, ', ') OR length(candidate) > 5) AND len(regexp_split_to_array(candidate, '[_ ]')) = 2),
  o AS (SELECT r_name AS family, replace(n_name, '_', '') AS genus, replace(lower(r_name), ' ', '') AS species FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT family, wish_genus, wish_species, (SELECT count(*) FROM o WHERE o.family = w.family AND o.genus = w.wish_genus AND o.species = w.wish_species) AS n FROM w WHERE family IN (SELECT family FROM o)""")
def jn08_wish_counts(spark, sf_dir):
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    taxa = rows.select(F.col("r_name").alias("family"), F.replace("n_name", F.lit("_"), F.lit("")).alias("genus"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("")).alias("species"))
    return L.wish_counts(wished_taxa(wishes(spark, sf_dir)), taxa)


@R.add("SELECT m.component, m.class, m.area, round(l.apex_angle, 6) AS apex_angle FROM measurements m JOIN landmarks l USING (component)", ("measurements", "landmarks"))
def jn09_shapes_with_landmarks(spark, sf_dir):
    both = L.merged_with_suffixes(view(spark, sf_dir, "measurements"), view(spark, sf_dir, "landmarks"), "component", ("_shape", "_landmark"))
    return both.select("component", "class", "area", F.round("apex_angle", 6).alias("apex_angle"))


@R.add("""SELECT position, o_orderkey, c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders)
  FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer) USING (position)""")
def jn10_zipped(spark, sf_dir):
    return L.zipped(read(spark, sf_dir, "orders").select("o_orderkey"), read(spark, sf_dir, "customer").select("c_custkey"), ["o_orderkey"], ["c_custkey"])


@R.add(f"""SELECT d.filename, d.cls, r.conversion_mean, d.l_partkey FROM detections d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY confidence DESC NULLS LAST, {LINE_ORDER}) AS rn FROM ruler_records) WHERE rn = 1) r USING (filename)""", ("detections", "ruler_records"))
def jn11_with_ruler(spark, sf_dir):
    best = L.first_match(view(spark, sf_dir, "detections").select("filename", "cls", "l_partkey"), view(spark, sf_dir, "ruler_records").withColumnRenamed("l_partkey", "ruler_partkey"), "filename", [F.col("confidence").desc_nulls_last(), "l_orderkey", "l_linenumber", "ruler_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return best.select("filename", "cls", "conversion_mean", "l_partkey")


@R.add("SELECT d.filename, d.cls, d.w * i.width AS w_px, d.h * i.height AS h_px FROM detections d JOIN (SELECT id, max(width) AS width, max(height) AS height FROM multimedia GROUP BY id) i ON i.id = d.filename", ("detections", "multimedia"))
def jn12_with_dimensions(spark, sf_dir):
    sizes = view(spark, sf_dir, "multimedia").groupBy(F.col("id").alias("filename")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return view(spark, sf_dir, "detections").join(sizes, "filename").select("filename", "cls", (F.col("w") * F.col("width")).alias("w_px"), (F.col("h") * F.col("height")).alias("h_px"))


@R.add("SELECT id FROM occurrence WHERE id NOT IN (SELECT id FROM multimedia WHERE width > 1000)", ("occurrence", "multimedia"))
def jn13_unlabelled(spark, sf_dir):
    images = view(spark, sf_dir, "occurrence").select("id", F.concat("id", F.lit(".jpg")).alias("image"))
    labels = view(spark, sf_dir, "multimedia").where("width > 1000").select(F.concat("id", F.lit(".txt")).alias("label"))
    return L.unlabelled(images, labels, "image", "label").select("id")


_POINTS = """p AS (SELECT vec_id AS component, i - 1 AS seq, floor(1000 * CAST(embedding[2 * i - 1] AS DOUBLE)) AS x, floor(1000 * CAST(embedding[2 * i] AS DOUBLE)) AS y
  FROM (SELECT vec_id, embedding, unnest(range(1, 33)) AS i FROM embeddings))"""


def points(spark, sf_dir):
    """32 points per vector: component, seq, x, y."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("component"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).alias("x"), F.get("embedding", 2 * i + 1).alias("y")))).alias("seq", "p"))
    whole = lambda c: F.floor(1000 * F.col(c).cast("double")).cast("double")
    return vectors.select("component", F.col("seq").cast("long").alias("seq"), whole("p.x").alias("x"), whole("p.y").alias("y"))


@R.add(f"""WITH {_POINTS}, q AS (SELECT a.component, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b USING (component) WHERE a.seq < 16 AND b.seq >= 16)
  SELECT component, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d2, x1, y1, x2, y2) AS rn FROM q) WHERE rn = 1""")
def jn17_shortest_pair(spark, sf_dir):
    all_points = points(spark, sf_dir)
    return L.chosen_pair(all_points.where("seq < 16"), all_points.where("seq >= 16"), "component")


@R.add(f"""WITH {_POINTS}, q AS (SELECT a.component, abs(b.x - a.x + b.y - a.y) AS s, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b USING (component) WHERE a.seq < 16 AND b.seq >= 16)
  SELECT component, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY s DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) AS rn FROM q) WHERE rn = 1""")
def jn17_most_slanted_pair(spark, sf_dir):
    all_points = points(spark, sf_dir)
    return L.chosen_pair(all_points.where("seq < 16"), all_points.where("seq >= 16"), "component", mode="slanted")


@R.add(f"""WITH {_POINTS}, q AS (SELECT a.component, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b USING (component) WHERE a.seq < 16 AND b.seq >= 16)
  SELECT component, x1, y1, x2, y2, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS mid_x, CAST(trunc((y1 + y2) / 2) AS BIGINT) AS mid_y
  FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d2, x1, y1, x2, y2) AS rn FROM q) WHERE rn = 1""")
def jn18_closest_pair(spark, sf_dir):
    all_points = points(spark, sf_dir)
    return L.closest_pair(all_points.where("seq < 16"), all_points.where("seq >= 16"), "component")


# Units with the cm they hold and their system's divisor.
UNITS = [("cm", 1, 1.0), ("halfcm", 2, 1.0), ("4thcm", 4, 1.0), ("mm", 10, 1.0), ("halfmm", 20, 1.0), ("inch", 1, 2.54), ("halfinch", 2, 2.54), ("4th", 4, 2.54), ("8th", 8, 2.54), ("16th", 16, 2.54), ("32nd", 32, 2.54)]
UNITS_SQL = "u(unit, factor, divisor) AS (VALUES " + ", ".join(f"('{u}', {f}, CAST({d} AS DOUBLE))" for u, f, d in UNITS) + ")"


@R.add(f""", {UNITS_SQL}, s AS MATERIALIZED (SELECT ruler_id, strip, avg(x) AS mean FROM ticks GROUP BY ALL), r AS MATERIALIZED (SELECT ruler_id, strip, unit, mean * factor / divisor AS cm, floor(mean * factor / divisor / 5.005) AS bucket FROM s, u),
  near AS MATERIALIZED (SELECT ruler_id, strip, unit, cm, unnest([bucket - 1, bucket, bucket + 1]) AS bucket FROM r)
  SELECT a.ruler_id, a.strip AS strip_a, a.unit AS unit_a, round(a.cm, 6) AS cm_a, b.strip AS strip_b, b.unit AS unit_b, round(b.cm, 6) AS cm_b FROM r a JOIN near b USING (ruler_id, bucket)
  WHERE (a.strip < b.strip OR (a.strip = b.strip AND a.unit < b.unit)) AND abs(a.cm - b.cm) < 5""", ("ticks",))
def jn19_consistent_spacings(spark, sf_dir):
    units = spark.createDataFrame(UNITS, "unit string, factor int, divisor double")
    spacings = L.means_in_order(view(spark, sf_dir, "ticks"), ["ruler_id", "strip"], "x", ["event_id", "x"])
    return L.consistent_spacings(spacings, units).withColumns({c: F.round(c, 6) for c in ("cm_a", "cm_b")})


@R.add(f"""WITH {_POINTS}, q AS (SELECT a.component, a.seq, b.seq AS ref_seq, b.x AS bx, b.y AS byy, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM p a JOIN p b USING (component) WHERE a.seq < 16 AND b.seq >= 16)
  SELECT component, seq, ref_seq, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY component, seq ORDER BY d2, ref_seq) AS rn FROM q) WHERE rn = 1""")
def jn20_nearest_point(spark, sf_dir):
    all_points = points(spark, sf_dir)
    return L.nearest_point(all_points.where("seq < 16"), all_points.where("seq >= 16"), "component").withColumn("distance", F.round("distance", 6))


@R.add("SELECT filename, cls, score, NULL AS confidence FROM detections UNION ALL SELECT filename, NULL, NULL, confidence FROM ruler_records", ("detections", "ruler_records"))
def so01_stacked(spark, sf_dir):
    return L.stacked(view(spark, sf_dir, "detections").select("filename", "cls", "score"), view(spark, sf_dir, "ruler_records").select("filename", "confidence"))


@R.add("SELECT id FROM occurrence INTERSECT SELECT id FROM multimedia", ("occurrence", "multimedia"))
def so02_shared_ids(spark, sf_dir):
    return L.shared_values(view(spark, sf_dir, "occurrence"), view(spark, sf_dir, "multimedia"), "id")


@R.add("SELECT ruler_id, strip, n >= 4 OR sd < 10 AS in_either, n >= 4 AND sd < 10 AS in_both FROM (SELECT ruler_id, strip, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd FROM ticks GROUP BY ALL)", ("ticks",))
def so03_either_and_both(spark, sf_dir):
    strips = view(spark, sf_dir, "ticks").groupBy("ruler_id", "strip").agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    return L.either_and_both(strips, F.col("n") >= 4, F.col("sd") < 10).select("ruler_id", "strip", "in_either", "in_both")


@R.add("SELECT id FROM multimedia EXCEPT ALL SELECT id FROM occurrence", ("occurrence", "multimedia"))
def so04_difference(spark, sf_dir):
    return L.difference(view(spark, sf_dir, "multimedia").select("id"), view(spark, sf_dir, "occurrence").select("id"), all_rows=True)


@R.add("SELECT split_part(name, '__', 1) AS kind, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'tip__train__gt.csv' ELSE 'base__val__gt.csv' END AS name FROM lineitem) GROUP BY ALL")
def so05_class_from_file_name(spark, sf_dir):
    names = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 1, "tip__train__gt.csv").otherwise("base__val__gt.csv").alias("name"))
    return names.groupBy(F.get(F.split("name", "__"), F.lit(0)).alias("kind")).agg(F.count("*").alias("n"))


@R.add("""SELECT component, kind, value FROM (SELECT component, 'area' AS kind, area AS value FROM measurements UNION ALL SELECT component, 'perimeter', perimeter FROM measurements UNION ALL SELECT component, 'convex_hull', convex_hull FROM measurements) WHERE value IS NOT NULL""", ("measurements",))
def so06_melted(spark, sf_dir):
    return L.melted(view(spark, sf_dir, "measurements"), ["component"], ["area", "perimeter", "convex_hull"])
