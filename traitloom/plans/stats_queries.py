"""Aggregations, ruler statistics, samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators import detections as D
from traitloom.operators import rulers as U
from traitloom.operators import sampling as S
from traitloom.operators import stats as T

from ._register import Registry
from .linkage_queries import UNITS_SQL
from .views import LINE_ORDER, read, view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL
_ORDER = LINE_ORDER.split(", ")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@R.add("SELECT family, genus, count(*) AS n FROM occurrence GROUP BY ALL", ("occurrence",))
def ag02_counts(spark, sf_dir):
    return T.counts(view(spark, sf_dir, "occurrence"), "family", "genus")


@R.add("SELECT genus, count(*) AS n, count(*) = 600 AS is_full FROM occurrence GROUP BY genus", ("occurrence",))
def ag03_quota_audit(spark, sf_dir):
    return T.quota_audit(view(spark, sf_dir, "occurrence"), "genus", 600)


@R.add("""SELECT class, round(avg(area), 6) AS mean_1, round(avg(perimeter), 6) AS mean_2, round(stddev_samp(area), 6) AS sd_1, round(stddev_samp(perimeter), 6) AS sd_2,
  round(2 * stddev_samp(area), 6) AS axis_1, round(2 * stddev_samp(perimeter), 6) AS axis_2, round((stddev_samp(area) + stddev_samp(perimeter)) / 2, 6) AS radius FROM measurements GROUP BY class""", ("measurements",))
def ag04_spread(spark, sf_dir):
    return _rounded(T.spread(view(spark, sf_dir, "measurements"), "class", "area", "perimeter"), "mean_1", "mean_2", "sd_1", "sd_2", "axis_1", "axis_2", "radius")


@R.add("SELECT class, quantile_cont(area, 0.5) AS median_area, quantile_cont(perimeter, 0.5) AS median_perimeter FROM measurements GROUP BY class", ("measurements",))
def ag05_medians(spark, sf_dir):
    return T.medians(view(spark, sf_dir, "measurements"), "class", ["area", "perimeter"])


@R.add(""", g AS (SELECT class, count(*) AS n, sum(area) AS s, sum(area * area) AS q FROM measurements GROUP BY class), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
  SELECT round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM t""", ("measurements",))
def ag06_anova(spark, sf_dir):
    return _rounded(T.anova(view(spark, sf_dir, "measurements"), "class", "area"), "f", digits=4)


@R.add(f"SELECT filename, confidence, conversion_mean FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY confidence DESC NULLS LAST, {LINE_ORDER}) AS rn FROM ruler_records) WHERE rn = 1", ("ruler_records",))
def ag07_best_ruler(spark, sf_dir):
    return U.best_ruler(view(spark, sf_dir, "ruler_records"), "filename", _ORDER).select("filename", "confidence", "conversion_mean")


@R.add(f"""SELECT filename, round(coalesce(avg(CASE WHEN conversion_mean > 0 THEN conversion_mean END), max_by(predicted, rn) FILTER (predicted > 0), 0), 2) AS factor
  FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY {LINE_ORDER}) AS rn FROM ruler_records) GROUP BY filename""", ("ruler_records",))
def ag08_conversion_factor(spark, sf_dir):
    return U.conversion_factor(view(spark, sf_dir, "ruler_records"), "filename", _ORDER)


@R.add("""SELECT filename, greatest(min(x1) - 10, 0) AS x1, greatest(min(y1) - 10, 0) AS y1, least(max(x2) + 10, 1000) AS x2, least(max(y2) + 10, 1000) AS y2
  FROM pixel_boxes WHERE cls IN (0, 1, 2, 8) GROUP BY filename""", ("pixel_boxes",))
def ag09_crop_box(spark, sf_dir):
    return D.crop_box(view(spark, sf_dir, "pixel_boxes"), "filename", (0, 1, 2, 8), 10, 1000, 1000)


_STRIPS = "s AS (SELECT ruler_id, strip, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd FROM ticks GROUP BY ALL)"


def _strip_sd(spark, sf_dir):
    return view(spark, sf_dir, "ticks").groupBy("ruler_id", "strip").agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))


@R.add(f", {_STRIPS} SELECT ruler_id, round(sqrt(sum((n - 1) * sd * sd) / greatest(CAST(sum(n) - 2 AS DOUBLE), 1e-10)), 6) AS pooled_sd FROM s WHERE n > 2 GROUP BY ruler_id", ("ticks",))
def ag10_pooled_sd(spark, sf_dir):
    return _rounded(U.pooled_sd(_strip_sd(spark, sf_dir).where("n > 2"), ["ruler_id"]), "pooled_sd")


@R.add(f", {_STRIPS} SELECT ruler_id, round(sqrt(sum((n - 1) * sd * sd) / greatest(CAST(sum(n) - count(*) AS DOUBLE), 1e-10)), 6) AS pooled_sd FROM s WHERE n > 2 GROUP BY ruler_id", ("ticks",))
def ag10_pooled_sd_labels(spark, sf_dir):
    return _rounded(U.pooled_sd(_strip_sd(spark, sf_dir).where("n > 2"), ["ruler_id"], minus=None), "pooled_sd")


@R.add("SELECT ruler_id, round(CASE WHEN count(*) > 1 THEN stddev_samp(x) / avg(x) * 100 ELSE 0 END, 6) AS rsd FROM ticks WHERE x > 1 GROUP BY ruler_id", ("ticks",))
def ag11_relative_sd(spark, sf_dir):
    return _rounded(U.relative_sd(view(spark, sf_dir, "ticks").where("x > 1"), ["ruler_id"], "x"), "rsd")


@R.add("SELECT event_id, round(abs(x - avg(x) OVER (PARTITION BY ruler_id)) / avg(x) OVER (PARTITION BY ruler_id) * 100, 4) AS percent_error FROM ticks WHERE x > 1", ("ticks",))
def ag11_percent_errors(spark, sf_dir):
    return _rounded(U.percent_errors(view(spark, sf_dir, "ticks").where("x > 1"), ["ruler_id"], "x").select("event_id", "percent_error"), "percent_error", digits=4)


_GAPS = """g AS (SELECT *, least(x - lag(x) OVER w, lead(x) OVER w - x) AS gap FROM ticks WINDOW w AS (PARTITION BY ruler_id ORDER BY x)), gaps AS (SELECT * FROM g WHERE gap > 2)"""


@R.add(f", {_GAPS} SELECT ruler_id, strip, event_id, round(gap, 6) AS gap FROM gaps", ("ticks",))
def wn12_nearest_gaps(spark, sf_dir):
    return _rounded(U.nearest_gaps(view(spark, sf_dir, "ticks"), ["ruler_id"]).select("ruler_id", "strip", "event_id", "gap"), "gap")


@R.add(f", {_GAPS} SELECT ruler_id, round(exp(avg(ln(gap))), 6) AS spacing, count(*) AS n FROM gaps GROUP BY ruler_id", ("ticks",))
def ag13_geometric_spacing(spark, sf_dir):
    return _rounded(U.geometric_spacing(U.nearest_gaps(view(spark, sf_dir, "ticks"), ["ruler_id"]), ["ruler_id"]), "spacing")


@R.add("""SELECT event_id FROM (SELECT t.*, lo, hi FROM ticks t JOIN (SELECT ruler_id, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM ticks GROUP BY ruler_id) USING (ruler_id))
  WHERE x > lo - (hi - lo) AND x < hi + (hi - lo)""", ("ticks",))
def ag14_trimmed(spark, sf_dir):
    return U.trimmed(view(spark, sf_dir, "ticks"), ["ruler_id"], "x").select("event_id")


@R.add("""SELECT event_id FROM (SELECT t.*, lo, hi FROM ticks t JOIN (SELECT ruler_id, quantile_cont(x, 0.3) AS lo, quantile_cont(x, 0.95) AS hi FROM ticks GROUP BY ruler_id) USING (ruler_id))
  WHERE x > lo - (hi - lo) AND x < hi + (hi - lo)""", ("ticks",))
def ag14_trimmed_high(spark, sf_dir):
    return U.trimmed(view(spark, sf_dir, "ticks"), ["ruler_id"], "x", 0.3, 0.95).select("event_id")


@R.add("""SELECT event_id FROM ticks JOIN (SELECT ruler_id, exp(avg(ln(x))) + 0.5 * coalesce(stddev_samp(x), 0) AS top FROM ticks WHERE x > 0 GROUP BY ruler_id) USING (ruler_id) WHERE x > 0 AND x <= top""", ("ticks",))
def ag14_below_geometric(spark, sf_dir):
    return U.below_geometric(view(spark, sf_dir, "ticks").where("x > 0"), ["ruler_id"], "x").select("event_id")


_SUMMARY = f"{_GAPS}, y AS (SELECT ruler_id, strip, count(*) AS n, avg(gap) AS mean, coalesce(stddev_samp(gap), 0) AS sd, exp(avg(ln(gap))) AS gmean, coalesce(stddev_samp(gap), 0) / avg(gap) AS nsd FROM gaps GROUP BY ALL)"


@R.add(f", {_SUMMARY} SELECT ruler_id, strip, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(gmean, 6) AS gmean, round(nsd, 6) AS nsd FROM y", ("ticks",))
def ag15_strip_summary(spark, sf_dir):
    return _rounded(U.strip_summary(U.nearest_gaps(view(spark, sf_dir, "ticks"), ["ruler_id"])), "mean", "sd", "gmean", "nsd")


@R.add(f", {_SUMMARY} SELECT ruler_id, min(nsd) AS m, min_by(strip, nsd) AS strip, round(min(nsd), 6) AS nsd FROM y WHERE n >= 3 GROUP BY ruler_id".replace(" min(nsd) AS m,", ""), ("ticks",))
def ag15_best_strip(spark, sf_dir):
    return _rounded(U.best_strip(U.strip_summary(U.nearest_gaps(view(spark, sf_dir, "ticks"), ["ruler_id"]))), "nsd")


def _sub_spacing(step, name):
    return f"""{name} AS (SELECT ruler_id, strip, exp(avg(ln(gap))) AS {name} FROM (SELECT *, least(x - lag(x) OVER w, lead(x) OVER w - x) AS gap FROM turn WHERE t % {step} = 0
      WINDOW w AS (PARTITION BY ruler_id, strip ORDER BY x)) WHERE gap > 0 GROUP BY ALL)"""


@R.add(f""", turn AS (SELECT *, row_number() OVER (PARTITION BY ruler_id, strip ORDER BY x, event_id) AS t FROM ticks), {_sub_spacing(1, 'base')}, {_sub_spacing(2, 'second')}, {_sub_spacing(3, 'third')}
  SELECT ruler_id, strip, round(base, 6) AS base, round(second, 6) AS second, round(third, 6) AS third, second BETWEEN base AND base * 3 AND third BETWEEN base * 2 AND base * 4 AS is_regular
  FROM base JOIN second USING (ruler_id, strip) JOIN third USING (ruler_id, strip)""", ("ticks",))
def ag16_regularity(spark, sf_dir):
    return _rounded(U.regular(view(spark, sf_dir, "ticks")), "base", "second", "third")


@R.add(f""", {UNITS_SQL}, s AS (SELECT ruler_id, strip, avg(x) AS spacing FROM ticks GROUP BY ALL), p AS (SELECT ruler_id, avg(x) * 4 AS predicted FROM ticks GROUP BY ruler_id),
  r AS (SELECT ruler_id, strip, unit, spacing * factor / divisor AS cm, predicted FROM s JOIN p USING (ruler_id), u), near AS (SELECT * FROM r WHERE abs(cm - predicted) <= 0.1 * predicted),
  q AS (SELECT ruler_id, quantile_cont(cm, 0.25) AS lo, quantile_cont(cm, 0.75) AS hi FROM near GROUP BY ruler_id)
  SELECT ruler_id, round(avg(cm), 6) AS cm, count(*) AS n, count(DISTINCT unit) AS n_units FROM near JOIN q USING (ruler_id) WHERE cm > lo - (hi - lo) AND cm < hi + (hi - lo) GROUP BY ruler_id""", ("ticks",))
def ag18_consensus(spark, sf_dir):
    ticks = view(spark, sf_dir, "ticks")
    spacings = ticks.groupBy("ruler_id", "strip").agg(F.avg("x").alias("spacing")).join(ticks.groupBy("ruler_id").agg((F.avg("x") * 4).alias("predicted")), "ruler_id")
    return _rounded(U.consensus(spacings, U.units_table(spark), "predicted"), "cm")


@R.add("SELECT host, count(*) AS strikes, count(*) > 50 AS banned FROM download_log WHERE status <> 'ok' GROUP BY host", ("download_log",))
def ag19_strikes(spark, sf_dir):
    return T.strikes(view(spark, sf_dir, "download_log"))


@R.add("SELECT fullname, count(*) AS tried, count(*) FILTER (status = 'ok') AS done FROM download_log GROUP BY fullname", ("download_log",))
def ag20_download_totals(spark, sf_dir):
    return T.download_totals(view(spark, sf_dir, "download_log"))


@R.add("SELECT fullname, status, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM download_log GROUP BY ALL", ("download_log",))
def ag29_stage_times(spark, sf_dir):
    return _rounded(T.stage_times(view(spark, sf_dir, "download_log"), ["fullname", "status"]), "seconds", digits=3)


_PICK = "md5({k} || ':2023'), {k}"


@R.add(f"SELECT id, genus FROM (SELECT *, row_number() OVER (PARTITION BY family, genus ORDER BY {_PICK.format(k='id')}) AS rn FROM occurrence) WHERE rn <= 10", ("occurrence",))
def wn01_per_group(spark, sf_dir):
    return S.per_group(view(spark, sf_dir, "occurrence"), ["family", "genus"], 10).select("id", "genus")


@R.add(f"""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY family || '_' || genus || '_' || coalesce("specificEpithet", '') ORDER BY {_PICK.format(k='id')}) AS rn FROM occurrence) WHERE rn <= 10""", ("occurrence",))
def wn02_cap_per_taxon(spark, sf_dir):
    from traitloom.functions.naming import taxon_key

    return S.per_group(view(spark, sf_dir, "occurrence").withColumn("taxon", taxon_key()), ["taxon"], 10).select("id")


@R.add(f""", o AS (SELECT *, family || '_' || genus || '_' || coalesce("specificEpithet", '') AS species FROM occurrence),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY {_PICK.format(k='id')}) AS r1 FROM o) WHERE r1 <= 4),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY {_PICK.format(k='id')}) AS r2 FROM a) WHERE r2 <= 15),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_PICK.format(k='id')}) AS r3 FROM b) WHERE r3 <= 50)
  SELECT id, family, genus FROM c ORDER BY {_PICK.format(k='id')} LIMIT 200""", ("occurrence",))
def wn03_quotas(spark, sf_dir):
    from traitloom.functions.naming import taxon_key

    occurrence = view(spark, sf_dir, "occurrence").withColumn("species", taxon_key())
    return S.quotas(occurrence, {"species": 4, "genus": 15, "family": 50}, 200).select("id", "family", "genus")


@R.add(f"SELECT id, identifier FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY {LINE_ORDER}) AS rn FROM multimedia) WHERE n = 1 OR (n = 3 AND rn = 2)", ("multimedia",))
def wn04_one_or_middle(spark, sf_dir):
    return S.one_or_middle_of_three(view(spark, sf_dir, "multimedia"), "id", _ORDER).select("id", "identifier")


@R.add(f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY {_PICK.format(k='id')}) AS rn FROM occurrence WHERE genus IN (SELECT genus FROM occurrence GROUP BY genus HAVING count(*) > 590)) WHERE rn <= 7", ("occurrence",))
def wn05_listed_species(spark, sf_dir):
    occurrence = view(spark, sf_dir, "occurrence")
    listed = T.counts(occurrence, "genus").where("n > 590").select("genus")
    return S.per_group(occurrence.join(listed, "genus", "left_semi"), ["genus"], 7).select("id")


@R.add(f"SELECT id, CASE WHEN row_number() OVER (PARTITION BY genus ORDER BY {_PICK.format(k='id')}) <= 15 THEN 'target' ELSE 'overflow' END AS part FROM occurrence", ("occurrence",))
def wn06_overflow(spark, sf_dir):
    return S.split_overflow(view(spark, sf_dir, "occurrence"), ["genus"], 15).select("id", "part")


@R.add(f""", r AS (SELECT id, genus, row_number() OVER (PARTITION BY genus ORDER BY {_PICK.format(k='id')}) AS rn FROM occurrence), chosen AS (SELECT * FROM r WHERE rn <= 3),
  gone AS (SELECT genus, count(*) AS n FROM chosen WHERE CAST(id AS BIGINT) % 2 = 0 GROUP BY genus)
  SELECT id, genus FROM chosen WHERE CAST(id AS BIGINT) % 2 = 1 UNION ALL SELECT r.id, r.genus FROM r JOIN gone USING (genus) WHERE rn > 3 AND rn <= 3 + n""", ("occurrence",))
def wn07_swapped(spark, sf_dir):
    pool = view(spark, sf_dir, "occurrence").select("id", "genus")
    chosen = S.per_group(pool, ["genus"], 3)
    even = chosen.where(F.col("id").cast("long") % 2 == 0)
    return S.swapped(chosen, pool, even, "genus")


@R.add(f"SELECT id, frequency, row_number() OVER (ORDER BY frequency, {_PICK.format(k='id')}) AS position FROM (SELECT id, count(*) OVER (PARTITION BY genus) AS frequency FROM occurrence)", ("occurrence",))
def wn08_rarity_order(spark, sf_dir):
    return S.rarity_order(view(spark, sf_dir, "occurrence").select("id", "genus"), "genus").select("id", "frequency", "position")


@R.add("""SELECT cls, l_partkey, l_suppkey, l_linenumber, filename, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fp FROM detections
  WINDOW w AS (PARTITION BY cls ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING)""", ("detections",))
def wn09_running_hits(spark, sf_dir):
    from traitloom.operators.metrics import running_hits

    boxes = view(spark, sf_dir, "detections").withColumn("hit", F.col("l_linenumber") % 2 == 1)
    return running_hits(boxes, "cls", "score", _ORDER).select("cls", "l_partkey", "l_suppkey", "l_linenumber", "filename", "tp", "fp")


@R.add(f"SELECT id, row_number() OVER (ORDER BY {_PICK.format(k='id')}) AS position FROM occurrence", ("occurrence",))
def wn15_shuffled(spark, sf_dir):
    return S.shuffled(view(spark, sf_dir, "occurrence").select("id"))


@R.add("SELECT o_orderkey, rn AS position, (rn - 1) // 100 AS batch, (rn - 1) % 7 AS stripe FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)")
def wn16_batches(spark, sf_dir):
    return S.batches(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100, 7)


@R.add("""SELECT id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT id, CAST(('0x' || substr(md5(id || ':2023'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM occurrence)""", ("occurrence",))
def wn17_split(spark, sf_dir):
    return S.split(view(spark, sf_dir, "occurrence").select("id"), {"train": 0.8, "val": 0.1, "test": 0.1})


@R.add(f"SELECT id FROM occurrence ORDER BY {_PICK.format(k='id')} LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM occurrence)", ("occurrence",))
def wn18_sample(spark, sf_dir):
    return S.sample(view(spark, sf_dir, "occurrence").select("id"), 0.1)


@R.add("SELECT o_orderkey, 100000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS new_id FROM orders")
def wn19_sequential_ids(spark, sf_dir):
    return S.sequential_ids(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100000)


@R.add("SELECT class FROM (SELECT DISTINCT class FROM measurements) ORDER BY class LIMIT 5", ("measurements",))
def wn22_first_classes(spark, sf_dir):
    return view(spark, sf_dir, "measurements").select("class").distinct().orderBy("class").limit(5)


@R.add(f""", {UNITS_SQL}, s AS (SELECT ruler_id, avg(x) AS spacing, CASE CAST(ruler_id AS BIGINT) % 3 WHEN 0 THEN 'mm' WHEN 1 THEN '8th' ELSE 'halfcm' END AS unit FROM ticks GROUP BY ruler_id)
  SELECT ruler_id, unit, round(spacing * factor / divisor, 6) AS px_per_cm FROM s JOIN u USING (unit)""", ("ticks",))
def fn21_to_centimetres(spark, sf_dir):
    unit = F.get(F.array(F.lit("mm"), F.lit("8th"), F.lit("halfcm")), (F.col("ruler_id").cast("long") % 3).cast("int"))
    spacings = view(spark, sf_dir, "ticks").groupBy("ruler_id").agg(F.avg("x").alias("spacing")).withColumn("unit", unit)
    return _rounded(U.to_centimetres(spacings, U.units_table(spark)).select("ruler_id", "unit", "px_per_cm"), "px_per_cm")


@R.add("""SELECT component, CASE WHEN perimeter % 3 > 0 THEN round(area / (perimeter % 3) ** 2, 2) ELSE area END AS area_cm, CASE WHEN perimeter % 3 > 0 THEN round(perimeter / (perimeter % 3), 2) ELSE perimeter END AS perimeter_cm FROM measurements""", ("measurements",))
def fn22_converted(spark, sf_dir):
    factor = F.col("perimeter") % 3
    return view(spark, sf_dir, "measurements").select("component", U.converted(F.col("area"), factor, area=True).alias("area_cm"), U.converted(F.col("perimeter"), factor).alias("perimeter_cm"))


@R.add(""", v AS (SELECT ruler_id, x, sum(x) OVER w AS s, count(*) OVER w AS n, lead(x) OVER (PARTITION BY ruler_id ORDER BY x) AS nx, sum(x) OVER (PARTITION BY ruler_id) AS ts, count(*) OVER (PARTITION BY ruler_id) AS tn FROM ticks
    WINDOW w AS (PARTITION BY ruler_id ORDER BY x ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT ruler_id, arg_max(x, (round(s * s / n + (ts - s) * (ts - s) / (tn - n), 6), -x)) AS cut FROM v WHERE n < tn AND nx > x GROUP BY ruler_id)
  SELECT event_id, coalesce(x <= cut, true) AS low FROM ticks LEFT JOIN c USING (ruler_id)""", ("ticks",))
def ml08_two_clusters(spark, sf_dir):
    return U.two_clusters(view(spark, sf_dir, "ticks"), "ruler_id", "x").select("event_id", "low")


@R.add(f""", {UNITS_SQL}, t AS (SELECT ruler_id, strip, x, event_id, ['mm', '8th', 'halfcm'][strip % 3 + 1] AS unit FROM ticks), g AS (SELECT ruler_id, strip, unit, lead(x) OVER (PARTITION BY ruler_id, strip ORDER BY x, event_id) - x AS gap FROM t),
  l AS (SELECT ruler_id, strip, avg(gap) * max(factor) / max(divisor) AS cm, stddev_pop(gap) AS sd, count(*) AS n FROM g JOIN u USING (unit) WHERE gap IS NOT NULL GROUP BY ruler_id, strip)
  SELECT ruler_id, round(avg(cm), 5) AS cm, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum((n - 1) * sd * sd) / greatest(CAST(sum(n) - count(*) AS DOUBLE), 1e-15)), 5) AS pooled_sd, round(CASE WHEN count(*) > 1 THEN stddev_samp(cm) / avg(cm) * 100 ELSE 0 END, 5) AS rsd, max_dim
  FROM l JOIN (SELECT ruler_id, greatest(max(x), CAST(max(strip) AS DOUBLE)) AS max_dim FROM ticks GROUP BY ruler_id) USING (ruler_id) GROUP BY ruler_id, max_dim""", ("ticks",))
def ag12_label_rollup(spark, sf_dir):
    ticks = view(spark, sf_dir, "ticks")
    unit = F.get(F.array(F.lit("mm"), F.lit("8th"), F.lit("halfcm")), F.col("strip") % 3)
    line = W.partitionBy("ruler_id", "strip").orderBy("x", "event_id")
    points = ticks.select("ruler_id", "strip", unit.alias("unit"), F.row_number().over(line).alias("seq"), "x", F.lit(0.0).alias("y"))
    sizes = ticks.groupBy("ruler_id").agg(F.max("x").alias("width"), F.max("strip").cast("double").alias("height"))
    out = U.label_rollup(U.line_readings(points, U.units_table(spark), ["ruler_id", "strip"]), sizes, "ruler_id")
    return _rounded(out, "cm", "pooled_sd", "rsd", digits=5)


_BLOBS = """b AS (SELECT l_orderkey AS ruler_id, CAST(l_linenumber % 2 AS INTEGER) AS rank, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(20 + l_orderkey % 40 AS DOUBLE) AS major,
    (20 + l_orderkey % 40) / (CASE (l_orderkey + l_linenumber % 2) % 5 WHEN 0 THEN 1.75 WHEN 1 THEN 4.5 WHEN 2 THEN 2.2 WHEN 3 THEN 6.8 ELSE 3.0 END + CAST(l_tax AS DOUBLE)) AS minor FROM lineitem),
  pred AS (SELECT o_orderkey AS ruler_id, CAST(15 + o_orderkey % 60 AS DOUBLE) AS predicted FROM orders)"""


# spacing shares and factors of each kind of block, as in the operator
@R.add(f"""WITH {_BLOBS}, n AS (SELECT *, least(coalesce(x - lag(x) OVER w, 1e9), coalesce(lead(x) OVER w - x, 1e9)) AS gap FROM b WINDOW w AS (PARTITION BY ruler_id, rank ORDER BY x)),
  s AS (SELECT ruler_id, rank, avg(gap) AS spacing FROM n WHERE gap > 1 AND gap < 1e9 GROUP BY ALL), g AS (SELECT ruler_id, rank, count(*) AS n, avg(major / minor) AS ratio, avg(major) AS major, avg(minor) AS minor FROM b GROUP BY ALL),
  k AS (SELECT *, CASE WHEN ratio BETWEEN 0.9 * 1.75::DOUBLE AND (1 + 0.1::DOUBLE) * 1.75 THEN 'bigCM' WHEN ratio BETWEEN 0.75 * 4.5 AND 1.25 * 4.5 THEN 'smallCM' WHEN ratio BETWEEN 0.9 * 2.2 AND 1.1 * 2.2 THEN 'halfCM' WHEN ratio BETWEEN 0.9 * 6.8 AND 1.1 * 6.8 THEN 'mm' END AS kind FROM g WHERE n BETWEEN 2 AND 10),
  f AS (SELECT ruler_id, rank, kind, CASE WHEN kind = 'bigCM' AND spacing BETWEEN 0.8 * major AND 1.2 * major THEN spacing WHEN kind = 'smallCM' AND spacing BETWEEN 1.6 * major AND 2.4 * major THEN spacing * 0.5
      WHEN kind = 'halfCM' AND spacing BETWEEN 0.8 * major AND 1.2 * major THEN spacing * 2 WHEN kind = 'mm' AND spacing BETWEEN 0.1 * minor AND 1.1 * minor THEN spacing * 10 END AS factor FROM k JOIN s USING (ruler_id, rank) WHERE kind IS NOT NULL),
  d AS (SELECT *, row_number() OVER (PARTITION BY ruler_id, kind ORDER BY rank) AS nth FROM f WHERE factor IS NOT NULL), e AS (SELECT *, min(CASE WHEN nth > 1 THEN rank END) OVER (PARTITION BY ruler_id) AS stop FROM d),
  v AS (SELECT e.*, CASE kind WHEN 'bigCM' THEN 0 WHEN 'smallCM' THEN 1 WHEN 'halfCM' THEN 2 ELSE 3 END AS i FROM e JOIN pred USING (ruler_id) WHERE (stop IS NULL OR rank < stop) AND abs(factor - predicted) <= 0.1 * predicted),
  r AS (SELECT ruler_id, avg(factor) AS factor, CASE WHEN count(*) > 1 THEN 'average' ELSE min(kind) END AS location, string_agg(kind, ', ' ORDER BY i) AS options FROM v GROUP BY ruler_id)
  SELECT ruler_id, round(coalesce(factor, 0), 6) AS factor, coalesce(location, 'fail') AS location, coalesce(options, '') AS options FROM pred LEFT JOIN r USING (ruler_id)""")
def ag17_block_factors(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    turn = (F.col("l_orderkey") + F.col("l_linenumber") % 2) % 5
    ratio = F.get(F.array(*[F.lit(r) for r in (1.75, 4.5, 2.2, 6.8, 3.0)]), turn.cast("int")) + F.col("l_tax").cast("double")
    major = (20 + F.col("l_orderkey") % 40).cast("double")
    blobs = rows.select(F.col("l_orderkey").alias("ruler_id"), (F.col("l_linenumber") % 2).cast("int").alias("rank"), (F.col("l_partkey") % 97).cast("double").alias("x"), major.alias("major"), (major / ratio).alias("minor"))
    predicted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ruler_id"), (15 + F.col("o_orderkey") % 60).cast("double").alias("predicted"))
    return _rounded(U.block_factors(blobs, predicted), "factor")
