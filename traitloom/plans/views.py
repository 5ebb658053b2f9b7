"""Entity tables projected from the supplied star schema.

Each view has the shape of one input of the specimen pipeline.  The SQL text is
plain enough for Spark and DuckDB alike, so that an operator and its reference
SQL read the same rows.
"""

from __future__ import annotations

import re

# Deterministic order of multimedia rows: line numbers are not unique in an order.
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

VIEWS = {
    "occurrence": """
        SELECT CAST(o_orderkey AS STRING) AS id, r_name AS family, n_name AS genus,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN lower(c_mktsegment) || ' var' ELSE lower(c_mktsegment) END AS "specificEpithet",
               CASE WHEN o_orderkey % 3 <> 0 THEN 'H' || CAST(c_nationkey AS STRING) END AS "institutionCode",
               CASE WHEN o_orderkey % 17 = 0 THEN 'UBC Herbarium' ELSE c_name END AS "institutionID",
               c_name AS publisher,
               CASE WHEN o_orderkey % 13 = 0 THEN 'http://id.luomus.fi/' || CAST(o_orderkey AS STRING) ELSE 'urn:catalog:' || CAST(o_orderkey AS STRING) END AS "occurrenceID",
               year(o_orderdate) AS year, month(o_orderdate) AS month
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "multimedia": """
        SELECT CAST(l_orderkey AS STRING) AS id,
               CASE WHEN l_partkey % 29 = 0 THEN NULL
                    WHEN l_partkey % 31 = 0 THEN 'http://host' || CAST(l_suppkey % 20 AS STRING) || '.example.org/' || CAST(l_orderkey AS STRING) || '/manifest'
                    ELSE 'http://host' || CAST(l_suppkey % 20 AS STRING) || '.example.org/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '.jpg' END AS identifier,
               CAST(800 + l_partkey AS INT) AS width, CAST(600 + 37 * l_suppkey AS INT) AS height,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
        FROM {lineitem}""",
    "detections": """
        SELECT CAST(l_orderkey AS STRING) AS filename, CAST(l_partkey % 11 AS INT) AS cls,
               (l_partkey % 997) / CAST(997 AS DOUBLE) AS xc, (l_suppkey % 89) / CAST(89 AS DOUBLE) AS yc,
               CAST(l_quantity AS DOUBLE) / 100 AS w, CAST(0.02 AS DOUBLE) + CAST(l_tax AS DOUBLE) AS h, CAST(l_discount AS DOUBLE) * 10 AS score,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
        FROM {lineitem}""",
    "ticks": """
        SELECT CAST(user_id AS STRING) AS ruler_id, CAST(day(ts) AS INT) AS strip, CAST(value AS DOUBLE) AS x, event_id FROM {events} WHERE value IS NOT NULL""",
    "trace": """
        SELECT user_id AS obj, ts, event_id, CAST(value AS DOUBLE) AS x, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS y FROM {events} WHERE value IS NOT NULL""",
    "ruler_records": """
        SELECT CAST(l_orderkey AS STRING) AS filename, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS confidence,
               CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS conversion_mean, CAST(10 AS DOUBLE) * (1 + CAST(l_tax AS DOUBLE)) AS predicted,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
        FROM {lineitem}""",
    "measurements": """
        SELECT CAST(p_partkey AS STRING) AS component, p_brand AS class, CAST(p_retailprice AS DOUBLE) AS area, CAST(4 * p_size + 1 AS DOUBLE) AS perimeter,
               CAST(p_retailprice AS DOUBLE) * 1.25 AS convex_hull
        FROM {part}""",
    "landmarks": """
        SELECT CAST(l_partkey AS STRING) AS component, avg(CAST(l_quantity AS DOUBLE)) * 3 AS apex_angle, avg(CAST(l_discount AS DOUBLE)) * 1000 AS base_angle
        FROM {lineitem} GROUP BY l_partkey""",
    "conversion_training": """
        SELECT CAST(p_partkey AS STRING) AS component, CAST(100 * p_size AS INT) AS image_height, CAST(2000 + p_partkey % 700 AS INT) AS image_width,
               CAST(p_retailprice AS DOUBLE) / 10 AS conversion_mean, CASE WHEN p_partkey % 4 > 0 THEN 1 ELSE 0 END AS correct
        FROM {part}""",
    "download_log": """
        SELECT event_id AS id, ts, 'taxon' || CAST(user_id % 30 AS STRING) AS fullname, 'host' || CAST(user_id % 20 AS STRING) AS host,
               CASE WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'signup' THEN 'skip' ELSE 'ok' END AS status
        FROM {events}""",
    "url_pages": "SELECT page_id, url FROM {pages}",
}
# Derived views, over the others.
VIEWS["pixel_boxes"] = """
    SELECT filename, cls, score, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
           CAST(trunc_int((xc - w / 2) * 1000) AS BIGINT) AS x1, CAST(trunc_int((yc - h / 2) * 1000) AS BIGINT) AS y1,
           CAST(trunc_int((xc + w / 2) * 1000) AS BIGINT) AS x2, CAST(trunc_int((yc + h / 2) * 1000) AS BIGINT) AS y2
    FROM ({detections_view}) d"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def _text(name: str, tables: dict[str, str], spark: bool) -> str:
    text = VIEWS[name]
    for inner in re.findall(r"\{(\w+)_view\}", text):
        text = text.replace("{" + inner + "_view}", _text(inner, tables, spark))
    for table, ref in tables.items():
        text = text.replace("{" + table + "}", ref)
    if spark:
        text = re.sub(r"trunc_int\((.*?)\) AS BIGINT", r"CAST(\1 AS BIGINT) AS BIGINT", text)
        text = re.sub(r'"(\w+)"', r"`\1`", text)
    else:
        text = text.replace("trunc_int(", "trunc(")
    return text


def view(spark, sf_dir: str, name: str):
    """The view as a Spark DataFrame."""
    return spark.sql(_text(name, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}, True))


def read(spark, sf_dir: str, name: str):
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """``WITH`` clause that gives DuckDB the named views."""
    return "WITH " + ", ".join(f"{n} AS ({_text(n, {t: t for t in _TABLES}, False)})" for n in names) + " "
