"""The minimum slice: what was detected on each sheet."""

from __future__ import annotations

from traitloom.operators.detections import PLANT_CLASSES, phenology

from ._register import Registry
from .views import view

R = Registry()
QUERIES, ORACLE_SQL = R.QUERIES, R.ORACLE_SQL

_FERTILE = [PLANT_CLASSES.index(n) for n in ("seed_fruit_one", "seed_fruit_many", "flower_one", "flower_many")]


@R.add(
    "SELECT filename, "
    + ", ".join(f"count(*) FILTER (cls = {i}) AS {name}" for i, name in enumerate(PLANT_CLASSES))
    + ", count(*) FILTER (cls IN (0, 1)) > 0 AS has_leaves, greatest("
    + ", ".join(f"count(*) FILTER (cls = {i})" for i in _FERTILE)
    + ") > 0 AS is_fertile FROM detections GROUP BY filename",
    ("detections",),
)
def ag01_phenology(spark, sf_dir):
    return phenology(view(spark, sf_dir, "detections").select("filename", "cls"), image="filename")
