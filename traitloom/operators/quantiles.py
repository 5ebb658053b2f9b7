"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.lineage import cut, in_ranges

#: Distinct values of a group that one task may hold.
TOGETHER = 1_000_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], together: int = TOGETHER) -> DataFrame:
    """Keys and, per name in ``shares``, the group's quantile at that share, with linear interpolation.

    Rows become distinct values with their number first.  Where no group has
    more than ``together`` of these, each group's are ranked in one task.
    Otherwise they are dealt into ranges of (keys, value): numbers run inside
    each range, what lies before is added from one small row per range and
    group, and a quantile is the least value whose running number exceeds its
    rank.  Null values do not count, and a group without others has no row;
    null keys make a group.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    counts = cut(counts)
    largest = counts.groupBy(*names).agg(F.count("*").alias("k")).agg(F.max("k").alias("k")).first()["k"] or 0
    if largest <= together:
        found = counts.groupBy(*names).agg(*[F.percentile("_value", p, F.col("_n")).alias(c) for c, p in shares.items()])
        return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *shares)
    ranged = in_ranges(counts, [*names, "_value"]).drop("_nth")
    inside = W.partitionBy("_part", *names).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*names).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("_part", *names).agg(F.sum("_n").alias("_rows"))
    before = parts.select(F.col("_part").alias("_p"), *[F.col(n).alias(f"{n}b") for n in names], F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy(*names)).alias("_all"))
    same = [F.col("_part") == F.col("_p"), *[F.col(n).eqNullSafe(F.col(f"{n}b")) for n in names]]
    rows = ranged.withColumn("_upto", F.sum("_n").over(inside)).join(before, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    at = {c: F.lit(p) * (F.col("_all") - 1) for c, p in shares.items()}
    sides = [F.min(F.when(F.col("_upto") > side(at[c]), F.col("_value").cast("double"))).alias(f"{c}{end}") for c in shares for end, side in (("_lo", F.floor), ("_hi", F.ceil))]
    found = rows.groupBy(*names, "_all").agg(*sides)
    between = lambda c: (F.floor(at[c]) + 1 - at[c]) * F.col(f"{c}_lo") + (at[c] - F.floor(at[c])) * F.col(f"{c}_hi")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[between(c).alias(c) for c in shares])
