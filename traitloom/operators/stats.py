"""Group statistics of traits, logs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.quantiles import exact_quantiles

def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def quota_audit(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows per group and whether that is the quota."""
    return counts(df, key).withColumn("is_full", F.col("n") == n)


def spread(df: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """Means and sample deviations of two traits per class, with ellipse axes and circle radius."""
    s1, s2 = F.coalesce(F.stddev_samp(one), F.lit(0.0)), F.coalesce(F.stddev_samp(two), F.lit(0.0))
    out = df.groupBy(key).agg(F.avg(one).alias("mean_1"), F.avg(two).alias("mean_2"), s1.alias("sd_1"), s2.alias("sd_2"))
    return out.withColumns({"axis_1": 2 * F.col("sd_1"), "axis_2": 2 * F.col("sd_2"), "radius": (F.col("sd_1") + F.col("sd_2")) / 2})


def medians(df: DataFrame, key: str, values: list[str], accuracy: int | None = None) -> DataFrame:
    """Medians per group: exact, or to a rank error of 1 / ``accuracy`` in one pass; null for a group without values."""
    if accuracy is not None:
        return df.groupBy(key).agg(*[F.percentile_approx(v, 0.5, accuracy).alias(f"median_{v}") for v in values])
    out = df.select(F.col(key).alias("_key")).distinct()
    for v in values:
        found = exact_quantiles(df, [key], v, {f"median_{v}": 0.5}).withColumnRenamed(key, "_of")
        out = out.join(found, F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_of")
    return out.withColumnRenamed("_key", key)


def anova(df: DataFrame, key: str, value: str) -> DataFrame:
    """One-way F of a trait over classes, from the classes' counts, sums and sums of squares."""
    groups = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("q"))
    total = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return total.select((between / within).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def strikes(log: DataFrame, most: int = 50) -> DataFrame:
    """Failures per host and whether the host is banned for them."""
    return log.where("status <> 'ok'").groupBy("host").agg(F.count("*").alias("strikes")).withColumn("banned", F.col("strikes") > most)


def download_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("fullname").agg(F.count("*").alias("tried"), F.count_if(F.col("status") == "ok").alias("done"))


def stage_times(events: DataFrame, keys: list[str]) -> DataFrame:
    """Elapsed seconds between the first and last event of each group."""
    return events.groupBy(*keys).agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6).alias("seconds"))


def failures_by_host(log: DataFrame, span: int = 10_000) -> DataFrame:
    """Failures of each host as JSON texts in order of id, one per ``span`` ids (part), so that none grows with the log."""
    rows = F.array_sort(F.collect_list(F.struct("id", "status")))
    part = F.floor(F.col("id") / span).alias("part")
    return log.where("status <> 'ok'").groupBy("host", part).agg(F.to_json(rows).alias("failures"))
