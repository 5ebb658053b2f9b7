"""Quotas, samples, splits and batches in a hash order that never changes.

Samples are ordered by md5 of the row's key and a seed, then by the key itself,
so they do not depend on partitioning and another engine can draw the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.operators.filters import first_rows
from traitloom.operators.linkage import numbered, positions_in_groups


def ticket(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the ticket."""
    return F.conv(F.substring(ticket(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def per_group(df: DataFrame, keys: list[str], n: int, key: str = "id", seed: int = 2023) -> DataFrame:
    """At most n rows of every group."""
    return first_rows(df, keys, [ticket(key, seed), key], n)


def quotas(df: DataFrame, caps: dict[str, int | None], total: int | None = None, key: str = "id", seed: int = 2023) -> DataFrame:
    """Hierarchical quotas in one shuffled order; ``caps`` runs from the finest level to the coarsest."""
    order = [ticket(key, seed), key]
    for level, cap in caps.items():
        if cap is not None:
            df = first_rows(df, [level], order, cap)
    return df if total is None else df.orderBy(*order).limit(total)


def one_or_middle_of_three(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Single rows, and the second of three; all other groups go."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n").isin(1, 3))
    few = df.join(counts, key)
    few = few.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return few.where((F.col("_n") == 1) | (F.col("_rn") == 2)).drop("_n", "_rn")


def split_overflow(df: DataFrame, keys: list[str], n: int, key: str = "id", seed: int = 2023) -> DataFrame:
    """All rows, marked target (the first n of a group) or overflow."""
    turns = positions_in_groups(df.withColumn("_ticket", ticket(key, seed)), keys, ["_ticket", key], "_turn")
    return turns.withColumn("part", F.when(F.col("_turn") <= n, "target").otherwise("overflow")).drop("_ticket", "_turn")


def swapped(chosen: DataFrame, pool: DataFrame, out: DataFrame, group: str, key: str = "id", seed: int = 2023) -> DataFrame:
    """Replace rows of a choice by rows of the same group that were neither chosen nor removed; ``out`` has the removed keys."""
    out = out.select(key)
    removed = chosen.join(out, key, "left_semi")
    free = pool.join(chosen.select(key), key, "left_anti")
    wanted = removed.groupBy(group).agg(F.count("*").alias("_n"))
    asked = free.join(wanted, group, "left_semi").withColumn("_ticket", ticket(key, seed))
    new = positions_in_groups(asked, [group], ["_ticket", key], "_rn").join(wanted, group).where(F.col("_rn") <= F.col("_n")).select(*chosen.columns)
    return chosen.join(out, key, "left_anti").unionByName(new)


def rarity_order(df: DataFrame, taxon: str, key: str = "id", seed: int = 2023) -> DataFrame:
    """Rows numbered with rare taxa first, shuffled within equal rarity."""
    counts = df.groupBy(taxon).agg(F.count("*").alias("frequency"))
    ordered = df.join(counts, taxon).withColumn("_ticket", ticket(key, seed))
    return numbered(ordered, ["frequency", "_ticket", key]).drop("_ticket")


def shuffled(df: DataFrame, key: str = "id", seed: int = 2023) -> DataFrame:
    return numbered(df.withColumn("_ticket", ticket(key, seed)), ["_ticket", key]).drop("_ticket")


def batches(df: DataFrame, order: list[str], size: int, stripes: int) -> DataFrame:
    """Contiguous batches of a fixed size, and stripes dealt round."""
    at = F.col("position") - 1
    return numbered(df, order).withColumns({"batch": F.floor(at / size), "stripe": at % stripes})


def split(df: DataFrame, shares: dict[str, float], key: str = "id", seed: int = 2023) -> DataFrame:
    """A stable split by hash into named parts."""
    u, upto, part = uniform(key, seed), 0.0, None
    for name, share in shares.items():
        upto += share
        part = F.when(u < upto, name) if part is None else part.when(u < upto, name)
    return df.withColumn("split", part.otherwise(list(shares)[-1]))


def sample(df: DataFrame, amount: float, key: str = "id", seed: int = 2023) -> DataFrame:
    """``amount`` rows, or that share of all rows if it is below 1."""
    n = int(df.count() * amount) if amount < 1 else int(amount)
    drawn = numbered(df.withColumn("_ticket", ticket(key, seed)), ["_ticket", key], "_turn").where(F.col("_turn") <= n)
    return drawn.drop("_ticket", "_turn")


def sequential_ids(df: DataFrame, order: list[str], offset: int) -> DataFrame:
    return numbered(df, order).withColumn("new_id", F.col("position") + offset - 1).drop("position")


def distinct_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of equal values of an object."""
    return first_rows(df, keys, order)
