"""Joins and set operations between specimen tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitloom.functions.naming import specimen_names
from traitloom.operators.filters import first_rows
from traitloom.operators.lineage import cut, in_ranges


def combined(images: DataFrame, occurrences: DataFrame, on_null: str = "blank") -> DataFrame:
    """Multimedia rows with their occurrence and specimen names."""
    return specimen_names(images.join(occurrences, "id"), on_null)


def known_images(images: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Images whose id, as text, is an occurrence's."""
    ids = occurrences.select(F.col("id").cast("string").alias("id"))
    return images.withColumn("id", F.col("id").cast("string")).join(ids, "id", "left_semi")


def mutual(one: DataFrame, two: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both tables restricted to the keys they share."""
    return one.join(two.select(key), key, "left_semi"), two.join(one.select(key), key, "left_semi")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list) -> DataFrame:
    """Left join to the first right row of each key."""
    return left.join(first_rows(right, [key], order), key, "left")


def id_lookup(images: DataFrame, occurrences: DataFrame, prefix: bool = False) -> DataFrame:
    """Occurrences of each image id (columns id, occurrence_id).

    ``prefix`` also finds ids that only begin with the image's id: an
    occurrence brings its prefixes of the lengths that image ids have, and
    these meet whole image ids.  Empty and null ids find nothing.
    """
    found = occurrences.select(F.col("id").alias("occurrence_id"))
    if not prefix:
        return images.select("id").join(found, F.col("id") == F.col("occurrence_id"))
    lengths = images.where("id <> ''").agg(F.collect_set(F.length("id")).alias("_lengths"))  # one row, no longer than the longest id
    fitting = F.filter("_lengths", lambda n: n <= F.length("occurrence_id"))
    prefixes = F.explode(F.transform(fitting, lambda n: F.substr("occurrence_id", F.lit(1), n)))
    return images.select("id").join(found.crossJoin(F.broadcast(lengths)).select("occurrence_id", prefixes.alias("id")), "id")


def wish_counts(wishes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences of each wished (family, genus, species), zeros kept; only families that occur."""
    counts = occurrences.groupBy("family", F.col("genus").alias("wish_genus"), F.col("species").alias("wish_species")).agg(F.count("*").alias("n"))
    there = wishes.join(occurrences.select("family"), "family", "left_semi")
    return there.join(counts, ["family", "wish_genus", "wish_species"], "left").select("family", "wish_genus", "wish_species", F.coalesce("n", F.lit(0)).alias("n"))


def merged_with_suffixes(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns that both sides have get a suffix."""
    clash = [c for c in left.columns if c in right.columns and c != key]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    return left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), key)


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them to one task.

    Rows are range-partitioned, sorted and written; the partitions' counts (one
    small row each) give every partition its offset.
    """
    ranged = in_ranges(df, order)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def positions_in_groups(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Rows numbered from 1 within groups, in a total order; a group spreads over as many range partitions as it fills.

    Only each group's first position (one row per group) meets the rows again.
    """
    ranged = numbered(df, [*keys, *order], "_at")
    first = ranged.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min("_at").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return ranged.join(first, same).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", *first.columns)


def unique_file_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Valid file names, no two alike: ``valid_name``.

    Every cleaned name stays with one row, with one that had it from the start
    if there is such a row, else with the first.  The others get the lowest
    numbers behind an underscore that no cleaned name takes: the rth of them
    gets r and as many more as taken numbers lie at or before it, which is its
    place among both in a common order.  Null names stay null.
    """
    rows = df.withColumn("valid_name", F.regexp_replace(name, "[^a-zA-Z0-9_-]", "-")).withColumn("_changed", F.col("valid_name") != F.col(name))
    null = rows.where("valid_name is null").drop("_changed")
    turns = cut(positions_in_groups(rows.where("valid_name is not null"), ["valid_name"], ["_changed", *order], "_turn").drop("_changed"))
    rest = turns.where("_turn > 1")
    number = r"^(.*)_([1-9][0-9]{0,17})$"
    bases = turns.where("_turn = 1").select("valid_name").where(F.regexp_like("valid_name", F.lit(number)))
    taken = bases.select(F.regexp_extract("valid_name", number, 1).alias("valid_name"), F.regexp_extract("valid_name", number, 2).cast("long").alias("_number"))
    taken = positions_in_groups(taken.join(rest.select("valid_name"), "valid_name", "left_semi"), ["valid_name"], ["_number"], "_turn")
    at = taken.select("valid_name", (F.col("_number") - F.col("_turn") + 1).alias("_at"), F.lit(0).alias("_kind"))
    both = rest.withColumns({"_at": F.col("_turn") - 1, "_kind": F.lit(1)}).unionByName(at, allowMissingColumns=True)
    numbers = positions_in_groups(both, ["valid_name"], ["_at", "_kind"], "_place").where("_kind = 1")
    named = numbers.withColumn("valid_name", F.concat_ws("_", "valid_name", F.col("_place").cast("string")))
    return turns.where("_turn = 1").select(*null.columns).unionByName(named.select(*null.columns)).unionByName(null)


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their position in an explicit order; the longer side keeps its rest."""
    return numbered(left, left_order).join(numbered(right, right_order), "position", "full_outer")


def unlabelled(images: DataFrame, labels: DataFrame, image: str, label: str) -> DataFrame:
    """Images whose file stem is no label's."""
    stem = F.regexp_replace(F.col(image), r"\.[^.]*$", "")
    stems = labels.select(F.regexp_replace(F.col(label), r"\.[^.]*$", "").alias("_stem"))
    return images.withColumn("_stem", stem).join(stems, "_stem", "left_anti").drop("_stem")


def closest_pair(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Closest pair of points of two point sets per object, and its truncated midpoint."""
    pairs = _point_pairs(one, two, key)
    best = pairs.groupBy(key).agg(F.min(F.struct("d2", "x1", "y1", "x2", "y2")).alias("p"))
    middle = lambda a, b: ((F.col(f"p.{a}") + F.col(f"p.{b}")) / 2).cast("long")
    return best.select(key, "p.x1", "p.y1", "p.x2", "p.y2", middle("x1", "x2").alias("mid_x"), middle("y1", "y2").alias("mid_y"))


def _point_pairs(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    left = one.select(key, F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = two.select(key, F.col("x").alias("x2"), F.col("y").alias("y2"))
    d2 = (F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2
    return left.join(right, key).withColumn("d2", d2)


def chosen_pair(left: DataFrame, right: DataFrame, key: str, mode: str = "shortest") -> DataFrame:
    """A pair of one left and one right point per object: the shortest, or the one with the largest ``|dx + dy|``."""
    pairs = _point_pairs(left, right, key).withColumn("slant", F.abs(F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")))
    value = F.struct("x1", "y1", "x2", "y2")
    pick = F.min(F.struct("d2", value.alias("v"))) if mode == "shortest" else F.max(F.struct("slant", value.alias("v")))
    return pairs.groupBy(key).agg(pick.alias("p")).select(key, "p.v.*")


def nearest_point(points: DataFrame, references: DataFrame, key: str, farthest: bool = False) -> DataFrame:
    """For each point the nearest (or farthest) reference point of its object."""
    left = points.select(key, "seq", "x", "y")
    right = references.select(key, F.col("seq").alias("ref_seq"), F.col("x").alias("ref_x"), F.col("y").alias("ref_y"))
    d2 = (F.col("x") - F.col("ref_x")) ** 2 + (F.col("y") - F.col("ref_y")) ** 2
    pick = F.struct((-d2 if farthest else d2).alias("d"), "ref_seq", "ref_x", "ref_y")
    return left.join(right, key).groupBy(key, "seq").agg(F.min(pick).alias("r")).select(key, "seq", "r.ref_seq", F.sqrt(F.abs(F.col("r.d"))).alias("distance"))


def means_in_order(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Mean of each group, summed row by row in ``order``.

    Partial sums of doubles would leave the last bit to how the rows were dealt
    into tasks.  Running sums spill, so that a hot group needs no memory for all
    its rows.
    """
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = df.where(F.col(value).isNotNull()).select(*keys, F.avg(value).over(so_far).alias("_mean"), F.count("*").over(so_far).alias("_n"))
    return running.groupBy(*keys).agg(F.max_by("_mean", "_n").alias("mean"))


def consistent_spacings(spacings: DataFrame, units: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Pairs of (strip, unit) readings of one ruler whose pixel-per-cm factors agree.

    ``spacings`` has ruler_id, strip and mean; ``units`` unit, factor, divisor.
    Readings meet by buckets of cm: such a pair lies in one or in neighbouring
    buckets.  These are a little wider than ``tolerance``, so that rounding
    cannot set a pair two buckets apart.
    """
    read = spacings.crossJoin(F.broadcast(units)).select("ruler_id", "strip", "unit", (F.col("mean") * F.col("factor") / F.col("divisor")).alias("cm"))
    one = read.select("ruler_id", *[F.col(c).alias(c + "_a") for c in ("strip", "unit", "cm")])
    two = read.select("ruler_id", *[F.col(c).alias(c + "_b") for c in ("strip", "unit", "cm")])
    later = (F.col("strip_a") < F.col("strip_b")) | ((F.col("strip_a") == F.col("strip_b")) & (F.col("unit_a") < F.col("unit_b")))
    width = 1.001 * (tolerance if tolerance > 0 else 1.0)
    bucket = lambda c: F.floor(F.col(c) / width)
    one = one.withColumn("_bucket", bucket("cm_a"))
    two = two.withColumn("_bucket", F.explode(F.array(*[bucket("cm_b") + i for i in (-1, 0, 1)])))
    return one.join(two, ["ruler_id", "_bucket"]).drop("_bucket").where(later & (F.abs(F.col("cm_a") - F.col("cm_b")) < tolerance))


def shared_values(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    return one.select(column).intersect(two.select(column))


def difference(one: DataFrame, two: DataFrame, all_rows: bool = False) -> DataFrame:
    return one.exceptAll(two) if all_rows else one.subtract(two)


def stacked(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def melted(df: DataFrame, keys: list[str], columns: list[str], kind: str = "kind", value: str = "value") -> DataFrame:
    """One row per key and non-null cell of the given columns."""
    return df.unpivot(keys, columns, kind, value).where(F.col(value).isNotNull())


def either_and_both(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Union and intersection of two row sets given as conditions."""
    return df.withColumns({"in_either": a | b, "in_both": a & b})
