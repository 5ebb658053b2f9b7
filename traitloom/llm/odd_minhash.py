"""Near-duplicate components: banded MinHash, odd sketches, exact confirmation.

Every text's set of distinct word shingles is reduced to ``bands * rows``
MinHash samples.  The samples are folded into a parity bitmap (an odd sketch):
two bitmaps' XOR population count grows with the number of samples that
differ, which tells high similarities apart precisely.  Banding proposes
pairs, the odd sketch discards those that cannot reach the threshold, and the
full shingle sets of the rest are compared.

With 4 rows and 32 bands a pair of similarity 0.8 shares no band with
probability (1 - 0.8**4)**32 < 5e-8.  The popcount bound lies six standard
deviations above the mean of a pair at the threshold.

Pairs stay few without losing links between different texts.  Equal sets are
one class from the start.  A bucket's members are first compared with its
smallest member (a star); what that links is contracted.  In buckets that then
hold several components, each member is compared with the most similar of a
few hubs of other components.  What is still apart after
that meets through an exact prefix filter: with shingles ordered from rare to
common, two sets of sufficient overlap share one early enough in both, and
texts with too many shingles of their own meet nothing at all.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, mix, packed_text, raw_text, rolling, signed, steps, unpacked, word_hashes

_BASE = 0xC2B2AE3D27D4EB4F
_SALT = np.uint64(0x165667B19E3779F9)
#: 64-bit words of an odd sketch.
SKETCH_LONGS = 16
#: MinHash samples folded into it; the first of them are banded.
SAMPLES = 256
#: Rounds of stars between the components of a bucket.
ROUNDS = 1
#: Texts signed at a time; a text takes ``SAMPLES`` numbers several times over.
_SIGNED = 256


def shingle_sets(data, bounds, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole text if it is shorter."""
    h, first = word_hashes(data, bounds, fold_case=True)
    grams = mix(rolling(h, words, _BASE) + np.uint64(words))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix(rolling(h[a:b], b - a, _BASE) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(words: int, bands: int, rows: int):
    samples = SAMPLES
    rng = np.random.default_rng(9176)
    odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, samples, dtype=np.uint64)
    bits = SKETCH_LONGS * 64

    def run(batches):
        for step in steps(batches, limit=1 << 20, rows=_SIGNED):
            sets = shingle_sets(*raw_text(step.column("text")), words)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            mins = np.zeros((len(full), samples), np.uint64)
            set_a = np.zeros(len(sets), np.uint64)
            set_b = np.zeros(len(sets), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(size[full]) - size[full]
                work = np.empty_like(flat)
                for j in range(samples):
                    np.multiply(flat, odd[j], out=work)
                    np.bitwise_xor(work, plus[j], out=work)
                    mins[:, j] = np.minimum.reduceat(work, starts)
                set_a[full] = np.add.reduceat(mix(flat), starts)
                set_b[full] = np.add.reduceat(mix(flat ^ _SALT), starts)
            keyed = mix(mins + np.arange(samples, dtype=np.uint64) * _SALT)
            band = keyed[:, : bands * rows].reshape(len(full), bands, rows)
            key = np.arange(bands, dtype=np.uint64)[None, :] * _SALT
            for r in range(rows):
                key = mix(key + band[:, :, r])
            sketch = np.zeros((len(full), bits), np.uint8)
            place = (keyed >> np.uint64(40)) % np.uint64(bits)
            np.add.at(sketch, (np.repeat(np.arange(len(full)), samples), place.ravel().astype(np.int64)), 1)
            packed = np.packbits(sketch & 1, axis=1).view(np.uint64)
            keys = pa.ListArray.from_arrays(_list_bounds(size, bands), pa.array(signed(key.ravel())))
            odds = pa.ListArray.from_arrays(_list_bounds(size, SKETCH_LONGS), pa.array(signed(packed.ravel())))
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(signed(set_a)), pa.array(signed(set_b)), keys, odds],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"],
            )

    return run


def _list_bounds(size: np.ndarray, each: int) -> pa.Array:
    return pa.array(np.append(0, np.cumsum((size > 0) * each)).astype(np.int32))


def popcount_bound(percent: int) -> int:
    """Differing bits that a pair at the threshold has, plus six standard deviations."""
    bits, p = SKETCH_LONGS * 64, 1 - percent / 100
    mean = SAMPLES * p

    def odd_bits(differing):
        return bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing))

    from_samples = (odd_bits(mean + 1) - odd_bits(mean)) * sqrt(SAMPLES * p * (1 - p))
    from_folding = sqrt(bits) / 4
    return round(odd_bits(mean) + 6 * sqrt(from_samples**2 + from_folding**2))


def _distance(one: str, two: str) -> Column:
    bits = [F.bit_count(F.col(one)[i].bitwiseXOR(F.col(two)[i])) for i in range(SKETCH_LONGS)]
    return reduce(lambda x, y: x + y, bits)


def _may_link(percent: int) -> Column:
    """What two profiles allow: set sizes close enough, odd sketches too."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & (_distance("odd_a", "odd_b") <= popcount_bound(percent))


def _near(profiles: DataFrame, percent: int):
    """Restricts pairs (a, b) to those that may link, with their distance."""

    def near(pairs: DataFrame) -> DataFrame:
        one = pairs.join(profiles.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("odd").alias("odd_a")), "a")
        both = one.join(profiles.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("odd").alias("odd_b")), "b")
        return both.where(_may_link(percent)).select("a", "b", _distance("odd_a", "odd_b").alias("distance"))

    return near


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (bucket, class_id, component) of the buckets that hold several components."""
    placed = members.select("bucket", "class_id").join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    placed = cut(placed.withColumn("component", F.coalesce("component", "class_id")))
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(several, "bucket", "left_semi")


def _shingles(words: int):
    def run(batches):
        for step in unpacked(batches):
            sets = shingle_sets(*raw_text(step.column("text")), words)
            size = np.array([len(s) for s in sets])
            row = pa.array(np.repeat(np.arange(len(sets)), size))
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            ids, groups = step.column("class_id").take(row), step.column("component").take(row)
            yield pa.RecordBatch.from_arrays([ids, groups, pa.array(np.repeat(size, size)), pa.array(signed(flat))], ["class_id", "component", "n", "shingle"])

    return run


def _sharing_prefixes(texts: DataFrame, apart: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a > b) across components that the prefix and position filters leave.

    Sets of n and m shingles that are similar enough share at least
    o = percent * (n + m) / (100 + percent) of them.  In an order by frequency,
    the first one that they share has o - 1 others behind it in both.
    Shingles of a single class come first; they are counted, not joined.
    """
    rows = texts.join(apart.withColumnRenamed("class_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("class_id"), "component", "text")
    shingles = cut(rows.mapInArrow(_shingles(words), "class_id long, component long, n long, shingle long"))
    common = cut(shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    ranked = shingles.join(common, "shingle").groupBy("class_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("list"))
    own = F.col("n") - F.size("list")
    prefix = F.floor(F.col("n") * (100 - percent) / 100) + 1 - own
    early = ranked.where(prefix > 0).select("class_id", "component", "n", own.alias("own"), F.posexplode(F.slice("list", F.lit(1), prefix.cast("int"))).alias("i", "s"))
    early = cut(early.select("class_id", "component", "n", (F.col("own") + F.col("i")).alias("place"), "s.shingle"))
    one = early.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("class_id", "component", "n", "place")])
    two = early.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("class_id", "component", "n", "place")])
    least = percent * (F.col("n_a") + F.col("n_b"))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    similar = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * left >= least)
    met = one.join(two, "shingle").where((F.col("class_id_a") > F.col("class_id_b")) & (F.col("component_a") != F.col("component_b")) & similar)
    return met.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).distinct()


def _confirm(words: int, percent: int):
    def run(batches):
        for step in unpacked(batches, "text_a", "text_b"):
            a = shingle_sets(*raw_text(step.column("text_a")), words)
            seen: dict = {}
            keep = []
            texts = step.column("text_b")
            for i, b_id in enumerate(step.column("b").to_pylist()):
                if b_id not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[b_id] = shingle_sets(*raw_text(texts.slice(i, 1)), words)[0]
                both = len(np.intersect1d(a[i], seen[b_id], assume_unique=True))
                if 100 * both >= percent * (len(a[i]) + len(seen[b_id]) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([step.column("a").take(rows), step.column("b").take(rows)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Components of texts whose shingle sets have a Jaccard index of ``percent`` or more.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored.
    A-Z count as a-z, words are runs without ASCII white space, a shingle is
    ``words`` consecutive words (the whole text where it has fewer).  Result
    per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links) and kept (doc_id = component_id).

    Null and wordless texts have no shingles and no links, so they are kept.
    A row with a null doc_id takes no part: its component is null and it is
    kept.  Rows that repeat a doc_id are one node, linked by any of their
    texts.  An empty table gives an empty result.
    """
    if bands * rows > SAMPLES:
        raise ValueError(f"bands * rows is at most {SAMPLES}")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>"
    signs = cut(base.mapInArrow(_signatures(words, bands, rows), schema))

    same = ["set_a", "set_b", "n_shingles"]
    named = signs.where("n_shingles > 0 and doc_id is not null")
    classes = cut(named.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    buckets = classes.select("class_id", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("class_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(buckets.join(hubs, "bucket"))
    involved = members.select(F.col("class_id").alias("doc_id")).distinct()
    texts = cut(packed_text(base).join(involved, "doc_id", "left_semi"))
    profiles = cut(classes.select("class_id", "n_shingles", "odd").join(involved.withColumnRenamed("doc_id", "class_id"), "class_id", "left_semi"))
    near = _near(profiles, percent)

    stars = members.where("class_id > hub").select(F.col("class_id").alias("a"), F.col("hub").alias("b")).distinct()
    tried = cut(near(stars).select("a", "b"))
    links = cut(_confirmed(tried, texts, words, percent))
    for turn in range(ROUNDS):
        apart = _apart(members, components(links))
        pick = [F.min(F.when(F.pmod(F.xxhash64("class_id", F.lit(turn)), F.lit(2)) == i, F.struct(F.xxhash64("class_id", "bucket", F.lit(turn)).alias("order"), "class_id", "component"))) for i in (0, 1)]
        hubs = apart.groupBy("bucket").agg(F.array_compact(F.array(*pick)).alias("hubs")).select("bucket", F.explode("hubs").alias("hub"))
        met = apart.join(hubs, "bucket").where("component <> hub.component").select(F.col("class_id").alias("a"), F.col("hub.class_id").alias("b")).distinct()
        best = near(met.join(tried, ["a", "b"], "left_anti")).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
        best = cut(best)
        if best.isEmpty():
            break
        tried = tried.unionAll(best)
        links = cut(links.unionAll(_confirmed(best, texts, words, percent)))

    apart = cut(_apart(members, components(links)).select("class_id", "component").distinct())
    met = cut(_sharing_prefixes(texts, apart, words, percent))
    links = links.unionAll(_confirmed(near(met.join(tried, ["a", "b"], "left_anti")).select("a", "b"), texts, words, percent))

    doubled = named.join(classes.select(*same, "class_id"), same).where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    found = components(links.unionAll(doubled))
    out = signs.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
