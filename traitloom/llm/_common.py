"""Shared helpers: lineage cuts, Arrow text access, word hashing, components."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at a time.
STEP_BYTES = 1 << 21
#: Rows that it holds at most, so that short texts do not make wide steps.
STEP_ROWS = 4096

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names.

    ``spark.checkpoint.dir`` is used where it is set; a session without it gets
    a folder of its own in local mode, where driver and workers share a disk,
    and an error on a cluster.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they meet no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 0 in an order, by range partitions and their offsets (one small row each).

    The partitioned table is written first: both uses must see the same rows in
    the same partitions.
    """
    part, nth, rows, before = fresh(df, "part", "nth", "rows", "before")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id() % (1 << 33)}))
    ahead = F.sum(rows).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy(part).agg(F.count("*").alias(rows)).select(part, F.coalesce(ahead, F.lit(0)).alias(before))
    return ranged.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(nth)).drop(part, nth, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices(upto: np.ndarray, limit: int, rows: int):
    """Bounds (first, last) of slices of about ``limit``; ``upto`` has the running size, from 0."""
    first, n = 0, len(upto) - 1
    while first < n:
        last = int(np.searchsorted(upto, upto[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


def steps(batches, text: str = "text", limit: int = STEP_BYTES, rows: int = STEP_ROWS):
    """Slice Arrow batches so that a step holds about ``limit`` bytes of ``text`` and at most ``rows`` rows.

    Nulls in the text column become empty strings; a single text longer than
    the limit makes a step of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        index = batch.schema.get_field_index(text)
        column = batch.column(index)
        if column.null_count:
            batch = batch.set_column(index, text, column.fill_null(""))
            column = batch.column(index)
        for first, last in _slices(_offsets(column), limit, rows):
            yield batch.slice(first, last - first)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    all_offsets = np.frombuffer(column.buffers()[1], dtype=kind)
    return all_offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and each row's bounds in it."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def packed_text(df: DataFrame) -> DataFrame:
    """``df`` with its string column ``text`` as one zstd frame per row, for cheaper shuffles."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for step in steps(batches):
            at = step.schema.get_field_index("text")
            frames = [pack.compress(t.encode()) for t in step.column(at).to_pylist()]
            yield step.set_column(at, "text", pa.array(frames, pa.binary()))

    return df.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else kind}" for c, kind in df.dtypes))


def unpacked(batches, *names: str, limit: int = STEP_BYTES >> 1, rows: int = STEP_ROWS):
    """The Arrow batches of a table shuffled as :func:`packed_text` with text restored.

    A step holds about ``limit`` bytes of restored text, as the frames' headers state.
    """
    names = names or ("text",)
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in names:
            sizes += np.array([zstandard.frame_content_size(b) for b in batch.column(batch.schema.get_field_index(name)).to_pylist()], np.int64)
        for first, last in _slices(np.append(0, np.cumsum(sizes)), limit, rows):
            step = batch.slice(first, last - first)
            for name in names:
                at = step.schema.get_field_index(name)
                step = step.set_column(at, name, pa.array([unpack.decompress(b).decode() for b in step.column(at).to_pylist()], pa.string()))
            yield step


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
    codes = codes * np.uint64(2) + np.uint64(1)
    codes[list(SPACES)] = 0
    if fold_case:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWER = np.uint64(0x9E3779B97F4A7C15)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray, fold_case: bool = False):
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.

    Returns (hashes, first): words of row r are hashes[first[r]:first[r + 1]].
    ``fold_case`` lower-cases A-Z before hashing.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    solid = ~space[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), first
    spans = np.diff(np.append(starts, n))
    place = np.arange(n - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], spans)
    coded = _byte_codes(fold_case)[data[starts[0] :]]
    coded *= powers(_POWER, int(spans.max()))[place]
    return mix(np.add.reduceat(coded, starts - starts[0])), first


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of every n consecutive values, by doubling."""
    base = np.uint64(base)
    if len(h) < n:
        return np.zeros(0, np.uint64)
    block, size, power = h, 1, base
    out, done = None, 0
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            if out is None:
                out, done = block, size
            else:  # this block goes in front of what is there
                keep = len(h) - (done + size) + 1
                out = block[:keep] * powers(base, done + 1)[done] + out[size : size + keep]
                done += size
        if n >> (bit + 1):
            keep = len(h) - 2 * size + 1
            block = block[:keep] * power + block[size : size + keep]
            size *= 2
            power = np.multiply(power, power, dtype=np.uint64)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``links(a long, b long)``.

    Alternates large-star and small-star rounds, each a pre-aggregated minimum
    joined back on the node, until every edge leads from a node without other
    edges to its smallest one.  The minima of the large star are written before
    they are joined, so that adaptive execution can split the edges of a hub
    (in the small star the hub is on the other side).  Nothing but one
    flag per round reaches the driver.  Returns (id, component); nodes without
    links are absent, links with a null end are left out.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
