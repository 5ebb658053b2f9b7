"""Exact top-k inner products by distributed histogram selection.

Vectors become integers and are packed in blocks.  Every query block meets
every candidate block; each round scores everything and counts, per query,
the scores in a grid of bins over the interval known to hold the kth highest
score.  Merged counts pick the one bin that holds it, which is the next
round's interval, until bins are one score wide and the kth value is known.
A last scoring keeps what lies above it, and ties at it in order of id.

A block of candidates sends only the bins of its own k highest scores: a lower
score cannot be among the k highest of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut

#: The largest score; none is below its negative.
TOP = 2**63 - 1
_MOST = 1.7976931348623157e308


def _pack(rows: int, numbers: tuple[str, ...]):
    """Rows as blocks of at most ``rows``: each of ``numbers`` as one binary, the vectors as a zero-padded matrix."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("vector")
                size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                dense = np.zeros((part.num_rows, int(size.max())))
                nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                dense[np.repeat(np.arange(len(size)), size), nth] = lists.flatten().to_numpy()
                narrow = np.abs(dense).max(initial=0) < 2**24  # float32 holds these integers
                dense = dense.astype(np.float32 if narrow else np.float64)
                columns = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in numbers]
                yield pa.RecordBatch.from_arrays([*(pa.array([c]) for c in columns), pa.array([dense.tobytes()]), pa.array([bool(narrow)])], [*numbers, "vectors", "narrow"])

    return run


def _matrix(blob: bytes, narrow: bool, rows: int) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if narrow else np.float64).reshape(rows, -1).astype(np.float64)


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and integer scores of two blocks; a query's own row is far below all."""
    q_ids, c_ids = np.frombuffer(row["q_id"], np.int64), np.frombuffer(row["id"], np.int64)
    q, c = _matrix(row["q_vectors"], row["q_narrow"], len(q_ids)), _matrix(row["vectors"], row["narrow"], len(c_ids))
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dim
    return q_ids, c_ids, (q @ c.T).astype(np.int64) if bound < 2**52 else _large(q, c)


def _large(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products beyond what doubles add exactly, held at the ends of the long range.

    Sums modulo 2**64 are exact where the true score fits a long.  Whether it
    does, doubles tell but for a margin of rounding, and there whole numbers do.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        near, size = q @ c.T, np.abs(q) @ np.abs(c).T
        margin = size * (q.shape[1] + 2) * 2.0**-52
        s = (_wrapped(q) @ _wrapped(c).T).view(np.int64)
        outside = np.abs(near) - margin > 2.0**63
        s[outside] = np.where(near[outside] > 0, TOP, -TOP)
        unsure = ~outside & ~(np.abs(near) + margin < TOP)
    for i, j in zip(*np.nonzero(unsure)):
        s[i, j] = max(-TOP, min(TOP, sum(int(a) * int(b) for a, b in zip(q[i], c[j]))))
    return s


def _wrapped(x: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64."""
    low = np.fmod(x, 2.0**64)
    return np.where(low < 0, np.uint64(0) - np.abs(low).astype(np.uint64), np.abs(low).astype(np.uint64))


def _rank(s: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order, whose differences do not overflow."""
    return s.view(np.uint64) + np.uint64(2**63)


def _count(k: int, bins: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, s = _scores(row)
                low = np.frombuffer(row["low"], np.int64)
                width = np.frombuffer(row["width"], np.int64)
                masked = np.where(q_ids[:, None] == c_ids[None, :], np.iinfo(np.int64).min, s)
                n = min(k, masked.shape[1])
                best = np.partition(masked, masked.shape[1] - n, axis=1)[:, masked.shape[1] - n :]
                real = best > np.iinfo(np.int64).min
                at, ends = _rank(np.ascontiguousarray(best)), _rank(low)[:, None]
                slot = np.where(at < ends, -1, np.minimum((at - ends) // width.astype(np.uint64)[:, None], np.uint64(bins)).astype(np.int64))
                q = np.repeat(np.arange(len(q_ids)), n)[real.ravel()]
                keys, counts = np.unique(q * (bins + 2) + slot.ravel()[real.ravel()] + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[keys // (bins + 2)]), pa.array((keys % (bins + 2) - 1).astype(np.int64)), pa.array(counts.astype(np.int64))], ["query_id", "bin", "n"]
                )

    return run


def _select(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, s = _scores(row)
                kth = np.frombuffer(row["low"], np.int64)
                order = np.argsort(c_ids, kind="stable")
                c_ids, s = c_ids[order], s[:, order]
                others = q_ids[:, None] != c_ids[None, :]
                above = others & (s > kth[:, None])
                tied = others & (s == kth[:, None])
                tied &= np.cumsum(tied, axis=1) <= k
                q, c = np.nonzero(above | tied)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(c_ids[c]), pa.array(s[q, c])], ["query_id", "vec_id", "score"])

    return run


def _query_blocks(states: DataFrame, blocks: int, rows: int) -> DataFrame:
    """Query blocks with each query's interval: its low end and bin width."""
    packed = states.repartition(blocks).mapInArrow(_pack(rows, ("id", "low", "width")), "id binary, low binary, width binary, vectors binary, narrow boolean")
    return packed.withColumnsRenamed({"id": "q_id", "vectors": "q_vectors", "narrow": "q_narrow"})


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, bins: int = 4096, query_rows: int = 1024, block_rows: int = 8192) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows.

    ``vectors`` needs ``vec_id`` (integer) and ``embedding`` (array of numbers);
    ``is_query`` is a condition on it.  Components x become floor(scale * x).
    Result: query_id, rank from 1, vec_id, score; ties go to the smaller
    vec_id; all candidates where fewer than k exist.

    A vector that is null, holds a null or a non-finite component, or has a
    null vec_id takes no part.  Empty vectors score 0; vectors of unlike
    lengths are compared over the shorter one.  Rows that repeat a vec_id are
    candidates each on its own, but never for a query of the same id; they ask
    once, with the least of their vectors in array order.  Scores beyond the
    long range count as its ends (``TOP`` and ``-TOP``), and scaled components
    beyond the largest double as that.  Other columns are ignored; empty
    tables, and tables without a query, give an empty result.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(F.greatest(F.least(v, F.lit(_MOST)), F.lit(-_MOST)))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("id"), is_query.alias("asks"), F.concat(F.transform(x, lambda v: whole(v * scale)), F.array(F.lit(0.0))).alias("vector")
    )
    blocks = cut(rows.select("id", "vector").mapInArrow(_pack(block_rows, ("id",)), "id binary, vectors binary, narrow boolean"))
    norm = rows.select(F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)).alias("n")).first()["n"]
    top = int(min((norm or 0.0) * (1 + 1e-9) + 1, float(TOP)))  # no score is larger, by Cauchy and Schwarz
    top = min(top, TOP)
    width = -(-(2 * top + 1) // bins)
    asked = cut(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")))
    groups = asked.count() // query_rows + 1
    states = asked.withColumns({"low": F.lit(-top).cast("long"), "width": F.lit(width).cast("long")})
    while True:
        met = _query_blocks(states, groups, query_rows).crossJoin(blocks)
        counts = met.mapInArrow(_count(k, bins), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        running = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("bin")))
        held = counts.withColumn("reached", running).groupBy("query_id").agg(F.max(F.when(F.col("reached") >= k, F.col("bin"))).alias("bin"), F.min("bin").alias("last"))
        held = held.select(F.col("query_id").alias("id"), F.coalesce("bin", "last").alias("bin"))
        narrower = -(-width // bins)
        states = cut(states.join(held, "id").select("id", "vector", (F.col("low").cast("decimal(20,0)") + F.col("bin") * F.col("width").cast("decimal(20,0)")).cast("long").alias("low"), F.lit(narrower).cast("long").alias("width")))
        if width == 1:
            break
        width = narrower
    met = _query_blocks(states, groups, query_rows).crossJoin(blocks)
    found = met.mapInArrow(_select(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
