"""Exact removal of repeated word windows behind a count-min prefilter.

A window is ``size`` consecutive words.  Its cell in the sketch is the hash of
its minimizer: the smallest-hashed ``gram``-word run inside it, leftmost on
ties.  Equal windows have equal minimizers at equal offsets, so a cell's count
never falls below the count of any window mapped to it, and a run of
neighbouring windows with one minimizer costs one increment instead of one per
window.  Sketches are kept sparse (cell, count), summed inside each partition
first and merged by one shuffle; they grow with the data and are never sent to
the driver.

The second pass takes only the runs whose cell is estimated at two or more in
every sketch row, and groups exactly: whole runs first (copies of a text share
them), then, only where a minimizer has several different runs, the single
windows.  Words are told apart by 64-bit hashes, and a window by two 64-bit
hashes of these.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, mix, packed_text, powers, raw_text, rolling, signed, steps, unpacked, word_hashes

_BASE_A, _BASE_B, _BASE_C = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_SALT = np.uint64(0x8EBC6AF09C88C6E3)
#: Sketch rows and the bits of a cell number in each.
CELL_BITS = 44


def _minimizer_runs(h: np.ndarray, first: np.ndarray, size: int, gram: int):
    """Runs of windows with one minimizer: (row, start word in the row, windows, minimizer hash, content hash)."""
    grams = mix(rolling(h, gram, _BASE_A))
    reach = size - gram + 1
    n = len(h) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    best, width = np.arange(len(grams)), 1
    while width < reach:
        hop = min(width, reach - width)
        left, right = best[:-hop], best[hop:]
        best = np.where(grams[left] <= grams[right], left, right)
        width += hop
    best = best[:n]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    fits = np.arange(n) + size <= first[row + 1]
    fresh = fits.copy()
    fresh[1:] &= (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    where = np.flatnonzero(fresh)
    total = np.cumsum(fits)
    count = np.diff(np.append(total[where] - 1, total[-1] if n else 0))
    base = np.uint64(_BASE_C)
    forward = powers(base, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * forward[:-1], out=sums[1:])
    backward = powers(np.uint64(pow(_BASE_C, -1, 2**64)), len(h) + 1)
    content = (sums[where + count - 1 + size] - sums[where]) * backward[where]
    content = mix(content ^ mix((best[where] - where).astype(np.uint64) * _SALT + count.astype(np.uint64)))
    return row[where], where - first[row[where]], count, grams[best[where]], content


def _runs(size: int, gram: int):
    def run(batches):
        for step in steps(batches):
            h, first = word_hashes(*raw_text(step.column("text")))
            row, start, count, cell, content = _minimizer_runs(h, first, size, gram)
            tag = step.column("tag").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id").take(pa.array(row)), pa.array(signed(cell)), pa.array(signed(content)), pa.array(tag << 40 | start << 8 | count)],
                ["doc_id", "cell", "content", "place"],
            )

    return run


def _partition_sketch(size: int, gram: int):
    def run(batches):
        held, n = [], 0

        def flush():
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            mask = np.uint64((1 << CELL_BITS) - 1)
            rows = [(cells >> np.uint64(64 - CELL_BITS)) << np.uint64(1), (cells & mask) << np.uint64(1) | np.uint64(1)]
            return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(rows))), pa.array(np.concatenate([counts, counts]))], ["slot", "n"])

        for step in steps(batches):
            h, first = word_hashes(*raw_text(step.column("text")))
            held.append(_minimizer_runs(h, first, size, gram)[3])
            n += len(held[-1])
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _slot(row: int):
    """The sketch slot of a run's minimizer, as the partition sketches number it."""
    part = F.shiftrightunsigned("cell", 64 - CELL_BITS) if row == 0 else F.col("cell").bitwiseAND((1 << CELL_BITS) - 1)
    return F.shiftleft(part, 1) + row


def _windows(size: int):
    """Keys of the windows named by ``places``: two 64-bit hashes of their words' hashes."""

    def run(batches):
        for step in unpacked(batches):
            h, first = word_hashes(*raw_text(step.column("text")))
            one = signed(mix(rolling(h, size, _BASE_A)))
            two = signed(mix(rolling(mix(h ^ _SALT), size, _BASE_B)))
            lists = step.column("places")
            row = np.repeat(np.arange(step.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            place = lists.flatten().to_numpy()
            count = place & 0xFF
            start = place >> 8 & 0xFFFFFFFF
            row = np.repeat(row, count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(start, count) + nth
            at = first[row] + start
            tag = step.column("tag").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id").take(pa.array(row)), pa.array(one[at]), pa.array(two[at]), pa.array(tag << 40 | start << 8 | 1)],
                ["doc_id", "k1", "k2", "place"],
            )

    return run


def _without(size: int, keep_text: bool):
    def run(batches):
        for step in unpacked(batches):
            data, bounds = raw_text(step.column("text"))
            whole = data.tobytes()
            names, total, gone, texts, digests = step.column("spans").to_pylist(), [], [], [], []
            for r, spans in enumerate(names):
                words = whole[bounds[r] : bounds[r + 1]].split()
                total.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    place = np.asarray(spans)
                    start = place >> 8 & 0xFFFFFFFF
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + (place & 0xFF) + size - 1, -1)
                    words = list(compress(words, np.cumsum(edge)[:-1] == 0))
                kept = b" ".join(words)
                gone.append(total[-1] - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode())
            new = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if keep_text:
                new.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), *new], ["doc_id", *names])

    return run


def remove_repeated_windows(docs: DataFrame, size: int = 50, gram: int = 8, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window that a smaller doc_id also has.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored,
    whatever their names.  Result per input row: doc_id, n_words, n_removed,
    kept_sha256 and (``keep_text``) kept_text, the kept words joined by one
    space.

    Null text counts as empty.  A row with a null doc_id neither loses words
    nor makes others lose any.  Rows with one doc_id do not remove each other's
    words; each such row is judged by its own text (they are told apart by 24
    bits of its hash).  Texts under ``size`` words
    have no window.  An empty table gives an empty result.
    """
    if not 1 < gram <= size or size > 128:
        raise ValueError("1 < gram <= size <= 128 is needed")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFFFF))
    named = base.where("doc_id is not null")  # below, sets of places do not grow with rows that repeat
    packed = packed_text(base)

    sketches = named.mapInArrow(_partition_sketch(size, gram), "slot long, n long")
    busy = cut(sketches.groupBy("slot").agg(F.sum("n").alias("n")).where("n >= 2").select("slot"))
    runs = named.mapInArrow(_runs(size, gram), "doc_id long, cell long, content long, place long")
    for row in (0, 1):
        runs = runs.withColumn("slot", _slot(row)).join(busy.where(F.col("slot").bitwiseAND(1) == row), "slot", "left_semi").drop("slot")
    runs = cut(runs)

    # written before they are joined back, so that a hot key's rows can be split
    least = cut(runs.groupBy("cell", "content").agg(F.min("doc_id").alias("least")))
    runs = cut(runs.join(least, ["cell", "content"]))
    spans = runs.where("doc_id > least").select("doc_id", "place")

    firsts = runs.where("doc_id = least")
    varied = cut(firsts.groupBy("cell").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("cell"))
    tag = F.shiftrightunsigned("place", 40).alias("tag")
    places = firsts.join(varied, "cell", "left_semi").groupBy("doc_id", tag).agg(F.collect_set("place").alias("places"))
    windows = cut(packed.join(places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places").mapInArrow(_windows(size), "doc_id long, k1 long, k2 long, place long"))
    least = cut(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    spans = spans.unionAll(windows.join(least, ["k1", "k2"]).where("doc_id > least").select("doc_id", "place"))

    spans = spans.groupBy("doc_id", tag).agg(F.collect_set("place").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return packed.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_without(size, keep_text), schema)
