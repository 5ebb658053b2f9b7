"""Identities handed over from frame to frame on a stream of boxes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CORNERS = ("x1", "y1", "x2", "y2")
#: A box of a packed frame, one that waits, and a track with its last box; ``source`` is a number of a list of names.
_BOX = np.dtype([("ms", "<i8"), ("box", "<i8"), *((c, "<f8") for c in _CORNERS)])
_WAITING = np.dtype([("source", "<i8"), *_BOX.descr])
_TRACK = np.dtype([*_WAITING.descr, ("since", "<i8"), ("first", "<i8")])
_STATE = "sources array<string>, rows binary"
_FRAMES = "source string, ts timestamp, boxes binary"
OUTPUT = "source string, ts timestamp, box long, since timestamp, first_box long"
_ROW = "source string, ms long, box long, since_ms long, first_box long"
#: Boxes in a chunk of waiting frames.
CHUNK = 50_000
#: Pairs of tracks and boxes that are compared at once.
AT_ONCE = 1_000_000
#: Rounds in which pairs are taken in arrays before the rest, a long chain of overlaps, is taken pair by pair.
ROUNDS = 20


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in the store that map states and timers need.

    Every micro-batch commits every partition's store, with or without rows, so
    a stream gets at most three partitions a core (24 on few cores), or as many
    as the session names, if these are fewer.
    """
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_PARTITIONS, min(int(before[_PARTITIONS]), max(24, 3 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def overlap(a, b):
    """Intersection over union of two (x1, y1, x2, y2), numbers or arrays."""
    wide, high = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    inter = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)[()]


def _pairs(tracks: np.ndarray, boxes: np.ndarray, threshold: float):
    """Track, box and overlap of all pairs of one source from the threshold on; both are sorted by source."""
    begin, end = (np.searchsorted(boxes["source"], tracks["source"], side) for side in ("left", "right"))
    upto, start, found = np.cumsum(end - begin), 0, []
    while start < len(tracks):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
        each = (end - begin)[start:stop]
        t = np.repeat(np.arange(start, stop), each)
        b = np.arange(len(t)) + np.repeat(begin[start:stop] - (np.cumsum(each) - each), each)
        values = overlap([tracks[c][t] for c in _CORNERS], [boxes[c][b] for c in _CORNERS])
        near = (values >= threshold) & (values > 0)
        found.append((t[near], b[near], values[near]))
        start = stop
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3


def matched(tracks: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Place of the track that each box takes over, by falling overlap, one to one; -1 without one.

    Both hold many sources, in order, and a box only meets tracks of its own.
    Equal overlaps go by the track's last time and box, then by the box.  A pair
    that comes first for its track and for its box is taken whatever the others
    are, so all such pairs are taken at once.
    """
    t, b, values = _pairs(tracks, boxes, threshold)
    order = np.lexsort((b, t, boxes["box"][b], tracks["box"][t], tracks["ms"][t], -values))
    t, b = t[order], b[order]
    out, free = np.full(len(boxes), -1), np.ones(len(tracks), bool)
    first_t, first_b = np.empty(len(tracks), np.int64), np.empty(len(boxes), np.int64)
    for _ in range(ROUNDS):
        if not len(t):
            return out
        places = np.arange(len(t))
        first_t[t[::-1]] = first_b[b[::-1]] = places[::-1]  # the last one written is the first pair
        take = (first_t[t] == places) & (first_b[b] == places)
        out[b[take]], free[t[take]] = t[take], False
        left = free[t] & (out[b] < 0)
        t, b = t[left], b[left]
    for i, j in zip(t.tolist(), b.tolist(), strict=True):
        if free[i] and out[j] < 0:
            out[j], free[i] = i, False
    return out


def followed(live: np.ndarray, boxes: np.ndarray, threshold: float, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Live tracks after frames of many sources, and the track that each box then is.

    The first frames of all sources are worked off at once, then the second
    ones, and so on, so that steps grow with frames of a source, not with
    sources.
    """
    boxes = boxes[np.lexsort((boxes["box"], boxes["ms"], boxes["source"]))]
    other, later, next_box = (np.diff(boxes[c], prepend=boxes[c][:1] - 1) != 0 for c in ("source", "ms", "box"))
    if not (other | later | next_box).all():  # boxes that are not told apart go by their corners, whatever came first
        boxes = boxes[np.lexsort((*(boxes[c] for c in reversed(_CORNERS)), boxes["box"], boxes["ms"], boxes["source"]))]
    frame = np.cumsum(other | later)
    step = frame - np.repeat(frame[other], np.diff(np.flatnonzero(other), append=len(boxes)))
    boxes = boxes[np.argsort(step, kind="stable")]
    live, done = live[np.argsort(live["source"], kind="stable")], []
    for now in np.split(boxes, np.cumsum(np.bincount(step))[:-1]):
        place = np.searchsorted(now["source"], live["source"])
        same = now[np.minimum(place, len(now) - 1)]
        live = live[(same["source"] != live["source"]) | (live["ms"] + hold >= same["ms"])]
        over = matched(live, now, threshold)
        fresh = np.empty(len(now), _TRACK)
        for c in _WAITING.names:
            fresh[c] = now[c]
        fresh["since"], fresh["first"] = now["ms"], now["box"]
        goes_on = over >= 0
        for c in ("since", "first"):
            fresh[c][goes_on] = live[c][over[goes_on]]
        live = np.concatenate([np.delete(live, over[goes_on]), fresh])
        live = live[np.argsort(live["source"], kind="stable")]
        done.append(fresh)
    return live, np.concatenate(done)


class _Names:
    """Numbers of source names."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def of(self, names) -> np.ndarray:
        return np.array([self.numbers.setdefault(n, len(self.numbers)) for n in names], np.int64)

    def loaded(self, state: tuple | None, kind: np.dtype) -> np.ndarray:
        if state is None:
            return np.empty(0, kind)
        rows = np.frombuffer(bytes(state[1]), kind).copy()
        rows["source"] = self.of(state[0])[rows["source"]]
        return rows

    def state(self, rows: np.ndarray) -> tuple[list[str], bytes]:
        used, rows = np.unique(rows["source"]), rows.copy()
        rows["source"] = np.searchsorted(used, rows["source"])
        names = list(self.numbers)
        return [names[u] for u in used.tolist()], rows.tobytes()


class HandOver(StatefulProcessor):
    """State of one or more sources: frames that wait for the watermark, and the live tracks with their last box.

    Waiting boxes lie in chunks, sorted by time.  A timer works off all frames
    that the watermark has passed, from chunk to chunk, so that frames come in
    order whatever order their boxes came in, and memory is bounded by a few
    chunks, the largest frame and the live tracks.  What the watermark has not
    reached waits on.  A second timer lets tracks go that no box has taken over
    for ``hold``.  State is bounded by the boxes within the watermark's delay
    and within ``hold``; it is kept as bytes, which calls of the state pass on
    without looking at each box.
    """

    def __init__(self, threshold: float, hold_ms: int):
        self.threshold, self.hold_ms = threshold, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, part string", _STATE)
        self.tracks = handle.getValueState("tracks", _STATE)

    def _wait(self, names: _Names, boxes: np.ndarray) -> None:
        """Keep boxes in chunks."""
        boxes = boxes[np.argsort(boxes["ms"], kind="stable")]
        for start in range(0, len(boxes), CHUNK):
            chunk = boxes[start : start + CHUNK]
            self.waiting.updateValue((int(chunk["ms"][0]), uuid.uuid4().hex), names.state(chunk))
        if len(boxes):
            self.handle.registerTimer(int(boxes["ms"][0]))

    def _due(self, names: _Names, passed: int) -> Iterator[np.ndarray]:
        """Take out the boxes of all frames up to a time, in pieces of whole frames, in order."""
        keys = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= passed)
        held = np.empty(0, _WAITING)
        for key, following in zip(keys, [*keys[1:], (passed + 1,)]):
            held = np.concatenate([held, names.loaded(self.waiting.getValue(key), _WAITING)])
            self.waiting.removeKey(key)
            if len(held) >= CHUNK or following[0] > passed:
                ready = held["ms"] < following[0]  # no chunk to come has boxes of these frames
                if ready.any():
                    yield held[ready]
                held = held[~ready]
        self._wait(names, held)

    def _worked_off(self, passed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Names and tracks of the boxes of all frames that the watermark has passed."""
        names, before = _Names(), self.tracks.get()
        live, moved = names.loaded(before, _TRACK), False
        for boxes in self._due(names, passed):
            live, done = followed(live, boxes, self.threshold, self.hold_ms)
            moved = True
            yield np.array(list(names.numbers), object)[done["source"]], done
        live = live[live["ms"] + self.hold_ms > passed]  # frames to come are later than passed
        if not len(live):
            if before:
                self.tracks.clear()
        elif moved:
            self.tracks.update(names.state(live))
            self.handle.registerTimer(int(live["ms"].max()) + self.hold_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # (source, ts, ms, box, corners); without a box a heartbeat, which only moves the watermark
        names, boxes = _Names(), [tuple(r) for r in rows if r[3] is not None]
        sources = names.of(b[0] for b in boxes)
        self._wait(names, np.array([(int(s), *b[2:]) for s, b in zip(sources, boxes, strict=True)], _WAITING))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for sources, done in self._worked_off(timerValues.getCurrentWatermarkInMs()):
            for source, *values in zip(sources, *(done[c].tolist() for c in ("ms", "box", "since", "first")), strict=True):
                yield Row(**dict(zip(("source", "ms", "box", "since_ms", "first_box"), (source, *values), strict=True)))


class HandOverFrames(HandOver):
    """The same for packed frames of many sources, and with results in data frames."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frames in rows:
            frames = frames[[len(b) > 0 for b in frames["boxes"]]]  # without a box a heartbeat
            names, packed = _Names(), np.frombuffer(b"".join(frames["boxes"]), _BOX)
            each = [len(b) // _BOX.itemsize for b in frames["boxes"]]
            boxes = np.empty(len(packed), _WAITING)
            boxes["source"] = np.repeat(names.of(frames["source"]), each)
            for c in _BOX.names:
                boxes[c] = packed[c]
            self._wait(names, boxes)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for sources, done in self._worked_off(timerValues.getCurrentWatermarkInMs()):
            yield pd.DataFrame({"source": sources, "ms": done["ms"], "box": done["box"], "since_ms": done["since"], "first_box": done["first"]})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of one source and time, as far as they lie in a batch, in one row of bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column("source").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        micros = batch.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
        there = batch.column("box").is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((micros, source))
        begins = np.flatnonzero((np.diff(source[order], prepend=-1) != 0) | (np.diff(micros[order], prepend=0) != 0))
        kept = order[there[order]]
        boxes = np.empty(len(kept), _BOX)
        boxes["ms"], boxes["box"] = micros[kept] // 1_000, batch.column("box").fill_null(0).to_numpy(zero_copy_only=False)[kept]
        for c in _CORNERS:
            boxes[c] = batch.column(c).to_numpy(zero_copy_only=False)[kept]
        upto = np.concatenate([[0], np.cumsum(there[order])])[[*begins, len(order)]] * _BOX.itemsize
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(boxes.tobytes())])
        firsts = batch.select(["source", "ts"]).take(pa.array(order[begins]))
        yield pa.RecordBatch.from_arrays([*firsts.columns, packed.cast(pa.binary())], names=[*firsts.schema.names, "boxes"])


def tracked(boxes: DataFrame, threshold: float = 0.5, hold: int = 0, late: str = "0 seconds", lanes: int = 512) -> DataFrame:
    """Boxes of a stream with the identity that they take over: ``OUTPUT``.

    ``boxes`` has source (string), ts (timestamp of the frame), box (long, told
    apart within a frame) and x1, y1, x2, y2.  A box takes over the track whose
    last box it overlaps most, by falling overlap and one to one, from
    ``threshold`` on; else it begins a track of its own.  A track is named by
    the time and box it began with.  Tracks that no box took over stay on for
    ``hold`` milliseconds after their last box.

    A frame comes out when the watermark, ``late`` behind the latest time, has
    passed it; boxes later than that are dropped.  Rows without a box are
    heartbeats: they move the watermark and give nothing.  Start the stream
    within :func:`state_store`.

    Sources are dealt into ``lanes`` by their hash; a lane's sources share a
    state and are worked off in the same arrays, so that calls and their cost
    grow with lanes.  Frames travel to the state packed, a row each.
    """
    rows = boxes.where("source is not null and ts is not null")
    corners = [F.col(c).cast("double").alias(c) for c in _CORNERS]
    rows = rows.select("source", F.col("ts").cast("timestamp").alias("ts"), F.col("box").cast("long").alias("box"), *corners)
    lane = F.pmod(F.xxhash64("source"), F.lit(lanes)).cast("int").alias("lane")
    frames = rows.mapInArrow(_packed, _FRAMES).select(lane, "*").withWatermark("ts", late)
    out = frames.groupBy("lane").transformWithStateInPandas(HandOverFrames(threshold, hold), _ROW, "Append", "EventTime")
    return out.select("source", F.timestamp_millis("ms").alias("ts"), "box", F.timestamp_millis("since_ms").alias("since"), "first_box")
