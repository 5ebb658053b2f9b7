"""Aggregates, group functions, quantiles, hulls, clusters, tracks, retries and names against brute force, hot groups included."""

import datetime as dt
import itertools
import random
import threading
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from traitloom.functions import registered
from traitloom.operators import extension as E
from traitloom.operators import geometry as G
from traitloom.operators import linkage as L
from traitloom.operators import rulers as U
from traitloom.operators import sampling as S
from traitloom.operators.quantiles import exact_quantiles
from traitloom.sources import writers as K
from traitloom.streaming import retries, tracking


def test_hull_of_many_points_in_one_object(spark):
    n = 100_000
    points = spark.range(n, numPartitions=8).select(F.lit(1).alias("k"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    points = points.unionByName(spark.createDataFrame([(2, 0.0, 0.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 5.0, 5.0), (None, 0.0, 0.0), (None, 4.0, 0.0), (None, 0.0, 2.0), (4, None, 1.0)], "k int, x double, y double"))
    began = time.time()
    got = {r["k"]: r["convex_hull"] for r in G.convex_hulls(points, "k").collect()}
    assert time.time() - began < 60
    every = [(r["x"], r["y"]) for r in points.where("k = 1").collect()]
    hull = G.hull_of(every)
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):  # all points lie left of every edge
        xy = np.array(every)
        assert ((bx - ax) * (xy[:, 1] - ay) - (by - ay) * (xy[:, 0] - ax) >= -1e-6).all()
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1])) / 2
    assert got[1] == pytest.approx(area) and got[2] == got[3] == got[4] == 0 and got[None] == 4


def test_smallest_box_of_hull_vertices_equals_all_points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, float(x), float(y)) for i in range(6) for s, (x, y) in enumerate(rng.integers(0, 60, (40, 2)))]
    points = spark.createDataFrame(rows, "k int, seq int, x double, y double")
    got = {r["k"]: (r["long_side"], r["short_side"], r["angle"]) for r in G.smallest_box(points, "k", G.polygon_measures(points, "k")).collect()}
    for k in range(6):
        xy = np.array([r[2:] for r in rows if r[0] == k])
        cx, cy = (float(int((xy[:, c].sum() + xy[0, c]) / (len(xy) + 1))) for c in (0, 1))
        sides = []
        for g in range(181):
            a = np.radians(float(g))
            rx = np.trunc(cx + np.cos(a) * (xy[:, 0] - cx) - np.sin(a) * (xy[:, 1] - cy))
            ry = np.trunc(cy + np.sin(a) * (xy[:, 0] - cx) + np.cos(a) * (xy[:, 1] - cy))
            both = sorted((np.ptp(rx) + 1, np.ptp(ry) + 1))
            sides.append((both[1], -g, both[0]))
        best = max(sides)
        assert got[k] == (best[0], best[2], -best[1])


def test_a_hot_group_is_never_whole_in_one_task(spark):
    rows = spark.range(20_000, numPartitions=6).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k string, id long"))

    def seen(frame):
        return pd.DataFrame({"n": [len(frame)], "most": [len(frame)], "parts": [1], "total": [int(frame["id"].sum())]})

    def merged(parts):
        return pd.DataFrame({"n": [int(parts["n"].sum())], "most": [int(parts["most"].max())], "parts": [len(parts)], "total": [int(parts["total"].sum())]})

    got = {r["k"]: r for r in E.apply_in_parts(rows, ["k"], seen, merged, "n long, most long, parts int, total long", rows=1_000).collect()}
    assert (got["hot"]["n"], got["hot"]["total"]) == (10_000, sum(range(0, 20_000, 2))) and got["hot"]["parts"] == 10 and got["hot"]["most"] < 1_500
    assert got["k1"]["parts"] == 1 and got["k1"]["n"] == 400 and got[None]["n"] == 2
    assert E.apply_in_parts(rows.limit(0), ["k"], seen, merged, "n long, most long, parts int, total long").count() == 0


@pytest.mark.parametrize("together", [1_000_000, 5])
def test_quantiles_equal_numpy(spark, together):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(40)) if rng.random() > 0.1 else None) for _ in range(800)] + [("c", 7.0), ("d", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", {"low": 0.25, "mid": 0.5, "high": 0.95}, together)
    want = {}
    for k in ("a", "b", "c", None):
        v = [x for g, x in rows if g == k and x is not None]
        want[k] = tuple(np.quantile(v, [0.25, 0.5, 0.95]))
    assert {r["k"]: pytest.approx((r["low"], r["mid"], r["high"])) for r in got.collect()} == want


def test_positions_spread_a_hot_group(spark):
    rows = spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, 1).alias("k"), F.xxhash64("id").alias("o"), "id")
    got = L.positions_in_groups(rows, ["k"], ["o", "id"])
    for k in (1, None):
        assert sorted(r["position"] for r in got.where(F.col("k").eqNullSafe(k)).select("position").collect()) == list(range(1, rows.where(F.col("k").eqNullSafe(k)).count() + 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small enough for one partition otherwise
    ranged = L.in_ranges(rows, ["k", "o", "id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.where("k = 1").select("_part").distinct().count() > 1
    assert S.split_overflow(rows, ["k"], 10, "id").where("part = 'target'").count() == 20
    assert S.sample(rows, 0.5, "id").count() == 20_000


def test_file_names_stay_unique(spark):
    names = ["a b", "a-b", "a-b_1", "a.b", "a-b_2", "a-b_4", "a,b", "a-b", "x", None, "a-b_01", "é", "a-b_1", "_", "a b"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r["id"]: r["valid_name"] for r in L.unique_file_names(rows, "name", ["id"]).collect()}
    assert [got[i] for i in (1, 2, 4, 5)] == ["a-b", "a-b_1", "a-b_2", "a-b_4"]
    assert [got[i] for i in (7, 0, 3, 6, 14)] == [f"a-b_{n}" for n in (3, 5, 6, 7, 8)] and got[12] == "a-b_1_1"
    there = [v for i, v in got.items() if names[i] is not None]
    assert len(set(there)) == len(there) == 14 and got[9] is None


def test_prefix_lookup_by_brute_force(spark):
    rng = random.Random(1)
    ids = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    images, found = sorted(set(ids[:20])), ids[20:]
    got = L.id_lookup(spark.createDataFrame([(i,) for i in [*images, "", None]], "id string"), spark.createDataFrame([(i,) for i in [*found, None]], "id string"), prefix=True)
    assert sorted(map(tuple, got.collect())) == sorted((i, o) for i in images for o in found if o.startswith(i))


def test_clusters_by_trying_all_cuts(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.randrange(30)), 2 + g % 4) for g in range(8) for _ in range(12)] + [(9, 5.0, 3), (9, 5.0, 3), (9, None, 3), (10, 1.0, 4), (10, 2.0, 4)]
    got = U.k_clusters(spark.createDataFrame(rows, "g int, v double, k int"), "g", "v", "k").collect()
    assert [r["cluster"] for r in got if r["g"] == 9 and r["v"] is None] == [None] and {r["cluster"] for r in got if r["g"] == 10} == {0, 1}
    for g in range(8):
        mine = sorted((r["v"], r["cluster"], r["centre"], r["dominant"]) for r in got if r["g"] == g)
        values = [m[0] for m in mine]
        squares = lambda part: sum((x - sum(part) / len(part)) ** 2 for x in part)
        distinct = sorted(set(values))
        least = min(sum(squares([v for v in values if a <= v < b]) for a, b in zip((distinct[0], *cut), (*cut, 99.0))) for cut in itertools.combinations(distinct[1:], 1 + g % 4))
        parts = {c: [m[0] for m in mine if m[1] == c] for c in {m[1] for m in mine}}
        assert sum(map(squares, parts.values())) == pytest.approx(least) and len(parts) == 2 + g % 4
        assert all(m[2] == pytest.approx(sum(parts[m[1]]) / len(parts[m[1]])) for m in mine)
        assert len({m[1] for m in mine if m[3]}) == 1 and max(map(len, parts.values())) == sum(m[3] for m in mine)


def test_label_texts_as_a_table_function(spark):
    assert "parse_yolo" in registered.register(spark)
    text = "0 0.5 0.5 0.1 0.2 0.9\n\n1 0.5\nx 1 2 3 4\n2 1 2 3 nan\n  3  .1 .2 .3 .4  \n4 1 2 3 4 5 6"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("label_texts")
    got = spark.sql("SELECT id, y.line, y.cls, y.h, y.score, y.problem FROM label_texts, LATERAL parse_yolo(text) y").collect()
    assert {r["id"] for r in got} == {1}
    assert {r["line"]: (r["cls"], r["score"], r["problem"]) for r in got} == {0: (0, 0.9, None), 2: (None, None, "fields"), 3: (None, None, "number"), 4: (2, None, None), 5: (3, None, None), 6: (None, None, "fields")}


def walked(rows, threshold, hold):
    """Tracks frame by frame, source by source."""
    out = []
    for s in sorted({r[0] for r in rows}):
        live = []
        for ts in sorted({r[1] for r in rows if r[0] == s}):
            ms = int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
            live = [t for t in live if t[2] + hold >= ms]
            boxes = sorted(r[2:] for r in rows if r[0] == s and r[1] == ts)
            pairs = sorted((-tracking.overlap(t[4:], b[1:]), t[2], t[3], b[0], i, j) for i, t in enumerate(live) for j, b in enumerate(boxes))
            by_track, by_box = {}, {}
            for value, _, _, _, i, j in pairs:
                if -value >= threshold and value < 0 and i not in by_track and j not in by_box:
                    by_track[i], by_box[j] = j, i
            fresh = [((*live[by_box[j]][:2], ms, *b) if j in by_box else (ms, b[0], ms, *b)) for j, b in enumerate(boxes)]
            live = [t for i, t in enumerate(live) if i not in by_track] + fresh
            out += [(s, ms, f[3], f[0], f[1]) for f in fresh]
    return sorted(out)


@pytest.mark.parametrize("hold", [1_000, 3_000])
def test_streamed_tracks_equal_walking_all_frames(spark, tmp_path, hold):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    schema = "source string, ts timestamp, box long, x1 double, y1 double, x2 double, y2 double"
    rows = []
    for s in "ab":
        at = [(rng.randrange(100), rng.randrange(100)) for _ in range(5)]
        for f in range(12):
            if s == "a" or f not in (4, 5):
                rows += [(s, start + dt.timedelta(seconds=f), b, float(x), float(y), float(x + 20), float(y + 20)) for b, (x, y) in enumerate(at) if rng.random() < 0.8]
            at = [(x + rng.randrange(-6, 7), y + rng.randrange(-6, 7)) for x, y in at]
    ordered = sorted(rows, key=lambda r: r[1])
    for part in range(4):  # a frame may lie in two files
        spark.createDataFrame(ordered[len(rows) * part // 4 : len(rows) * (part + 1) // 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("", start + dt.timedelta(hours=1), None, None, None, None, None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with tracking.state_store(spark):
        stream = tracking.tracked(source, 0.3, hold, "2 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        stream.start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("source", F.unix_millis("ts"), "box", F.unix_millis("since"), "first_box")
    assert sorted(map(tuple, got.collect())) == walked(rows, 0.3, hold)


class Counted:
    """States and timers of one source in memory, which count their calls."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, {}, None, []

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "keys", "get", "exists", "update", "clear", "registerTimer"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, ms):
        self.timers.append(ms)

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_state_calls_of_tracks_do_not_grow_with_frames():
    class Times:
        def __init__(self, now):
            self.now = now

        def getExpiryTimeInMs(self):
            return self.now

        getCurrentWatermarkInMs = getExpiryTimeInMs

    state = Counted()
    processor = tracking.HandOver(0.3, 10)
    processor.init(state)
    rows = [Row(source="a", ts=None, ms=10 * f, box=b, x1=50.0 * b, y1=0.0, x2=50.0 * b + 20, y2=20.0) for f in range(1, 101) for b in (1, 0)]
    list(processor.handleInputRows(("a",), iter(rows), None))
    got, waits = [], []
    for passed in (505, 2_000):  # the watermark stops amid the frames
        for ms in sorted(t for t in state.timers if t <= passed):
            state.timers.remove(ms)
            times = Times(ms)
            times.getCurrentWatermarkInMs = lambda: passed
            got += [tuple(r) for r in processor.handleExpiredTimer(("a",), times, times)]
        waits.append((len(got), bool(state.rows)))
    assert got == [("a", 10 * f, b, 10, b) for f in range(1, 101) for b in (0, 1)]
    assert waits == [(100, True), (200, False)] and state.value is None
    assert state.calls < 40  # 100 frames


def test_many_sources_share_calls_of_one_state(monkeypatch):
    class Times:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    monkeypatch.setattr(tracking, "CHUNK", 300)  # many chunks, which overlap in time
    rng, start, hold = random.Random(11), dt.datetime(2024, 1, 1), 2_000
    rows = []
    for s in range(60):
        at = [(rng.randrange(60), rng.randrange(60)) for _ in range(4)]
        for f in range(20):
            if rng.random() < 0.8:
                rows += [(f"s{s}", start + dt.timedelta(seconds=f), b, float(x), float(y), float(x + 20), float(y + 20)) for b, (x, y) in enumerate(at) if rng.random() < 0.8]
            at = [(x + rng.randrange(-6, 7), y + rng.randrange(-6, 7)) for x, y in at]
    zero = int(start.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    state, got, waits = Counted(), [], []
    processor = tracking.HandOverFrames(0.3, hold)
    processor.init(state)
    names = ["source", "ts", "box", "x1", "y1", "x2", "y2"]
    for begin, end, passed in ((0, 10, 4_500), (10, 20, 14_500), (20, 20, 900_000)):  # frames of each micro-batch, and how far the watermark is
        batch = [r for r in rows if begin <= (r[1] - start).total_seconds() < end]
        rng.shuffle(batch)
        for part in (batch[::2], batch[1::2]):
            part = [*part, ("", start + dt.timedelta(hours=1), None, None, None, None, None)]  # a heartbeat
            table = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part], pa.schema([("source", pa.string()), ("ts", pa.timestamp("us")), ("box", pa.int64()), *((c, pa.float64()) for c in names[3:])]))
            packed = [p.to_pandas() for p in tracking._packed(iter([table]))]
            assert sum(map(len, packed)) == len({r[:2] for r in part})  # a row per source and time
            processor.handleInputRows((0,), iter(packed), None)
        for ms in sorted({t for t in state.timers if t <= zero + passed}):
            state.timers = [t for t in state.timers if t != ms]
            for frame in processor.handleExpiredTimer((0,), Times(zero + passed), None):
                got += [tuple(r) for r in frame[["source", "ms", "box", "since_ms", "first_box"]].itertuples(index=False)]
        waits.append((max(g[1] for g in got) - zero, bool(state.rows)))
    assert sorted(got) == walked(rows, 0.3, hold)
    assert waits == [(4_000, True), (14_000, True), (19_000, False)] and state.value is None
    assert state.calls < 150  # about 1,000 frames of 60 sources, 3,800 boxes


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_pairs_taken_at_once_equal_pair_by_pair(monkeypatch, rounds):
    monkeypatch.setattr(tracking, "ROUNDS", rounds)
    monkeypatch.setattr(tracking, "AT_ONCE", 100)
    rng = np.random.default_rng(rounds)
    tracks, boxes = np.zeros(90, tracking._TRACK), np.zeros(120, tracking._WAITING)
    for some in (tracks, boxes):
        some["source"], some["box"] = np.sort(rng.integers(0, 4, len(some))), np.arange(len(some)) % 30
        some["x1"], some["y1"] = rng.integers(0, 8, len(some)), rng.integers(0, 4, len(some))  # many equal overlaps
        some["x2"], some["y2"] = some["x1"] + 6, some["y1"] + 6
    tracks["ms"] = rng.integers(0, 3, len(tracks))
    corners = lambda r: [r[c] for c in ("x1", "y1", "x2", "y2")]
    pairs = sorted((-tracking.overlap(corners(t), corners(b)), t["ms"], t["box"], b["box"], i, j) for i, t in enumerate(tracks) for j, b in enumerate(boxes) if t["source"] == b["source"])
    taken, want = set(), {}
    for value, _, _, _, i, j in pairs:
        if -value >= 0.3 and i not in taken and j not in want:
            taken.add(i)
            want[j] = i
    assert tracking.matched(tracks, boxes, 0.3).tolist() == [want.get(j, -1) for j in range(len(boxes))]


class Handle:
    """A state handle of one id, as far as the retry processor needs it."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, ms):
        self.timers.append(ms)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getCurrentProcessingTimeInMs(self):
        return 1_000


def test_retries_back_off_and_give_up():
    state = Handle()
    processor = retries.Retry(3, 100)
    processor.init(state)
    result = lambda attempt, status: [tuple(r) for r in processor.handleInputRows((5,), iter([{"attempt": attempt, "status": status}]), state)]
    expired = lambda: [tuple(r) for r in processor.handleExpiredTimer((5,), state, None)]
    assert result(1, "retry") == [] and state.timers == [1_100] and expired() == [(5, 2, "offer")]
    assert result(1, "retry") == []  # told twice
    assert result(2, "retry") == [] and state.timers == [1_100, 1_200] and expired() == [(5, 3, "offer")]
    assert result(3, "retry") == [(5, 3, "given_up")] and not state.exists() and expired() == []
    assert result(1, "skip") == [(5, 1, "skip")]


def test_two_appends_at_once_keep_one_header(spark, tmp_path):
    rows = lambda part, n: spark.range(n).select("id", F.lit(part).alias("part"))
    jobs = [threading.Thread(target=K.write_combined, args=(rows(p, 50), f"{tmp_path}/t")) for p in "abcd"]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    K.write_combined(rows("e", 3).withColumn("more", F.lit("x")), f"{tmp_path}/t")
    rows("lost", 9).write.csv(f"{tmp_path}/t/rows/never-committed")
    got = K.read_combined(spark, f"{tmp_path}/t")
    assert got.columns == ["id", "part", "more"] and got.where("part = 'part' or id = 'id'").count() == 0
    assert {r["part"]: r["count"] for r in got.groupBy("part").count().collect()} == {"a": 50, "b": 50, "c": 50, "d": 50, "e": 3}
    assert got.where("more is not null").count() == 3


def test_entity_layouts_refuse_unknown_columns(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, 1.5, [1, 2])], "filename string, batch int, lamina_length double, lobes array<int>")
    K.write_entity(rows, str(tmp_path), "run", "Landmarks", "batch", 2)
    got = K.read_entity(spark, str(tmp_path), "Landmarks").first()
    assert got["file"] == "run__Landmarks__1of2.csv" and got["lobes"] == "[1,2]" and got["lamina_length"] == "1.5" and got["leaf_type"] is None
    assert [len(K.layout(e)) for e in ("Ruler", "Measurements", "EFD", "Landmarks")] == [16, 44, 58, 65]
    with pytest.raises(ValueError, match="unheard"):
        K.write_entity(rows.withColumn("unheard", F.lit(1)), str(tmp_path), "run", "Landmarks", "batch", 2)
