"""Queries that take every row of their tables, against brute force."""

from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from traitloom.operators import landmarks as K
from traitloom.operators import linkage as L
from traitloom.operators import models as M
from traitloom.operators import sampling as S
from traitloom.plans import stats_queries
from traitloom.plans.linkage_queries import UNITS
from traitloom.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_image_id_is_looked_up(spark):
    got = [tuple(r) for r in QUERIES["jn07_prefix_lookup"](spark, SF).collect()]
    images = set(pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey"])["l_orderkey"].astype(str))
    occurrences = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"])["o_orderkey"].astype(str)
    want = [(i, o) for o in occurrences for i in images if o.startswith(i)]
    assert sorted(got) == sorted(want)
    assert len({i for i, _ in got}) > 10 * len({i for i in images if int(i) % 50 == 1})


def test_spacings_of_all_strips_agree_within_the_default_tolerance(spark):
    got = [(r["ruler_id"], r["strip_a"], r["unit_a"], r["strip_b"], r["unit_b"]) for r in QUERIES["jn19_consistent_spacings"](spark, SF).collect()]
    events = pd.read_parquet(f"{SF}/events.parquet").dropna(subset=["value"])
    means = events.assign(value=events["value"].astype(float), ruler=events["user_id"].astype(str), strip=pd.to_datetime(events["ts"], utc=True).dt.day).groupby(["ruler", "strip"])["value"].mean()
    readings = defaultdict(list)
    for (ruler, strip), mean in means.items():
        readings[ruler] += [((strip, u), mean * f / d) for u, f, d in UNITS]
    want = [(ruler, *a, *b) for ruler, found in readings.items() for a, x in found for b, y in found if a < b and abs(x - y) < 5]
    assert sorted(got) == sorted(want)
    assert max(r[3] for r in got) > 3


def test_spacings_at_bucket_edges(spark):
    units = spark.createDataFrame([("cm", 1, 1.0)], "unit string, factor int, divisor double")
    means = [0.0, 4.999999, 5.0, 5.005, 9.999, 10.01, 15.0, -0.001, -5.0]
    spacings = spark.createDataFrame([("r", i, m) for i, m in enumerate(means)], "ruler_id string, strip int, mean double")
    got = {(r["strip_a"], r["strip_b"]) for r in L.consistent_spacings(spacings, units).collect()}
    assert got == {(i, j) for i in range(len(means)) for j in range(i + 1, len(means)) if abs(means[i] - means[j]) < 5}
    assert L.consistent_spacings(spacings, units, 0.0).count() == 0


def test_spacings_do_not_hang_on_how_rows_are_split(spark, tmp_path):
    # strip 15's mean is 25.959999999999997 in row order and 25.960000000000004 as 3.48 + (58.95 + 15.45); strip 3's lies 5 from it
    readings = [(9191, 3, 7.74), (48880, 15, 3.48), (49766, 15, 58.95), (50014, 15, 15.45)]
    (tmp_path / "events.parquet").mkdir()
    for i, rows in enumerate((readings[:2], readings[2:])):
        ids, days, values = zip(*rows, strict=True)
        events = pd.DataFrame({"event_id": ids, "ts": [pd.Timestamp(2024, 1, d) for d in days], "user_id": 1107, "event_type": "view", "value": values, "props": "{}"})
        events.to_parquet(tmp_path / "events.parquet" / f"part-{i}.parquet", coerce_timestamps="us")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["jn19_consistent_spacings"]).fetchall()
    got = [tuple(r) for r in QUERIES["jn19_consistent_spacings"](spark, str(tmp_path)).select("ruler_id", "strip_a", "unit_a", "cm_a", "strip_b", "unit_b", "cm_b").collect()]
    assert sorted(got) == sorted(want)
    assert not any(r[1:3] == (3, "4thcm") and r[4:6] == (15, "cm") for r in got)


def contours():
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet")
    return {int(v): np.floor(1000 * np.asarray(e, np.float64)[:64]).reshape(32, 2) for v, e in zip(vectors["vec_id"], vectors["embedding"], strict=True)}


def test_point_pairs_take_all_points(spark):
    pairs = {r["component"]: r for r in QUERIES["jn18_closest_pair"](spark, SF).collect()}
    nearest = {(r["component"], r["seq"]): r for r in QUERIES["jn20_nearest_point"](spark, SF).collect()}
    shapes = contours()
    assert set(pairs) == set(shapes) and set(nearest) == {(c, s) for c in shapes for s in range(16)}
    for c, xy in shapes.items():
        d2 = ((xy[:16, None] - xy[None, 16:]) ** 2).sum(axis=2)
        r = pairs[c]
        assert (r["x1"] - r["x2"]) ** 2 + (r["y1"] - r["y2"]) ** 2 == d2.min()
        assert [nearest[c, s]["ref_seq"] for s in range(16)] == [16 + int(k) for k in d2.argmin(axis=1)]


def descriptors(xy, order=40):
    step = np.roll(xy, -1, axis=0) - xy
    dt = np.where((step == 0).all(axis=1), 1e-9, np.hypot(*step.T))
    t = np.cumsum(dt)
    n = np.arange(1, order + 1)[:, None]
    phase = lambda t: 2 * np.pi * n * t / t_end
    t_end = t[-1]
    wave = np.cos(phase(t)) - np.cos(phase(t - dt)), np.sin(phase(t)) - np.sin(phase(t - dt))
    scale = t_end / (2 * n[:, 0] ** 2 * np.pi**2)
    return np.stack([scale * (step[:, k] / dt * w).sum(axis=1) for k in (0, 1) for w in wave], axis=1)


def test_descriptors_have_40_harmonics(spark):
    shapes = contours()
    got = QUERIES["fn13_fourier_descriptors"](spark, SF).toPandas().sort_values(["component", "harmonic"])
    assert len(got) == 40 * len(shapes)
    want = np.concatenate([descriptors(shapes[c]) for c in sorted(shapes)])
    assert np.abs(got[list("abcd")].to_numpy(float) - want).max() < 1e-3
    assert set(QUERIES["fn14_normalised_descriptors"](spark, SF).toPandas()["harmonic"]) == set(range(2, 41))


def test_reconstruction_has_300_samples_of_40_harmonics(spark):
    got = QUERIES["fn16_reconstructed"](spark, SF).toPandas().sort_values(["component", "step"])
    shapes = contours()
    assert len(got) == 300 * len(shapes)
    phase = 2 * np.pi * np.arange(1, 41) * np.arange(300)[:, None] / 299
    for c in sorted(shapes)[:20]:
        a, b, *_ = descriptors(shapes[c]).T
        x = got[got["component"] == c]["x"].to_numpy(float)
        want = np.cos(phase) @ a + np.sin(phase) @ b
        assert np.abs((x - x[0]) - (want - want[0])).max() < 0.01


def test_descriptor_components_use_all_coefficients(spark):
    got = QUERIES["ml06_descriptor_components"](spark, SF).toPandas()
    wide = np.stack([descriptors(xy).ravel() for xy in contours().values()])
    spread = np.sort(np.linalg.eigvalsh(np.corrcoef(wide.T)))[::-1][:4]
    assert got[["pc1", "pc2", "pc3", "pc4"]].var().to_numpy() == pytest.approx(spread, rel=1e-3)


@pytest.mark.parametrize("name", ["ml03_correctness_forest", "ml04_fallback"])
def test_forests_have_100_trees(spark, monkeypatch, name):
    fit, models = M.correctness_forest, []

    def kept(*args, **named):
        models.append(fit(*args, **named))
        return models[-1]

    monkeypatch.setattr(M, "correctness_forest", kept)
    QUERIES[name](spark, SF)
    assert [m.getNumTrees for m, _ in models] == [100]


def test_keypoint_lines_fill_all_slots_and_kinds(spark):
    got = {r["leaf"]: r["line"] for r in QUERIES["prj20_keypoint_lines"](spark, SF).collect()}
    used = set()
    for leaf, xy in contours().items():
        line = [(0, 0, 0)] * 31
        count = defaultdict(int)
        for seq, (x, y) in enumerate(xy):
            kind = K.KINDS[(seq * 7 + leaf) % 9]
            names = K.SLOTS_OF_KIND.get(kind, ())
            if count[kind] < len(names):
                line[K.SLOT_LINE_31.index(names[count[kind]])] = (int(x), int(y), 2)
                used.add(kind)
            count[kind] += 1
        assert got[leaf] == " ".join(str(v) for p in line for v in p)
    assert used == set(K.KINDS) - {"lobe_tip"}


def test_swapping_takes_out_more_than_10000_ids(spark, monkeypatch):
    pool = spark.range(32_000).selectExpr("cast(id as string) as id", "cast(id % 8000 as string) as genus").selectExpr("cast(cast(id as long) * 3 as string) as id", "genus")
    monkeypatch.setattr(stats_queries, "view", lambda *_: pool)
    chosen = {r["id"] for r in S.per_group(pool, ["genus"], 3).collect()}
    removed = {i for i in chosen if int(i) % 2 == 0}
    got = [r["id"] for r in QUERIES["wn07_swapped"](spark, SF).collect()]
    assert len(removed) > 10_000
    assert not removed & set(got) and chosen - removed <= set(got) and len(got) == len(set(got))
