import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kinetra.operators import evidence as ev
from kinetra.operators import landmarks as lm
from kinetra.operators.images import Segmentation


def bone(seed=0, noise=0.04, gap=()):
    """A bright line with a shadow below, under brighter tissue noise; its depth in rows per column, 0.1 mm a pixel."""
    r = np.random.default_rng(seed)
    h, w = 120, 150
    depth = 45 + 12 * np.sin(np.arange(w) / 40)
    y = np.arange(h)[:, None]
    image = 0.35 + 0.5 * np.exp(-0.5 * ((y - depth) / 2.0) ** 2)
    image[y > depth + 4] *= 0.3
    image = np.clip(image + r.normal(0, noise, (h, w)), 0, 1)
    for a, b in gap:
        image[:, a:b] = 0.1
    return image, depth


def test_parts_of_the_evidence():
    flat = np.full((9, 7), 0.4)
    assert np.allclose(ev.blurred(flat, 2.0, 1.0), 0.4) and np.allclose(ev.ridge(flat, 1, 1), 0)
    line = np.zeros((9, 7))
    line[4] = 1
    assert (ev.ridge(line, 1, 1).argmax(0) == 4).all()
    assert [ev.first_peak(np.array(v, float)) for v in ([3], [2, 2, 5], [1, 3, 3, 2, 9], [1, 2, 3], [1, 2, 2])] == [0, 0, 2, 2, 1]
    mask = np.ones((9, 7), bool)
    assert np.allclose(ev.between_percentiles(flat, mask, (5, 95)), 0.5)
    scaled = ev.between_percentiles(np.arange(63.0).reshape(9, 7), mask, (5, 95))
    assert scaled.min() == 0 and scaled.max() == 1 and scaled[4, 3] == pytest.approx(0.5)
    dark = np.ones((30, 1))
    dark[10:] = 0
    below = ev.shadow(dark, 0.1, 0.1, 1.0)
    assert below[9, 0] == pytest.approx(1.0) and below[0, 0] < 0.2 and below[29, 0] == pytest.approx(0.5)
    assert ev.fused([np.array([0.25]), np.array([1.0])], (1.0, 1.0))[0] == pytest.approx(0.5)
    x = np.array([0.0, 1, 4, 5])
    assert np.allclose(ev.monotone_fill(x, 2 * x, np.array([2.0, 3.0])), [4, 6])
    steps = ev.monotone_fill(np.array([0.0, 1, 5, 6]), np.array([0.0, 0, 3, 3]), np.arange(1.0, 5.0, 0.5))
    assert (np.diff(steps) >= 0).all() and steps.max() <= 3


@pytest.mark.parametrize("noise, bound", [(0.03, 0.35), (0.08, 0.45)])
def test_the_surface_is_found(noise, bound):
    image, depth = bone(3, noise)
    mask = image > 0.55
    found, observed, conf = ev.traced(image, mask, 0.1, 0.1, ev.Evidence())
    known = ~np.isnan(found)
    assert known.mean() > 0.9 and np.median(np.abs(found - depth)[known]) * 0.1 <= bound
    assert ((conf[observed] >= 0) & (conf[observed] <= 1)).all()


def test_gaps_groups_and_confidence():
    image, depth = bone(5, 0.02, [(40, 50), (90, 125)])
    e = ev.Evidence(gap=1.5)
    found, observed, conf = ev.traced(image, image > 0.6, 0.1, 0.1, e)
    assert not np.isnan(found[40:50]).any() and not observed[40:50].any()  # a millimetre is filled
    assert np.isnan(found[95:120]).all()  # more than that isn't
    assert np.allclose(conf[41:49], min(conf[39], conf[50]) * math.exp(-1.0 / 1.5), atol=0.05)
    short = ev.traced(image, image > 0.6, 0.1, 0.1, ev.Evidence(gap=1.5, least_length=4.0))[0]
    assert np.isnan(short[125:]).all() and not np.isnan(short[:90]).all()
    assert np.isnan(ev.traced(image, np.zeros(image.shape, bool), 0.1, 0.1, e)[0]).all()


def test_bone_surfaces_of_frames(spark):
    image, depth = bone(1, 0.02)
    grey = (image * 255).astype(np.uint8)
    data = [(1, 150, 120, grey.tobytes()), (2, 150, 120, grey.tobytes()[:-1]), (3, None, 120, grey.tobytes()), (4, 150, 120, None)]
    df = spark.createDataFrame(data, "id int, width int, height int, image binary")
    got = {r.id: r for r in ev.bone_surfaces(df, "id", 0.1, 0.1, candidates=Segmentation(threshold=150)).collect()}
    assert got[1].n_observed > 130 and np.median(np.abs(np.array(got[1].depth, float) - depth)) < 3
    assert all(got[i].depth is None and got[i].n_observed is None for i in (2, 3, 4))
    assert ev.bone_surfaces(df.limit(0), "id", 0.1, 0.1).count() == 0


def test_components_against_brute_force(spark):
    r = random.Random(3)
    edges = [(k, a, b) for k in "xy" for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(40))] + [("long", i, i + 1) for i in range(200)]
    got = {(x.k, x.node): x.component for x in lm.component_labels(spark.createDataFrame(edges, "k string, a int, b int"), ["k"]).collect()}
    want = {(k, n): n for k, a, b in edges for n in (a, b)}
    changed = True
    while changed:
        changed = False
        for k, a, b in edges:
            low = min(want[k, a], want[k, b])
            changed |= want[k, a] != low or want[k, b] != low
            want[k, a] = want[k, b] = low
    assert got == want


def test_curves_are_put_in_order(spark):
    r = random.Random(2)
    wave = [(0.1 * i, math.sin(0.1 * i)) for i in range(40)]
    ring = [(10 + math.cos(2 * math.pi * i / 24), 5 + math.sin(2 * math.pi * i / 24)) for i in range(24)]
    segments = [(*a, *b) for a, b in zip(wave, wave[1:])] + [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    segments = [(s[2], s[3], s[0], s[1]) if r.random() < 0.5 else s for s in segments]
    r.shuffle(segments)
    df = spark.createDataFrame([("p", *s) for s in segments] + [("p", *segments[0])], "plane string, u0 double, v0 double, u1 double, v1 double")
    curves = lm.ordered_curves(df, ["plane"], 1e-6)
    by = {}
    for x in curves.orderBy("curve", "place").collect():
        by.setdefault(x.curve, []).append((x.u, x.v))
    assert sorted(map(len, by.values())) == [24, 40]
    line = next(c for c in by.values() if len(c) == 40)
    assert np.allclose(line, wave)
    circle = next(c for c in by.values() if len(c) == 24)
    assert all(math.dist(a, b) < 0.27 for a, b in zip(circle, circle[1:])) and circle[0] == min(circle)
    level = lm.level_points(curves, ["plane"], 20.0)
    top = [x for x in level.where("u < 5").collect()]
    assert {round(x.u, 1) for x in top} == {round(u, 1) for u, _ in wave if abs(math.cos(u)) <= math.tan(math.radians(20.5))} | ({round(x.u, 1) for x in top} & {0.0, 3.9})
    assert lm.ordered_curves(df.limit(0), ["plane"], 1e-6).count() == 0


def test_planes_turns_and_calibrations(spark):
    df = spark.createDataFrame([([0.0, -2.0, 0.0, 5.0, 2.0, 0.0, 0.0, 6.0, 0.0, 0.0, 2.0, 7.0, 0.0, 0.0, 0.0, 1.0],), ([1.0],), (None,)], "m array<double>")
    got = [r.o for r in df.select(lm.orthonormalised(F.col("m")).alias("o")).collect()]
    assert np.allclose(got[0].pose, [0, -1, 0, 5, 1, 0, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]) and np.allclose(got[0].scale, 2) and got[1].pose is None and got[2].scale is None
    one = spark.range(1)
    turn = np.array(one.select(*lm.axis_turn("z", F.lit(90.0))).first()).reshape(4, 4)
    assert np.allclose(turn @ [1, 0, 0, 1], [0, 1, 0, 1])
    corners = one.select(*[x for c in lm.quad_corners([F.lit(v) for v in (0.0, 0.0, 1.0)], [F.lit(v) for v in (1.0, 0.0, 0.0)], [F.lit(v) for v in (0.0, 1.0, 0.0)], F.lit(2.0), F.lit(3.0)) for x in c]).first()
    assert tuple(corners) == (0, 0, 1, 2, 0, 1, 2, 3, 1, 0, 3, 1)
    ways = one.select(*[x for d in lm.angled_directions([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(30.0)) for x in d]).first()
    assert np.allclose(ways, [0.5, 0, -math.cos(math.pi / 6), 0.5, 0, math.cos(math.pi / 6), math.cos(math.pi / 6), 0, -0.5])


def test_masks_regions_and_bands(spark):
    pixels = spark.createDataFrame([("f", 1, 1), ("f", 1, 2), ("g", 1, 1)], "frame string, row int, col int")
    area = spark.createDataFrame([("f", 1, 2), ("f", 1, 2), ("g", 5, 5)], "frame string, row int, col int")
    assert rows(lm.masked(pixels, area, ["frame"])) == [("f", 1, 2)]
    names = spark.createDataFrame([("A_F_MID",), ("A_T_MEP",), (None,)], "g string").select(lm.region_of(F.col("g")))
    assert [r[0] for r in names.collect()] == ["shaft", "mep", None]
    points = spark.createDataFrame([("m", float(i), 0.0, float(i)) for i in range(10)] + [("few", 0.0, 0.0, 3.0)], "mesh_id string, x double, y double, z double")
    assert rows(lm.band_centroid(points, ["mesh_id"], F.col("z"), F.lit(2.0), F.lit(4.0))) == [("m", 3, 3.0, 0.0, 3.0)]
