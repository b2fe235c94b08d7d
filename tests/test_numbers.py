import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from kinetra.functions import linalg as la
from kinetra.functions.stats import hazen, hazen_quantiles
from kinetra.operators import evaluation, geometry, matching, registration, scoring, tracks
from kinetra.operators.common import lookup_join, written
from kinetra.operators.ordered_windows import indexed, own, running_sum, with_neighbours
from kinetra.plans import mesh_queries


def midpoint(values, p):
    v = sorted(values)
    h = min(max(len(v) * p + 0.5, 1), len(v))
    return v[math.floor(h) - 1] + (h - math.floor(h)) * (v[math.ceil(h) - 1] - v[math.floor(h) - 1])


def test_hazen(spark):
    r = random.Random(4)
    data = [(k, r.choice([None, float("nan"), r.randrange(9) * 1.0])) for k in "abc" for _ in range(40)] + [("d", None), ("e", 2.0)]
    got = {x.k: x for x in hazen_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.95}).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for k, x in got.items():
        values = [v for q, v in data if q == k and v is not None and v == v]
        assert (x.n, x.a, x.b, x.c) == (len(values), *[pytest.approx(midpoint(values, p)) for p in (0.25, 0.5, 0.95)])
    assert spark.range(1).select(hazen(F.array(F.lit(2.0), F.lit(4.0)), 0.25), hazen(F.array().cast("array<double>"), 0.5)).first() == (2.0, None)


def pose(df, columns):
    return df.select(F.array(*columns).alias("m")).collect()


@pytest.mark.parametrize("angle", [0.0, 1e-9, 1e-4, 1.0, 3.0, math.pi - 1e-5, math.pi])
def test_exp_and_log(spark, angle):
    axis = np.array([0.6, -0.48, 0.64])
    state = [1.0, -2.0, 0.5, *(angle * axis)]
    t = la.exp_map([F.lit(float(x)) for x in state])
    numbers = lambda columns: [float(x) for x in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()]
    t = numbers(t)
    m = np.array(t).reshape(4, 4)
    assert np.abs(m[:3, :3] @ m[:3, :3].T - np.eye(3)).max() < 1e-12
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    assert np.abs(m[:3, :3] - (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k)).max() < 1e-9
    back = numbers(la.log_map([F.lit(x) for x in t]))
    assert np.abs(np.array(numbers(la.exp_map([F.lit(x) for x in back]))).reshape(4, 4) - m).max() < 1e-6
    assert spark.range(1).select(la.is_rigid([F.lit(x) for x in t], 1e-9)).first()[0]


def test_errors_of_poses(spark):
    t = la.exp_map([F.lit(x) for x in (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)])
    turn = la.exp_map([F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 0.0, math.radians(30))])
    eye = la.exp_map([F.lit(0.0)] * 6)
    got = spark.range(1).select(la.translation_error(t, eye), la.rotation_error_deg(turn, eye)).first()
    assert got[0] == pytest.approx(5) and got[1] == pytest.approx(30)
    m, flat = la.frame_of_markers([F.lit(0.0)] * 3, [F.lit(1.0)] * 3, [F.lit(2.0)] * 3)
    assert spark.range(1).select(flat).first()[0]


def test_windows_over_blocks(spark):
    r = random.Random(1)
    data = [(k, i, r.randrange(100)) for k, n in (("a", 57), ("b", 1), ("c", 8)) for i in range(n)]
    df = spark.createDataFrame(r.sample(data, len(data)), "k string, t int, v int")
    at = indexed(df, ["k"], ["t"], F.floor(F.col("t") / 5))
    assert rows(at.select("k", "t", "_at")) == rows(df.select("k", "t", F.col("t").cast("bigint")))
    sums = {(x.k, x.t): x.s for x in running_sum(at, ["k"], F.col("v"), "s", block=8).collect()}
    around, w = with_neighbours(at, ["k"], 2, 1, block=8)
    moving = {(x.k, x.t): x.m for x in own(around.withColumn("m", F.sum("v").over(w.rowsBetween(-2, 1)))).collect()}
    for k, t, _ in data:
        values = [v for q, _, v in sorted(x for x in data if x[0] == k)]
        assert sums[k, t] == sum(values[: t + 1])
        assert moving[k, t] == sum(values[max(0, t - 2) : t + 2])


def test_chain_of_poses(spark):
    r = np.random.default_rng(3)
    steps = [la_exp(r.normal(size=6) * 0.3) for _ in range(40)]
    df = spark.createDataFrame([("s", i, m.ravel().tolist()) for i, m in enumerate(steps)], "s string, _at bigint, step array<double>")
    got = {x._at: np.array(x.pose).reshape(4, 4) for x in tracks.chained_poses(df, "s", ["step"], block=7).collect()}
    acc = np.eye(4)
    for i, m in enumerate(steps):
        acc = acc @ m
        assert np.abs(got[i] - acc).max() < 1e-9


def test_smoothed_poses_chain_mean_twists(spark):
    r = np.random.default_rng(8)
    poses = [la_exp(np.array([5.0, 1, 2, 0.1, 0.2, 0.3]))]
    for _ in range(30):
        poses.append(poses[-1] @ la_exp(np.array([1.0, 0.5, 0, 0.02, 0, 0.05]) + r.normal(size=6) * 0.01))
    data = [("s", i, m.ravel().tolist()) for i, m in enumerate(poses)]
    data.insert(7, ("s", 99, None))
    data = [(k, i, p) for i, (k, _, p) in enumerate(data)]
    df = spark.createDataFrame(data, "s string, _at bigint, pose array<double>")
    got = [np.array(x.smooth).reshape(4, 4) for x in tracks.smoothed_poses(df, "s", "pose", 3).orderBy("_at").collect()]
    twist = lambda m: np.array(spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(*la.log_map(la.matrix(F.col("m")))).first())
    moves = [np.linalg.inv(a) @ b for a, b in zip(poses, poses[1:])]
    assert len(got) == 31 and np.abs(got[0] - poses[0]).max() < 1e-12
    first = la_exp((twist(moves[0]) + twist(moves[1])) / 2)
    assert np.abs(got[1] - poses[0] @ first).max() < 1e-9
    third = la_exp((twist(moves[1]) + twist(moves[2]) + twist(moves[3])) / 3)
    assert np.abs(got[3] - got[2] @ third).max() < 1e-9


def la_exp(s):
    w, v = s[3:], s[:3]
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    m = np.eye(4)
    m[:3, :3] += np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k
    m[:3, 3] = (np.eye(3) + (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k) @ v
    return m


def test_spline_is_monotone_and_meets_a_line(spark):
    knots = [("a", t, float(v)) for t, v in ((0, 0), (10, 1), (20, 5), (60, 6), (70, 6), (100, 9))] + [("b", 0, 1.0), ("b", 40, 3.0)]
    at = indexed(spark.createDataFrame(knots, "k string, t bigint, v double"), ["k"], ["t"], F.lit(0))
    got = tracks.smoothed_spline(at, ["k"], "t", "v", F.lit(10)).orderBy("k", "at").collect()
    a = {t: v for k, t, v in knots if k == "a"} | {x["at"]: x.filled for x in got if x.k == "a"}
    assert [a[t] for t in sorted(a)] == sorted(a.values()) and len(a) == 11
    assert [x.filled for x in got if x.k == "b"] == [pytest.approx(v) for v in (1.5, 2.0, 2.5)]


def test_bodies():
    parts = [f"{b}_{p}" for b in ("A", "A_B") for p in ("q1", "q2", "q3", "q4", "t1", "t2", "t3")]
    assert tracks.bodies_of([*parts, "C_q1", "utc_epoch_ms"]) == ["A", "A_B"]


def test_mesh_and_planes(spark):
    v = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0), ("m", 2, 10.0, 0.0, 0.0), ("m", 3, 0.0, 10.0, 0.0), ("m", 4, 0.0, 0.0, 10.0)], "mesh_id string, vertex_id int, x double, y double, z double")
    f = spark.createDataFrame([("m", 1, 1, 2, 3), ("m", 2, 1, 2, 4), ("m", 3, 2, 3, 4), ("m", 4, 3, 1, 4), ("m", 5, 1, 2, 99)], "mesh_id string, face_id int, v1 int, v2 int, v3 int")
    faces = geometry.triangles(v, f)
    assert faces.count() == 4
    planes = spark.createDataFrame([(1, 2.0), (2, 10.0), (3, 0.0), (4, 99.0), (5, None)], "plane_id int, level double")
    got = rows(geometry.plane_segments(faces, planes).select("plane_id", "face_id", F.round("length", 6)))
    # through the middle three sides; at the top only a corner; at the bottom the sides of three faces, and the longest of the face that lies in it
    assert got == [(1, 2, 8.0), (1, 3, round(math.sqrt(128), 6)), (1, 4, 8.0), (3, 1, round(math.sqrt(200), 6)), (3, 2, 10.0), (3, 3, round(math.sqrt(200), 6)), (3, 4, 10.0)]
    assert geometry.surface_centroid(faces).first().area == pytest.approx(150 + math.sqrt(3) / 4 * 200)
    assert geometry.plane_segments(faces.limit(0), planes).count() == 0
    rays = spark.createDataFrame([("in", 1.0, 1.0, 1.0), ("out", -1.0, 1.0, 1.0), ("past", 1.0, 50.0, 1.0)], "ray_id string, ox double, oy double, oz double").selectExpr("*", "1.0d dx", "0.0d dy", "0.0d dz")
    assert rows(geometry.ray_hits(faces, rays).select("ray_id", "face_id", F.round("t", 6))) == [("in", 3, 7.0), ("in", 4, -1.0), ("out", 3, 9.0), ("out", 4, 1.0)]


def test_patches_and_rays_of_any_direction(spark):
    """Against all pairs in numpy; triangles from tiny to huge, also far from the planes; nulls and planes without area match nothing."""
    r = np.random.default_rng(11)
    tris = [r.normal(size=3) * 3 + r.normal(size=(3, 3)) * s for s in np.repeat([1e-3, 0.05, 0.4, 3.0, 40.0], 80)]
    faces = spark.createDataFrame([("m", i, *t.ravel().tolist()) for i, t in enumerate(tris)] + [("m", 900, *[None] * 9), ("m", 901, *[float("nan")] * 9)], "mesh_id string, face_id int, " + ", ".join(f"{w}{c} double" for w in "abc" for c in "xyz"))
    planes, want = [], set()
    for k in range(25):
        ex, ey = r.normal(size=3), r.normal(size=3)
        ex /= np.linalg.norm(ex)
        ey -= ex * (ex @ ey)
        ey /= np.linalg.norm(ey)
        p0, n, w, h = r.normal(size=3) * 2, np.cross(ex, ey), float(r.uniform(0.5, 6)), float(r.uniform(0.5, 6))
        planes.append((k, p0.tolist(), (ex * 2).tolist(), ey.tolist(), w, h))
        for i, t in enumerate(tris):
            d = (t - p0) @ n
            cut = [t[a] + d[a] / (d[a] - d[b]) * (t[b] - t[a]) for a, b in ((0, 1), (1, 2), (2, 0)) if d[a] * d[b] < 0]
            if len(cut) == 2:
                uv = [np.array([(c - p0) @ ex, (c - p0) @ ey]) for c in cut]
                lo, hi = 0.0, 1.0
                for o, v, m in zip(uv[0], uv[1] - uv[0], (w, h)):
                    ts = sorted((-o / v, (m - o) / v))
                    lo, hi = max(lo, ts[0]), min(hi, ts[1])
                if lo <= hi:
                    want.add((k, i, round((hi - lo) * float(np.linalg.norm(uv[1] - uv[0])), 6)))
    planes += [(100, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], 1.0, 1.0), (101, None, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 1.0, 1.0), (102, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], None, 1.0)]
    df = spark.createDataFrame(planes, "plane_id int, p0 array<double>, ex array<double>, ey array<double>, width double, height double")
    got = geometry.patch_segments(faces, df).withColumn("inside", F.round(F.hypot(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")), 6))
    assert len(want) > 100 and {(x.plane_id, x.face_id, x.inside) for x in got.collect()} == want
    assert geometry.patch_segments(faces.limit(0), df).count() == geometry.patch_segments(faces, df.limit(0)).count() == 0
    rays, hits = [], set()
    for k in range(25):
        o, v = r.normal(size=3) * 2, r.normal(size=3) * (r.random(3) > 0.3)
        rays.append((k, *o.tolist(), *v.tolist()))
        for i, t in enumerate(tris):
            m = np.array([-v, t[1] - t[0], t[2] - t[0]]).T
            if abs(np.linalg.det(m)) > 1e-12:
                at, a, b = np.linalg.solve(m, o - t[0])
                if a >= 0 and b >= 0 and a + b <= 1:
                    hits.add((k, i, round(float(at), 5)))
    got = geometry.ray_hits(faces, spark.createDataFrame(rays, "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double"))
    assert len(hits) > 30 and {(x.ray_id, x.face_id, round(x.t, 5)) for x in got.collect()} == hits


def test_joint_angles(spark):
    """The tibia turned by 30 degrees about each of the femur's axes, on both sides."""
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    turns = {"x": [1, 0, 0, 0, 0, c, -s, 0, 0, s, c, 0], "y": [c, 0, s, 0, 0, 1, 0, 0, -s, 0, c, 0], "z": [c, -s, 0, 0, s, c, 0, 0, 0, 0, 1, 0]}
    df = spark.createDataFrame([(k, [float(x) for x in [*m, 0, 0, 0, 1]]) for k, m in turns.items()], "axis string, m array<double>")
    eye = [F.lit(float(i % 5 == 0)) for i in range(16)]
    for right, want in ((True, {"x": (-30, 0, 0), "y": (0, -30, 0), "z": (0, 0, 30)}), (False, {"x": (-30, 0, 0), "y": (0, 30, 0), "z": (0, 0, -30)})):
        got = {r[0]: tuple(r)[1:] for r in df.select("axis", *la.joint_angles(eye, la.matrix(F.col("m")), right)).collect()}
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_clip_and_raster(spark):
    r = random.Random(5)
    data = [(i, *[r.uniform(-1, 3) for _ in range(4)]) for i in range(60)] + [(100, 0.5, -1.0, 0.5, 3.0), (101, -1.0, 0.5, -0.5, 0.5), (102, 0.0, 0.0, 2.0, 0.0)]
    got = {x.i: x for x in geometry.clip_to_rectangle(spark.createDataFrame(data, "i int, u0 double, v0 double, u1 double, v1 double"), F.lit(2.0), F.lit(2.0)).collect()}
    for i, *s in data:
        t = [k / 4000 for k in range(4001)]
        inside = [x for x in t if 0 <= s[0] + x * (s[2] - s[0]) <= 2 and 0 <= s[1] + x * (s[3] - s[1]) <= 2]
        if len(inside) > 2:
            assert got[i].u0 == pytest.approx(s[0] + inside[0] * (s[2] - s[0]), abs=2e-3) and got[i].v1 == pytest.approx(s[1] + inside[-1] * (s[3] - s[1]), abs=2e-3)
        elif not inside:
            assert i not in got
    line = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "i int, u0 double, v0 double, u1 double, v1 double")
    assert {(x.row, x.col) for x in geometry.raster(line, 10, 10, F.lit(2.0), F.lit(2.0)).collect()} >= {(k, k) for k in range(1, 11)}


def test_scores(spark):
    planes = spark.createDataFrame([("none", 100), ("small", 10), ("edge", 50), ("full", 60)], "plane_id string, n_initial int")
    hits = spark.createDataFrame([("edge", 255.0)] * 25 + [("full", 127.5)] * 90, "plane_id string, intensity double")
    s = {x.plane_id: x for x in scoring.plane_scores(planes, hits, 255.0, 50, 25).collect()}
    assert (s["none"].n_pixels, s["none"].score, s["none"].missing, s["small"].active) == (0, 0.0, True, False)
    assert (s["edge"].coverage, s["edge"].missing, s["edge"].active, s["full"].coverage, s["full"].score) == (0.5, False, True, 1.0, 0.5)
    cost = scoring.pose_cost(scoring.plane_scores(planes, hits, 255.0, 50, 25), 1.0).first()
    assert cost.cost == pytest.approx(-(0 + 0.5 + 0.5) / 3 + 1 / 3)
    assert scoring.pose_cost(scoring.plane_scores(planes.limit(0), hits, 255.0, 50, 25), 1.0).first().cost == 1e6


def test_runs(spark):
    data = [(1, "c1", True, True, 2.0), (2, "c1", True, True, 4.0), (3, "c1", False, False, float("nan")), (4, "c2", True, True, 5.0), (5, "c2", True, True, 7.0)]
    df = spark.createDataFrame(data, "run int, c string, done boolean, ok boolean, rmse double")
    got = rows(evaluation.combination_summary(df, ["c"], "done", "ok", "rmse").select("c", "planned", "evaluated", "failed", F.round("rate", 6), "median", "q25", "q75", "iqr"))
    assert got == [("c1", 3, 2, 1, 0.666667, 3.0, 2.0, 4.0, 2.0), ("c2", 2, 2, 0, 1.0, 6.0, 5.0, 7.0, 2.0)]
    assert rows(evaluation.ranked(df, "rmse", "run").select("run", "rank")) == [(1, 1), (2, 2), (3, None), (4, 3), (5, 4)]
    one = lambda values: spark.createDataFrame([(v,) for v in values], "v double")
    plan = evaluation.experiment_plan({"tol": one([20.0, 30.0]), "ref": one([50.0]), "min": one([50.0, 100.0]), "lam": one([0.5, 1.0])}, spark.createDataFrame([(7,), (8,), (9,)], "s int"))
    got = plan.orderBy("run_number").collect()
    assert len(got) == 24 and [x.tol for x in got[::3]] == [20.0, 30.0] * 4 and [x.seed for x in got[:6]] == [7, 8, 9] * 2 and got[0].combination_id == "combination_0001"


def test_matches(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(matching.exactly_one(left, right, ["k"])) == sorted([("a", 1, "matched"), ("b", 2, "ambiguous"), (None, 0, "missing")], key=repr)
    sets = matching.same_sets(spark.createDataFrame([("g", 1), ("g", 2), ("g", 2)], "g string, m int"), spark.createDataFrame([("g", 2), ("h", 1)], "g string, m int"), ["g"], "m")
    assert rows(sets) == [("g", 2, 1, 1, 0, False), ("h", 0, 1, 0, 1, False)]


def test_fits(spark):
    r = np.random.default_rng(1)
    m = la_exp(r.normal(size=6))
    p = r.normal(size=(20, 3))
    q = p @ m[:3, :3].T + m[:3, 3]
    data = [("a", *map(float, (*x, *y))) for x, y in zip(p, q)] + [("line", float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(5)] + [("few", 1.0, 2.0, 3.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, "k string, x double, y double, z double, u double, v double, w double")
    got = {x.k: x for x in registration.rigid_fit(df, ["k"]).collect()}
    assert np.abs(np.array(got["a"].transform).reshape(4, 4) - m).max() < 1e-9 and got["a"].rmse < 1e-6
    assert got["line"].status == got["few"].status == "skipped"
    ball = 5 * p / np.linalg.norm(p, axis=1)[:, None] + [1, 2, 3]
    points = spark.createDataFrame([("s", *map(float, x)) for x in ball] + [("p", float(a), float(b), 2.0) for a in range(3) for b in range(3)], "k string, x double, y double, z double")
    s = {x.k: x for x in registration.sphere_fit(points, ["k"]).collect()}
    assert s["s"].radius == pytest.approx(5) and s["s"].centre == [pytest.approx(v) for v in (1, 2, 3)] and s["p"].radius is None
    plane = {x.k: x for x in registration.plane_fit(points, ["k"]).collect()}["p"]
    assert plane.normal == [pytest.approx(v, abs=1e-9) for v in (0, 0, 1)] and plane.rms < 1e-9
    moments = tracks.quaternion_moments(spark.createDataFrame([("a", [0.0, 2.0, 0.0, 0.0]), ("a", [0.0, -1.0, 0.0, 0.0]), ("b", None)], "k string, q array<double>"), ["k"], F.col("q"))
    mean = {x.k: x.q for x in tracks.mean_rotation(moments).collect()}
    assert [abs(v) for v in mean["a"]] == [pytest.approx(v) for v in (0, 1, 0, 0)] and mean["b"] is None


def test_spikes_do_not_move_fits(spark):
    r = np.random.default_rng(4)
    m = la_exp(r.normal(size=6))
    p = 300 * r.normal(size=(80, 3))
    q = p @ m[:3, :3].T + m[:3, 3]
    q[:6] += r.uniform(2000, 9000, (6, 3))
    df = spark.createDataFrame([("a", *map(float, (*x, *y))) for x, y in zip(p, q)] + [("few", 1.0, 2.0, 3.0, 1.0, 2.0, 3.0)], "k string, x double, y double, z double, u double, v double, w double")
    got = {x.k: x for x in registration.robust_rigid_fit(df, ["k"]).collect()}
    assert np.abs(np.array(got["a"].transform).reshape(4, 4) - m).max() < 1e-6 and got["a"].rmse < 1e-4
    assert (got["a"].n, got["a"].inliers, got["few"].status) == (80, 74, "skipped")
    ball = 500 * p / np.linalg.norm(p, axis=1)[:, None] + [1, 2, 3]
    ball[:3] += [5000.0, -3000.0, 4000.0]
    points = spark.createDataFrame([("s", *map(float, x)) for x in ball], "k string, x double, y double, z double")
    s = registration.robust_sphere_fit(points, ["k"]).collect()[0]
    assert (s.n, s.inliers) == (80, 77) and s.radius == pytest.approx(500) and s.centre == [pytest.approx(v, abs=1e-4) for v in (1, 2, 3)]


def planned(df):
    """The physical plan before it runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_lookup_that_is_too_large_is_not_broadcast_for_its_small_files(spark):
    lookup = written(spark.range(1_000).select(F.col("id").alias("k"), F.lit("one text").alias("v")))
    rows = spark.range(5_000).select((F.col("id") % 1_000).alias("k"), F.col("id").alias("i"))
    joined = lookup_join(rows, lookup, ["k"], F.col("i"), "inner", fits=False)
    assert "Broadcast" not in planned(joined) and joined.count() == 5_000


def test_quantiles_of_many_keys_copy_no_cuts(spark, monkeypatch):
    monkeypatch.setattr("kinetra.operators.common.small", lambda *_: False)
    df = spark.range(600).select((F.col("id") % 200).alias("k"), F.col("id").cast("double").alias("v"))
    for hot, copied in ((65_536, False), (2, True)):
        monkeypatch.setattr("kinetra.functions.stats.HOT", hot)
        q = hazen_quantiles(df, ["k"], F.col("v"), {"median": 0.5})
        assert "Broadcast" not in planned(q) and ("_salt" in planned(q)) == copied
        assert {(x.k, x.n, x["median"]) for x in q.collect()} == {(k, 3, k + 200.0) for k in range(200)}


def test_smoothed_poses_stay_a_small_plan(spark, monkeypatch):
    sizes = []
    wrote = tracks.written
    monkeypatch.setattr(tracks, "written", lambda df: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or wrote(df))
    pose = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    df = spark.range(10).select(F.lit("s").alias("s"), F.col("id").alias("_at"), pose.alias("pose"))
    assert tracks.smoothed_poses(df, "s", "pose", 3).count() == 10
    assert max(sizes) < 200_000


def test_planes_that_repeat_are_laid_over_a_mesh_once(spark, monkeypatch):
    laid, cut = [], geometry.patch_segments
    monkeypatch.setattr(geometry, "patch_segments", lambda faces, planes, *a: laid.append(planes) or cut(faces, planes, *a))
    assert mesh_queries.pose_cost_of_mesh(spark, f"{DATA}/sf0.001").count() == 5
    places = laid[0].select("plane_id.pose_id", "mesh_id", "p0", "ex", "ey", "width", "height")
    assert 0 < places.count() == places.distinct().count()


def test_images_of_one_key_are_summed_apart(spark):
    pixels = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 1, 2), ("t", 1, 1)], "shape string, row int, col int")
    images = spark.createDataFrame([("s", 1, 2, 1, bytearray([3, 4])), ("s", 2, 2, 1, bytearray([5, 6])), ("t", 3, 2, 1, bytearray([9]))], "shape string, id int, width int, height int, image binary")
    assert rows(scoring.hit_intensities(pixels, images, ["shape"], "shape", ["id"])) == [("s", 1, 2, 7), ("s", 2, 2, 11)]
