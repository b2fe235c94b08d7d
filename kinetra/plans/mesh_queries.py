"""Queries of meshes, planes and rays. Each embedding gives triangles: nine of its numbers are three corners."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kinetra.functions import linalg as la
from kinetra.operators import geometry as geo
from kinetra.operators import scoring
from kinetra.operators.common import written
from kinetra.plans.tables import table


def _faces(spark, d, scale: float = 1.0):
    """Six triangles an embedding, at 0, 9, ... 45; mesh is the label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    e = e.select("vec_id", F.col("label").cast("string").alias("mesh_id"), "embedding", F.explode(F.array(*[F.lit(9 * i) for i in range(6)])).alias("_o"))
    corners = [(F.get("embedding", F.col("_o") + 3 * i + j).cast("double") * scale).alias(f"{w}{c}") for i, w in enumerate("abc") for j, c in enumerate("xyz")]
    return e.select("mesh_id", (F.col("vec_id") * 6 + F.col("_o") / 9).cast("bigint").alias("face_id"), *corners)


def _planes(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("plane_id"), (0.02 * (F.col("n_nationkey") - 12)).alias("level"))


def _segments(spark, d):
    return geo.plane_segments(_faces(spark, d), _planes(spark, d))


def plane_mesh_intersections(spark, d):
    """Per plane: triangles that it cuts, and the length of the cut."""
    return _segments(spark, d).groupBy("plane_id").agg(F.count("*").alias("segments"), F.round(F.sum("length"), 5).alias("length"))


def _clipped(spark, d):
    ends = [(F.get(c, F.lit(i)) + 0.1).alias(f"{w}{k}") for k, c in enumerate("pq") for i, w in enumerate("uv")]
    return geo.clip_to_rectangle(_segments(spark, d).select("plane_id", "face_id", *ends), F.lit(0.2), F.lit(0.2))


def segment_clip(spark, d):
    """Per plane: segments inside a rectangle, and what of their length is left."""
    got = _clipped(spark, d)
    return got.groupBy("plane_id").agg(F.count("*").alias("inside"), F.round(F.sum(F.sqrt(F.pow(F.col("u1") - F.col("u0"), 2) + F.pow(F.col("v1") - F.col("v0"), 2))), 5).alias("length"))


def segment_raster_pixels(spark, d):
    """Per plane and column of pixels: pixels that any segment passes."""
    lit = geo.raster(_clipped(spark, d), 40, 40, F.lit(0.2), F.lit(0.2))
    return lit.select("plane_id", "row", "col").distinct().groupBy("plane_id", "col").agg(F.count("*").alias("pixels"))


def face_normals_orientation(spark, d):
    """Per mesh: centre, and by area whether its normals point out."""
    got = geo.outward_sign(_faces(spark, d))
    return got.select("mesh_id", "sign", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "share")])


def facing_filter(spark, d):
    """Per mesh: faces within 30 degrees of the direction -y."""
    score = geo.facing_score(geo.face_normal(), [F.lit(0.0), F.lit(-1.0), F.lit(0.0)])
    return _faces(spark, d).withColumn("s", score).groupBy("mesh_id").agg(F.count("*").alias("faces"), F.count_if(F.col("s") >= F.cos(F.radians(F.lit(30.0)))).alias("facing"), F.round(F.avg("s"), 6).alias("mean_score"))


def area_weighted_centroid(spark, d):
    """Per mesh: area and centre of the surface."""
    return geo.surface_centroid(_faces(spark, d)).select("mesh_id", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy", "cz")])


def _rays(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(n.alias("ray_id"), F.lit(0.0).alias("ox"), (0.01 * (n - 12)).alias("oy"), (0.007 * (12 - n)).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))


def ray_oblique(spark, d):
    """Per ray in any direction: hits and the nearest ones on both sides."""
    n = F.col("ray_id")
    turned = {"dx": F.cos(0.7 * n), "dy": F.sin(0.7 * n) * 0.8, "dz": F.sin(0.7 * n) * 0.6}
    hits = geo.ray_hits(_faces(spark, d), _rays(spark, d).withColumns(turned))
    ahead, behind = F.min(F.when(F.col("t") >= 0, F.col("t"))), F.max(F.when(F.col("t") < 0, F.col("t")))
    return hits.groupBy("ray_id").agg(F.count("*").alias("hits"), F.round(ahead, 6).alias("ahead"), F.round(behind, 6).alias("behind"))


def _frame(a, b):
    """Directions of a plane turned by a about z, then tilted by b."""
    return F.array(F.cos(a), F.sin(a), F.lit(0.0)), F.array(-F.sin(a) * F.cos(b), F.cos(a) * F.cos(b), F.sin(b))


def _tilted_planes(spark, d):
    n = F.col("n_nationkey")
    ex, ey = _frame(0.25 * n, 0.4 * n)
    p0 = F.array(0.005 * (n - 12) - 0.15 * F.cos(0.25 * n), -0.15 * F.sin(0.25 * n), 0.004 * (12 - n))
    return table(spark, d, "nation").select(n.alias("plane_id"), p0.alias("p0"), ex.alias("ex"), ey.alias("ey"), F.lit(0.3).alias("width"), F.lit(0.2).alias("height"))


def plane_mesh_oblique(spark, d):
    """Per tilted plane: segments inside its rectangle, and their length there."""
    cut = geo.patch_segments(_faces(spark, d), _tilted_planes(spark, d))
    inside = F.sqrt(F.pow(F.col("u1") - F.col("u0"), 2) + F.pow(F.col("v1") - F.col("v0"), 2))
    return cut.groupBy("plane_id").agg(F.count("*").alias("segments"), F.round(F.sum(inside), 5).alias("length"))


def pose_cost_of_mesh(spark, d):
    """Per pose: the cost of the meshes laid over the packets' images: faces towards the probe, their pixels, and the grey values there."""
    a = 0.1 * (F.col("packet_id") % 63)
    ex, ey = _frame(a, F.acos(F.lit(0.6)))
    packets = table(spark, d, "packets").where("session_id is not null and image is not null").dropDuplicates(["packet_id"])
    images = written(packets.select(F.col("packet_id").alias("plane_id"), (F.col("session_id") % 10).cast("string").alias("mesh_id"), "packet_id", "width", "height", "image"))
    planes = images.select("plane_id", "mesh_id", F.array(-0.2 * F.cos(a), -0.2 * F.sin(a), F.lit(-0.1)).alias("p0"), ex.alias("ex"), ey.alias("ey"), F.lit(0.4).alias("width"), F.lit(0.3).alias("height"))
    shapes, likes = geo.distinct_planes(written(planes), ["mesh_id"])
    r, zero, one = F.col("r_regionkey"), F.lit(0.0), F.lit(1.0)
    g = 0.05 * r
    pose = F.array(F.cos(g), -F.sin(g), zero, 0.01 * r, F.sin(g), F.cos(g), zero, -0.01 * r, zero, zero, one, 0.005 * r, zero, zero, zero, one)
    poses = table(spark, d, "region").select(r.alias("pose_id"), pose.alias("pose"), F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<string>")).alias("mesh_id"))
    faces = _faces(spark, d)
    views = written(geo.posed_planes(shapes, poses, ["mesh_id"]))
    view = views.withColumn("plane_id", F.struct("pose_id", "plane_id"))  # a plane as one pose sees it
    seen = geo.facing_segments(geo.patch_segments(faces, view, ["mesh_id"]), faces, view, ["mesh_id"])
    lit = geo.raster(seen.select("plane_id.*", "u0", "v0", "u1", "v1"), 4, 3, F.lit(0.4), F.lit(0.3)).select("pose_id", F.col("plane_id").alias("shape"), "row", "col")
    got = scoring.hit_intensities(lit, images.join(likes, "plane_id"), ["pose_id", "shape"], "shape", ["plane_id"])
    got = written(got.drop("shape"))
    first = got.where("pose_id = 0").select("plane_id", F.col("n").alias("n_initial"))
    all_views = images.select("plane_id", "mesh_id").join(poses.select("pose_id", "mesh_id"), "mesh_id").select("pose_id", "plane_id").join(first, "plane_id", "left").fillna(0, ["n_initial"])
    scores = scoring.plane_totals(all_views, got, ["pose_id", "plane_id"], 255.0, 2.0, 2.0)
    cost = scoring.pose_cost(scores, 0.5, ["pose_id"])
    return cost.select("pose_id", F.round("cost", 6).alias("cost"), F.round("mean_intensity", 4).alias("mean_intensity"), "n_active", "n_missing")


def ray_triangle_hits(spark, d):
    """Per ray and mesh: hits before and behind its origin."""
    hits = geo.ray_hits(_faces(spark, d), _rays(spark, d))
    return hits.groupBy("ray_id", "mesh_id").agg(F.count("*").alias("hits"), F.count_if(F.col("t") >= 0).alias("forward"), F.round(F.sum("t"), 5).alias("sum_t"))


def outermost_hits(spark, d):
    """Per ray: the outermost hit on either side."""
    hits = geo.ray_hits(_faces(spark, d), _rays(spark, d))
    return hits.groupBy("ray_id").agg(F.round(F.min("t"), 6).alias("outer_minus"), F.round(F.max("t"), 6).alias("outer_plus"))


def crossing_parity(spark, d):
    """Per ray and mesh: whether the origin is enclosed, with an odd number of hits on both sides."""
    hits = geo.ray_hits(_faces(spark, d), _rays(spark, d))
    forward = F.count_if(F.col("t") >= 0)
    return hits.groupBy("ray_id", "mesh_id").agg(((forward % 2 == 1) & ((F.count("*") - forward) % 2 == 1)).alias("enclosed"))


def tolerant_distinct_hits(spark, d):
    """Per brand: prices that lie more than one above the one before."""
    return geo.distinct_within(table(spark, d, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 1.0)


def _state(o: int):
    return [F.get("embedding", F.lit(o + i)).cast("double") * 3 for i in range(6)]


def _poses(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.array(*_state(0)).alias("sa"), F.array(*_state(6)).alias("sb")).select(
        "vec_id", "sa", *[F.array(*la.exp_map([F.get(s, F.lit(i)) for i in range(6)])).alias(n) for s, n in (("sa", "ta"), ("sb", "tb"))]
    )


def exp_map_pose(spark, d):
    """Transforms of twists."""
    return _poses(spark, d).select("vec_id", *[F.round(F.get("ta", F.lit(i)), 6).alias(f"m{i}") for i in range(12)])


def log_map_roundtrip(spark, d):
    """Twists of transforms of twists, which are the twists."""
    back = _poses(spark, d).withColumn("back", F.array(*la.log_map(la.matrix(F.col("ta")))))
    return back.select("vec_id", *[F.round(F.get("back", F.lit(i)), 6).alias(f"s{i}") for i in range(6)])


def pose_errors(spark, d):
    """Distance and angle between two poses."""
    a, b = la.matrix(F.col("ta")), la.matrix(F.col("tb"))
    return _poses(spark, d).select("vec_id", F.round(la.translation_error(a, b), 6).alias("translation"), F.round(la.rotation_error_deg(a, b), 5).alias("rotation_deg"))


def rigid_transform_points(spark, d):
    """A point taken through a composed transform, and back through its inverse."""
    c = _poses(spark, d).withColumn("tc", F.array(*la.compose(la.matrix(F.col("ta")), la.matrix(F.col("tb")))))
    p = la.apply(la.matrix(F.col("tc")), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    c = c.withColumn("p", F.array(*p))
    back = la.apply(la.inverse(la.matrix(F.col("tc"))), la.vec(F.col("p")))
    return c.select("vec_id", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate("xyz")], *[F.round(x, 6).alias(f"back_{n}") for x, n in zip(back, "xyz")])


def marker_frames(spark, d):
    """Rigid bodies from three markers: origin, x axis, and whether they are degenerate."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.array(*la.vec(F.col("embedding"), 3 * i)).alias(n) for i, n in enumerate("abc")])
    m, flat = la.frame_of_markers(*[la.vec(F.col(c)) for c in "abc"])
    return e.select("vec_id", flat.alias("degenerate"), *[F.round(m[i], 6).alias(n) for i, n in ((0, "x1"), (4, "x2"), (8, "x3"))])


def joint_angles(spark, d):
    """Flexion, abduction and rotation between two poses, of the right and of the left side."""
    a, b = la.matrix(F.col("ta")), la.matrix(F.col("tb"))
    names = ("flexion", "abduction", "rotation")
    sides = [F.round(x, 4).alias(f"{n}_{side}") for side in ("right", "left") for x, n in zip(la.joint_angles(a, b, side == "right"), names)]
    return _poses(spark, d).select("vec_id", *sides)


_MODULE = (
    plane_mesh_intersections, segment_clip, segment_raster_pixels, face_normals_orientation, facing_filter, area_weighted_centroid, ray_triangle_hits, outermost_hits, crossing_parity,
    plane_mesh_oblique, ray_oblique, pose_cost_of_mesh,
    tolerant_distinct_hits, exp_map_pose, log_map_roundtrip, pose_errors, rigid_transform_points, marker_frames, joint_angles,
)
QUERIES = {f.__name__: f for f in _MODULE}

_F = "f AS (SELECT CAST(label AS TEXT) AS mesh_id, vec_id * 6 + o AS face_id, " + ", ".join(f"embedding[9 * o + {3 * i + j + 1}]::DOUBLE AS {w}{c}" for i, w in enumerate("abc") for j, c in enumerate("xyz")) + " FROM embeddings, range(6) r(o))"
_D = {w: f"(CASE WHEN abs({w}z - level) < 1e-10 THEN 0 ELSE {w}z - level END)" for w in "abc"}
_SEG = (
    f"WITH {_F}, n AS (SELECT n_nationkey AS plane_id, 0.02::DOUBLE * (n_nationkey - 12) AS level FROM nation), "
    f"d AS (SELECT f.*, plane_id, level, {_D['a']} AS da, {_D['b']} AS db, {_D['c']} AS dc FROM f JOIN n ON level BETWEEN least(az, bz, cz) - 1e-9 AND greatest(az, bz, cz) + 1e-9), "
    "x AS (SELECT plane_id, mesh_id, face_id, list_filter(["
    + ", ".join(f"CASE WHEN d{w} = 0 THEN [{w}x, {w}y] END" for w in "abc")
    + ", "
    + ", ".join(f"CASE WHEN d{u} * d{v} < 0 THEN [{u}x + d{u} / (d{u} - d{v}) * ({v}x - {u}x), {u}y + d{u} / (d{u} - d{v}) * ({v}y - {u}y)] END" for u, v in ("ab", "bc", "ca"))
    + "], lambda p: p IS NOT NULL) AS l FROM d), s AS (SELECT plane_id, mesh_id, face_id, l[1] AS p, l[2] AS q, sqrt((l[2][1] - l[1][1]) ** 2 + (l[2][2] - l[1][2]) ** 2) AS length FROM x WHERE len(l) = 2)"
)
_CLIP = (
    _SEG
    + ", u AS (SELECT plane_id, face_id, p[1] + 0.1 AS u0, p[2] + 0.1 AS v0, q[1] - p[1] AS du, q[2] - p[2] AS dv FROM s WHERE length > 0), "
    + "t AS (SELECT *, greatest(0, CASE WHEN du > 0 THEN -u0 / du WHEN du < 0 THEN (0.2 - u0) / du ELSE 0 END, CASE WHEN dv > 0 THEN -v0 / dv WHEN dv < 0 THEN (0.2 - v0) / dv ELSE 0 END) AS t0, "
    + "least(1, CASE WHEN du > 0 THEN (0.2 - u0) / du WHEN du < 0 THEN -u0 / du ELSE 1 END, CASE WHEN dv > 0 THEN (0.2 - v0) / dv WHEN dv < 0 THEN -v0 / dv ELSE 1 END) AS t1 FROM u), "
    + "c AS (SELECT plane_id, face_id, u0 + t0 * du AS u0, v0 + t0 * dv AS v0, u0 + t1 * du AS u1, v0 + t1 * dv AS v1 FROM t WHERE t0 <= t1 AND NOT (du = 0 AND (u0 < 0 OR u0 > 0.2)) AND NOT (dv = 0 AND (v0 < 0 OR v0 > 0.2)))"
)
_CROSS = [("y", "z"), ("z", "x"), ("x", "y")]
_N = [f"((b{p} - a{p}) * (c{q} - a{q}) - (b{q} - a{q}) * (c{p} - a{p}))" for p, q in _CROSS]
_AREA = f"(sqrt({' + '.join(f'{n} * {n}' for n in _N)}) / 2)"
_HITS = (
    f"WITH {_F}, r AS (SELECT n_nationkey AS ray_id, 0.01::DOUBLE * (n_nationkey - 12) AS oy, 0.007::DOUBLE * (12 - n_nationkey) AS oz FROM nation), "
    "m AS (SELECT ray_id, mesh_id, bx - ax AS ex, by - ay AS ey, bz - az AS ez, cx - ax AS gx, cy - ay AS gy, cz - az AS gz, 0 - ax AS sx, oy - ay AS sy, oz - az AS sz FROM f, r WHERE oy BETWEEN least(ay, by, cy) - 1e-9 AND greatest(ay, by, cy) + 1e-9), "
    "k AS (SELECT *, ey * -gz + ez * gy AS det FROM m), "
    "h AS (SELECT ray_id, mesh_id, (sy * -gz + sz * gy) / det AS u, (sy * ez - sz * ey) / det AS v, (gx * (sy * ez - sz * ey) + gy * (sz * ex - sx * ez) + gz * (sx * ey - sy * ex)) / det AS t FROM k WHERE abs(det) > 1e-12), "
    "hits AS (SELECT * FROM h WHERE u >= -1e-12 AND v >= -1e-12 AND u + v <= 1 + 1e-12)"
)


def _oblique(pairs: str) -> str:
    """CTEs up to c: segments of triangles (corners) and planes (origin p, directions e and f, normal n, size w by h), cut to the rectangle."""
    dist = ", ".join(f"({w}x - px) * n1 + ({w}y - py) * n2 + ({w}z - pz) * n3 AS d{w}" for w in "abc")
    point = lambda u, v, q: f"{u}{q} + d{u} / (d{u} - d{v}) * ({v}{q} - {u}{q})"
    on = lambda u, v, e: " + ".join(f"({point(u, v, q)} - p{q}) * {e}{i}" for i, q in enumerate("xyz", 1))
    cuts = ", ".join(f"CASE WHEN d{u} * d{v} < 0 THEN [{on(u, v, 'e')}, {on(u, v, 'f')}] END" for u, v in ("ab", "bc", "ca"))
    return (
        f"pr AS ({pairs}), dd AS (SELECT *, {dist} FROM pr), ll AS (SELECT *, list_filter([{cuts}], lambda p: p IS NOT NULL) AS l FROM dd), "
        "uu AS (SELECT pose_id, plane_id, face_id, w, h, l[1][1] AS u0, l[1][2] AS v0, l[2][1] - l[1][1] AS du, l[2][2] - l[1][2] AS dv FROM ll WHERE len(l) = 2), "
        "tt AS (SELECT *, greatest(0, CASE WHEN du > 0 THEN -u0 / du WHEN du < 0 THEN (w - u0) / du ELSE 0 END, CASE WHEN dv > 0 THEN -v0 / dv WHEN dv < 0 THEN (h - v0) / dv ELSE 0 END) AS t0, "
        "least(1, CASE WHEN du > 0 THEN (w - u0) / du WHEN du < 0 THEN -u0 / du ELSE 1 END, CASE WHEN dv > 0 THEN (h - v0) / dv WHEN dv < 0 THEN -v0 / dv ELSE 1 END) AS t1 FROM uu), "
        "c AS (SELECT pose_id, plane_id, face_id, u0 + t0 * du AS u0, v0 + t0 * dv AS v0, u0 + t1 * du AS u1, v0 + t1 * dv AS v1 FROM tt WHERE t0 <= t1 AND NOT (du = 0 AND (u0 < 0 OR u0 > w)) AND NOT (dv = 0 AND (v0 < 0 OR v0 > h)))"
    )


def _exp(s: str, o: int) -> str:
    """Columns s0 ... s11 of the transform of the twist at place o of an embedding."""
    v, w = ([f"(embedding[{o + k + i}]::DOUBLE * 3)" for i in range(3)] for k in (1, 4))
    a2 = f"({' + '.join(f'{x} * {x}' for x in w)})"
    sn, cs, ds = f"(sin(sqrt({a2})) / sqrt({a2}))", f"((1 - cos(sqrt({a2}))) / {a2})", f"((sqrt({a2}) - sin(sqrt({a2}))) / ({a2} * sqrt({a2})))"
    k = [["0", f"-{w[2]}", w[1]], [w[2], "0", f"-{w[0]}"], [f"-{w[1]}", w[0], "0"]]
    k2 = [[f"({w[i]} * {w[j]} - {a2 if i == j else 0})" for j in range(3)] for i in range(3)]
    out = []
    for i in range(3):
        out += [f"{1 if i == j else 0} + {sn} * {k[i][j]} + {cs} * {k2[i][j]} AS {s}{4 * i + j}" for j in range(3)]
        out.append(" + ".join(f"({1 if i == j else 0} + {cs} * {k[i][j]} + {ds} * {k2[i][j]}) * {v[j]}" for j in range(3)) + f" AS {s}{4 * i + 3}")
    return ", ".join(out)


#: Up to c: the segments of all triangles in the tilted planes.
_CURVES = (
    f"WITH {_F}, n AS (SELECT n_nationkey AS plane_id, 0.25 * n_nationkey AS a, 0.4 * n_nationkey AS b, n_nationkey AS k FROM nation), "
    "o AS (SELECT plane_id, 0.005 * (k - 12) - 0.15 * cos(a) AS px, -0.15 * sin(a) AS py, 0.004 * (12 - k) AS pz, cos(a) AS e1, sin(a) AS e2, 0 AS e3, -sin(a) * cos(b) AS f1, cos(a) * cos(b) AS f2, sin(b) AS f3, sin(a) * sin(b) AS n1, -cos(a) * sin(b) AS n2, cos(b) AS n3 FROM n), "
    + _oblique("SELECT f.*, o.*, 0 AS pose_id, 0.3 AS w, 0.2 AS h FROM f, o")
)
_POSES = f"WITH p AS (SELECT vec_id, embedding, {_exp('a', 0)}, {_exp('b', 6)} FROM embeddings)"
_TRACE = " + ".join(f"a{4 * i + j} * b{4 * i + j}" for i in range(3) for j in range(3))
_C = {f"c{4 * i + j}": " + ".join(f"a{4 * i + k} * b{4 * k + j}" for k in range(3)) + (f" + a{4 * i + 3}" if j == 3 else "") for i in range(3) for j in range(4)}
_E = {w: [f"embedding[{3 * i + j + 1}]::DOUBLE" for j in range(3)] for i, w in enumerate("abc")}
SQL = {
    "plane_mesh_intersections": _SEG + " SELECT plane_id, count(*) AS segments, round(sum(length), 5) AS length FROM s WHERE length > 0 GROUP BY 1",
    "segment_clip": _CLIP + " SELECT plane_id, count(*) AS inside, round(sum(sqrt((u1 - u0) ** 2 + (v1 - v0) ** 2)), 5) AS length FROM c GROUP BY 1",
    "segment_raster_pixels": _CLIP
    + ", e AS (SELECT *, greatest(2, ceil(4 * greatest(abs(u1 - u0) / (0.2 / 40), abs(v1 - v0) / (0.2 / 40))) + 1) AS n FROM c), i AS (SELECT *, unnest(range(CAST(n AS BIGINT))) / (n - 1) AS t FROM e), "
    + "px AS (SELECT DISTINCT plane_id, greatest(least(floor((v0 + t * (v1 - v0)) / (0.2 / 40)) + 1, 40), 1) AS row, CAST(greatest(least(floor((u0 + t * (u1 - u0)) / (0.2 / 40)) + 1, 40), 1) AS INT) AS col FROM i) SELECT plane_id, col, count(*) AS pixels FROM px GROUP BY 1, 2",
    "face_normals_orientation": f"WITH {_F}, c AS (SELECT mesh_id, avg((ax + bx + cx) / 3) AS mx, avg((ay + by + cy) / 3) AS my, avg((az + bz + cz) / 3) AS mz FROM f GROUP BY 1), "
    f"v AS (SELECT mesh_id, mx, my, mz, {_AREA} AS area, {_N[0]} * ((ax + bx + cx) / 3 - mx) + {_N[1]} * ((ay + by + cy) / 3 - my) + {_N[2]} * ((az + bz + cz) / 3 - mz) AS side FROM f JOIN c USING (mesh_id)), "
    "g AS (SELECT mesh_id, mx, my, mz, coalesce(sum(area) FILTER (side > 0), 0) AS o, coalesce(sum(area) FILTER (side < 0), 0) AS i FROM v GROUP BY ALL) SELECT mesh_id, CASE WHEN i > o THEN -1 ELSE 1 END AS sign, round(mx, 6) AS cx, round(my, 6) AS cy, round(mz, 6) AS cz, round(greatest(o, i) / (o + i), 6) AS share FROM g",
    "facing_filter": f"WITH {_F}, s AS (SELECT mesh_id, -{_N[1]} / (2 * {_AREA}) AS s FROM f) SELECT mesh_id, count(*) AS faces, count(*) FILTER (s >= cos(radians(30))) AS facing, round(avg(s), 6) AS mean_score FROM s GROUP BY 1",
    "area_weighted_centroid": f"WITH {_F}, g AS (SELECT mesh_id, sum({_AREA}) AS area, " + ", ".join(f"sum({_AREA} * (a{c} + b{c} + c{c}) / 3) AS s{c}" for c in "xyz") + " FROM f GROUP BY 1) SELECT mesh_id, round(area, 6) AS area, round(sx / area, 6) AS cx, round(sy / area, 6) AS cy, round(sz / area, 6) AS cz FROM g",
    "ray_triangle_hits": _HITS + " SELECT ray_id, mesh_id, count(*) AS hits, count(*) FILTER (t >= 0) AS forward, round(sum(t), 5) AS sum_t FROM hits GROUP BY 1, 2",
    "outermost_hits": _HITS + " SELECT ray_id, round(min(t), 6) AS outer_minus, round(max(t), 6) AS outer_plus FROM hits GROUP BY 1",
    "crossing_parity": _HITS + " SELECT ray_id, mesh_id, count(*) FILTER (t >= 0) % 2 = 1 AND count(*) FILTER (t < 0) % 2 = 1 AS enclosed FROM hits GROUP BY 1, 2",
    "tolerant_distinct_hits": "WITH o AS (SELECT p_brand, p_retailprice, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS p FROM (SELECT DISTINCT p_brand, p_retailprice FROM part WHERE p_retailprice IS NOT NULL)) SELECT p_brand, p_retailprice FROM o WHERE p IS NULL OR p_retailprice - p > 1",
    "exp_map_pose": _POSES + " SELECT vec_id, " + ", ".join(f"round(a{i}, 6) AS m{i}" for i in range(12)) + " FROM p",
    "log_map_roundtrip": "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 3, 6) AS s{i}" for i in range(6)) + " FROM embeddings",
    "pose_errors": _POSES + f" SELECT vec_id, round(sqrt((a3 - b3) ** 2 + (a7 - b7) ** 2 + (a11 - b11) ** 2), 6) AS translation, round(degrees(acos(greatest(least(({_TRACE} - 1) / 2, 1), -1))), 5) AS rotation_deg FROM p",
    "rigid_transform_points": _POSES + ", c AS (SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in _C.items()) + " FROM p) SELECT vec_id, " + ", ".join(f"round(c{4 * i} + 2 * c{4 * i + 1} + 3 * c{4 * i + 2} + c{4 * i + 3}, 6) AS {n}" for i, n in enumerate("xyz")) + ", 1.0::DOUBLE AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z FROM c",
    "marker_frames": f"WITH p AS (SELECT vec_id, [{', '.join(f'{c} - {a}' for a, c in zip(_E['a'], _E['c']))}] AS y, [{', '.join(f'{b} - {a}' for a, b in zip(_E['a'], _E['b']))}] AS s FROM embeddings), "
    "u AS (SELECT vec_id, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))) AS y, s FROM p), f AS (SELECT vec_id, [s[i] - y[i] * list_dot_product(s, y) for i in [1, 2, 3]] AS f FROM u) "
    "SELECT vec_id, sqrt(list_dot_product(f, f)) <= 1e-9 AS degenerate, " + ", ".join(f"round(f[{i}] / sqrt(list_dot_product(f, f)), 6) AS x{i}" for i in (1, 2, 3)) + " FROM f",
    "joint_angles": _POSES + ", x AS (SELECT vec_id, " + ", ".join(f"a{i} * b{j} + a{i + 4} * b{j + 4} + a{i + 8} * b{j + 8} AS r{i + 1}{j + 1}" for i in range(3) for j in range(3)) + " FROM p) "
    "SELECT vec_id, round(degrees(atan2(r23, r33)), 4) AS flexion_right, round(degrees(acos(greatest(least(r13, 1), -1)) - pi() / 2), 4) AS abduction_right, round(degrees(-atan2(r12, r11)), 4) AS rotation_right, "
    "round(degrees(atan2(r23, r33)), 4) AS flexion_left, round(degrees(pi() / 2 - acos(greatest(least(r13, 1), -1))), 4) AS abduction_left, round(degrees(atan2(r12, r11)), 4) AS rotation_left FROM x",
    "plane_mesh_oblique": _CURVES
    + " SELECT plane_id, count(*) AS segments, round(sum(sqrt((u1 - u0) ** 2 + (v1 - v0) ** 2)), 5) AS length FROM c GROUP BY 1",
    "ray_oblique": f"WITH {_F}, r AS (SELECT n_nationkey AS ray_id, 0.01 * (n_nationkey - 12) AS oy, 0.007 * (12 - n_nationkey) AS oz, cos(0.7 * n_nationkey) AS d1, sin(0.7 * n_nationkey) * 0.8 AS d2, sin(0.7 * n_nationkey) * 0.6 AS d3 FROM nation), "
    "m AS (SELECT ray_id, d1, d2, d3, bx - ax AS ex, by - ay AS ey, bz - az AS ez, cx - ax AS gx, cy - ay AS gy, cz - az AS gz, 0 - ax AS sx, oy - ay AS sy, oz - az AS sz FROM f, r), "
    "k AS (SELECT *, d2 * gz - d3 * gy AS h1, d3 * gx - d1 * gz AS h2, d1 * gy - d2 * gx AS h3, sy * ez - sz * ey AS q1, sz * ex - sx * ez AS q2, sx * ey - sy * ex AS q3 FROM m), "
    "t AS (SELECT *, ex * h1 + ey * h2 + ez * h3 AS det FROM k), "
    "x AS (SELECT ray_id, (sx * h1 + sy * h2 + sz * h3) / det AS u, (d1 * q1 + d2 * q2 + d3 * q3) / det AS v, (gx * q1 + gy * q2 + gz * q3) / det AS t FROM t WHERE abs(det) > 1e-12) "
    "SELECT ray_id, count(*) AS hits, round(min(t) FILTER (t >= 0), 6) AS ahead, round(max(t) FILTER (t < 0), 6) AS behind FROM x WHERE u >= -1e-12 AND v >= -1e-12 AND u + v <= 1 + 1e-12 GROUP BY 1",
    "pose_cost_of_mesh": f"WITH {_F}, m0 AS (SELECT mesh_id, avg((ax + bx + cx) / 3) AS mx, avg((ay + by + cy) / 3) AS my, avg((az + bz + cz) / 3) AS mz FROM f GROUP BY 1), "
    f"v0 AS (SELECT mesh_id, {_AREA} AS area, {_N[0]} * ((ax + bx + cx) / 3 - mx) + {_N[1]} * ((ay + by + cy) / 3 - my) + {_N[2]} * ((az + bz + cz) / 3 - mz) AS side FROM f JOIN m0 USING (mesh_id)), "
    "g0 AS (SELECT mesh_id, CASE WHEN coalesce(sum(area) FILTER (side < 0), 0) > coalesce(sum(area) FILTER (side > 0), 0) THEN -1 ELSE 1 END AS sign FROM v0 GROUP BY 1), "
    f"q AS (SELECT f.*, sign, {_N[0]} / (2 * {_AREA}) AS w1, {_N[1]} / (2 * {_AREA}) AS w2, {_N[2]} / (2 * {_AREA}) AS w3 FROM f JOIN g0 USING (mesh_id)), "
    "s0 AS (SELECT r_regionkey AS pose_id, cos(0.05 * r_regionkey) AS cg, sin(0.05 * r_regionkey) AS sg, r_regionkey AS r FROM region), "
    "moved AS (SELECT mesh_id, face_id, pose_id, sign, "
    + ", ".join(f"cg * {w}x - sg * {w}y + 0.01 * r AS {w}x, sg * {w}x + cg * {w}y - 0.01 * r AS {w}y, {w}z + 0.005 * r AS {w}z" for w in "abc")
    + ", cg * w1 - sg * w2 AS w1, sg * w1 + cg * w2 AS w2, w3 FROM q, s0), "
    "pk AS (SELECT DISTINCT ON (packet_id) packet_id AS plane_id, CAST(session_id % 10 AS TEXT) AS mesh_id, 0.1 * (packet_id % 63) AS a, width, height, image FROM packets WHERE session_id IS NOT NULL AND image IS NOT NULL ORDER BY packet_id), "
    "o AS (SELECT *, -0.2 * cos(a) AS px, -0.2 * sin(a) AS py, -0.1 AS pz, cos(a) AS e1, sin(a) AS e2, 0 AS e3, -sin(a) * 0.6 AS f1, cos(a) * 0.6 AS f2, 0.8 AS f3, sin(a) * 0.8 AS n1, -cos(a) * 0.8 AS n2, 0.6 AS n3 FROM pk), "
    + _oblique("SELECT moved.*, o.* EXCLUDE (mesh_id, width, height, image, a), 0.4 AS w, 0.3 AS h FROM moved JOIN o USING (mesh_id) WHERE -sign * (w1 * f1 + w2 * f2 + w3 * f3) >= 0.5")
    + ", e AS (SELECT *, greatest(2, ceil(4 * greatest(abs(u1 - u0) / 0.1, abs(v1 - v0) / 0.1)) + 1) AS n FROM c), i AS (SELECT *, unnest(range(CAST(n AS BIGINT))) / (n - 1) AS t FROM e), "
    "px AS (SELECT DISTINCT pose_id, plane_id, CAST(greatest(least(floor((v0 + t * (v1 - v0)) / 0.1) + 1, 3), 1) AS INT) AS row, CAST(greatest(least(floor((u0 + t * (u1 - u0)) / 0.1) + 1, 4), 1) AS INT) AS col FROM i), "
    "hit AS (SELECT pose_id, plane_id, count(*) AS n, sum(CAST('0x' || substr(hex(image), ((row - 1) * width + col - 1) * 2 + 1, 2) AS INT)) AS total FROM px JOIN pk USING (plane_id) WHERE octet_length(image) = width * height GROUP BY 1, 2), "
    "z AS (SELECT s0.pose_id, pk.plane_id, coalesce(h0.n, 0) AS n0, coalesce(h1.n, 0) AS n, coalesce(h1.total / h1.n, 0) AS mean FROM pk CROSS JOIN s0 LEFT JOIN hit h0 ON h0.plane_id = pk.plane_id AND h0.pose_id = 0 LEFT JOIN hit h1 ON h1.plane_id = pk.plane_id AND h1.pose_id = s0.pose_id) "
    "SELECT pose_id, round(-avg(mean / 255 * least(1, n / greatest(n0, 2))) FILTER (n0 >= 2) + 0.5 * avg(CAST(n < 2 AS INT)) FILTER (n0 >= 2), 6) AS cost, round(sum(mean * n) / sum(n), 4) AS mean_intensity, count(*) FILTER (n0 >= 2) AS n_active, count(*) FILTER (n0 >= 2 AND n < 2) AS n_missing FROM z GROUP BY 1",
}
#: BY is a word of SQL, so corners are b_x, b_y and b_z there.
SQL = {name: re.sub(r"\bb([xyz])\b", r"b_\1", text) for name, text in SQL.items()}
_CURVES = re.sub(r"\bb([xyz])\b", r"b_\1", _CURVES)
