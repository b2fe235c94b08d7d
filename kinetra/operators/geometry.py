"""Meshes, planes and rays: theta joins as joins on cells of a size that fits each triangle, and the geometry of each match."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions.linalg import Vec, add, cross, dot, inverse, matrix, norm, scale, sub, unit
from kinetra.functions.linalg import apply as transformed
from kinetra.operators.common import lookup_join, made, shuffle_partitions, written
from kinetra.operators.ordered_windows import indexed, own, with_neighbours

#: The finest cells are this part of what is laid over the mesh (a plane's patch, the mesh's box for rays).
CELLS_ACROSS = 32
#: The smallest cell is 2 to this power.
FINEST = -40


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners: mesh_id, face_id, ax ... cz; faces that name a vertex that isn't there are left out.

    ``vertices``: mesh_id, vertex_id, x, y, z. ``faces``: mesh_id, face_id, v1, v2, v3. The corners are gathered by one
    join over the faces' corners and one aggregation, whatever size the mesh has.
    """
    corners = faces.select("mesh_id", "face_id", F.posexplode(F.array("v1", "v2", "v3")).alias("_i", "vertex_id"))
    found = corners.join(vertices, ["mesh_id", "vertex_id"])
    pick = [F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{p}{c}") for i, p in enumerate("abc") for c in "xyz"]
    return found.groupBy("mesh_id", "face_id").agg(F.count("*").alias("_n"), *pick).where("_n = 3").drop("_n")


def corner(df: DataFrame | None, which: str) -> list[Column]:
    return [F.col(f"{which}{c}") for c in "xyz"]


def face_normal() -> list[Column]:
    """The unit normal of the row's triangle, null if it has no area."""
    a, b, c = (corner(None, w) for w in "abc")
    return unit(cross(sub(b, a), sub(c, a)))


def face_area() -> Column:
    a, b, c = (corner(None, w) for w in "abc")
    return norm(cross(sub(b, a), sub(c, a))) / 2


def crossing(a: Vec, b: Vec, da: Column, db: Column) -> list[Column]:
    """Where the edge a b meets the plane at signed distances 0, from the distances of its ends; null if it doesn't cross between them."""
    t = F.when((da < 0) & (db > 0) | (da > 0) & (db < 0), da / (da - db))
    return [x + t * (y - x) for x, y in zip(a, b)]


def _level(extent: Column, finest: float | None = None) -> Column:
    """The power of two that a size doesn't exceed; a triangle of that size lies in at most two cells of it along an axis."""
    least = FINEST if not finest else max(FINEST, math.ceil(math.log2(finest)))
    return F.greatest(F.coalesce(F.ceil(F.log2(F.when(extent > 0, extent))).cast("int"), F.lit(least)), F.lit(least))


def _cell(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _on_grid(low: Column, high: Column, cell: Column) -> Column:
    """The numbers of the cells between two places, a little more than that at both ends."""
    pad = cell * 1e-6
    return F.sequence(F.floor((low - pad) / cell).cast("bigint"), F.floor((high + pad) / cell).cast("bigint"))


def _levels(faces: DataFrame, level: Column) -> list[int]:
    """The levels that occur: powers of two of a double, so a few dozen numbers."""
    return sorted(r[0] for r in faces.select(level).distinct().collect())


def _sound(faces: DataFrame) -> DataFrame:
    """Faces whose corners are finite numbers, with their box: _lx ... _hz."""
    names = [f"{w}{c}" for w in "abc" for c in "xyz"]
    finite = reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])
    return faces.where(finite).withColumns({f"_{f}{c}": g(*[F.col(f"{w}{c}") for w in "abc"]) for f, g in (("l", F.least), ("h", F.greatest)) for c in "xyz"})


def _in_cells(faces: DataFrame, level: Column) -> DataFrame:
    """Sound faces once for each cell of their level that their box meets: _level, _cx, _cy, _cz."""
    out = faces.withColumn("_level", level)
    for c in "xyz":
        out = out.withColumn(f"_c{c}", F.explode(_on_grid(F.col(f"_l{c}"), F.col(f"_h{c}"), _cell(F.col("_level")))))
    return out


def _farthest(points: list[Column]) -> Column:
    """Of up to three points (null: none) the two that lie farthest apart, as an array; null with fewer than two."""
    pairs = [(points[i], points[j]) for i in range(3) for j in range(i + 1, 3)]
    gap = [F.coalesce(norm([F.get(q, F.lit(i)) - F.get(p, F.lit(i)) for i in range(3)]), F.lit(-1.0)) for p, q in pairs]
    most = F.greatest(*gap)
    out = F.when(most < 0, None)
    for g, (p, q) in zip(gap, pairs):
        out = out.when(g == most, F.array(p, q))
    return out


def _cut(pairs: DataFrame, distance: dict[str, Column], tolerance: Column, keep: Sequence[str]) -> DataFrame:
    """Where triangles meet planes, given the signed distances of their corners: the kept columns, p (start), q (end), length.

    Distances within tolerance are 0. The cut of a triangle is the pair of points farthest apart among the corners in the plane and
    the crossings of its edges; a triangle that only touches the plane with a corner has none, one that lies in it its longest side.
    """
    pairs = pairs.withColumns({f"_d{w}": F.when(F.abs(d) < tolerance, 0.0).otherwise(d) for w, d in distance.items()}).withColumn("_tol", tolerance)
    d = {w: F.col(f"_d{w}") for w in "abc"}
    hit = pairs.where((F.least(*d.values()) <= 0) & (F.greatest(*d.values()) >= 0))
    points = []
    for w, (u, v) in zip("abc", ("ab", "bc", "ca")):  # per corner: itself, else the crossing of the edge that begins there
        on_edge = F.when(d[u] * d[v] < 0, F.array(*crossing(corner(None, u), corner(None, v), d[u], d[v])))
        points.append(F.when(d[w] == 0, F.array(*corner(None, w))).otherwise(on_edge))
    # one list, exploded, so that what follows refers to its result and doesn't repeat its making
    hit = hit.select(*keep, "_tol", F.explode(F.array(F.array(*points))).alias("_p"))
    hit = hit.select(*keep, "_tol", F.explode(F.array(_farthest([F.get("_p", F.lit(i)) for i in range(3)]))).alias("_p")).where("_p is not null")
    p, q = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    length = norm([F.get(q, F.lit(i)) - F.get(p, F.lit(i)) for i in range(3)])
    return hit.select(*keep, p.alias("p"), q.alias("q"), length.alias("length"), "_tol").where("length > _tol").drop("_tol")


def plane_segments(faces: DataFrame, planes: DataFrame, axis: str = "z", tolerance: float = 1e-10) -> DataFrame:
    """The segments in which triangles meet unbounded planes at right angles to an axis: plane_id, mesh_id, face_id, p, q, length.

    ``faces``: mesh_id, face_id and corners ax ... cz. ``planes``: plane_id, level. Distances within ``tolerance`` times the
    larger of 1 and the level count as 0; see _cut. Tilted planes: patch_segments.

    A triangle lies in at most three buckets of the axis as wide as its own extent; a plane is in one bucket of each width that
    occurs. No pair is formed where the buckets don't meet. Null and infinite corners match nothing.
    """
    low, high = F.col(f"_l{axis}"), F.col(f"_h{axis}")
    sound, level = _sound(faces), _level(high - low)
    at = sound.withColumn("_level", level).withColumn("_b", F.explode(_on_grid(low - tolerance, high + tolerance, _cell(F.col("_level")))))
    widths = F.array(*[F.lit(x) for x in _levels(sound, level)]).cast("array<int>")
    levels = planes.where("level is not null and not isnan(level)").select("plane_id", "level", F.explode(widths).alias("_level"))
    levels = levels.withColumn("_b", F.floor(F.col("level") / _cell(F.col("_level"))).cast("bigint"))
    pairs = at.join(levels, ["_level", "_b"]).where((low <= F.col("level") + _snap(tolerance)) & (high >= F.col("level") - _snap(tolerance)))
    pairs = pairs.where(F.col("_b") == F.floor(F.col("level") / _cell(F.col("_level"))))
    return _cut(pairs, {w: F.col(f"{w}{axis}") - F.col("level") for w in "abc"}, _snap(tolerance), ["plane_id", "mesh_id", "face_id"])


def _snap(tolerance: float) -> Column:
    return tolerance * F.greatest(F.abs("level"), F.lit(1.0))


def with_frame(planes: DataFrame) -> DataFrame:
    """Finite planes as plane_id, ..., p0, ex, ey, n: both directions of length 1, the normal ex x ey; planes without are left out.

    ``planes``: p0 (the corner at u = v = 0), ex and ey (directions of u and v) as arrays of three, width, height. ey needn't be
    at right angles to ex.
    """
    ex, ey = (unit([F.get(c, F.lit(i)).cast("double") for i in range(3)]) for c in ("ex", "ey"))
    out = made(made(planes, "ex", F.array(*ex)), "ey", F.array(*ey))
    n = unit(cross([F.get("ex", F.lit(i)) for i in range(3)], [F.get("ey", F.lit(i)) for i in range(3)]), 1e-9)
    out = made(out, "n", F.array(*n))
    known = reduce(lambda a, b: a & b, [F.get(c, F.lit(i)).isNotNull() & ~F.isnan(F.get(c, F.lit(i))) for c in ("p0", "ex", "ey", "n") for i in range(3)])
    return out.where(known & (F.col("width") > 0) & (F.col("height") > 0))


def _patch_cells(planes: DataFrame, levels: list[int]) -> DataFrame:
    """Framed planes once for each cell, of each level, that their rectangle meets.

    Along the axis nearest to the normal the rectangle is a height over the other two axes, with slopes of at most 1: one
    column of cells for each cell below it, at most four cells high.
    """
    g = lambda c, i: F.get(c, i)
    size = [F.abs(F.get("n", F.lit(i))) for i in range(3)]
    m = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    out = planes.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_m", m)
    out = out.withColumns({"_a": (F.col("_m") + 1) % 3, "_k": (F.col("_m") + 2) % 3, "_s": _cell(F.col("_level"))})
    for name, axis in (("a", F.col("_a")), ("k", F.col("_k")), ("m", F.col("_m"))):
        u, v = F.col("width") * g("ex", axis), F.col("height") * g("ey", axis)
        out = out.withColumns({f"_l{name}": g("p0", axis) + F.least(u, F.lit(0.0)) + F.least(v, F.lit(0.0)), f"_h{name}": g("p0", axis) + F.greatest(u, F.lit(0.0)) + F.greatest(v, F.lit(0.0))})
        if name != "m":
            out = out.withColumn(f"_c{name}", F.explode(_on_grid(F.col(f"_l{name}"), F.col(f"_h{name}"), F.col("_s"))))
    slope = {x: g("n", F.col(f"_{x}")) / g("n", F.col("_m")) for x in "ak"}
    at = g("p0", F.col("_m")) - sum((slope[x] * ((F.col(f"_c{x}") + 0.5) * F.col("_s") - g("p0", F.col(f"_{x}"))) for x in "ak"), F.lit(0.0))
    half = (F.abs(slope["a"]) + F.abs(slope["k"])) * F.col("_s") / 2
    low, high = F.greatest(at - half, F.col("_lm")), F.least(at + half, F.col("_hm"))
    out = out.withColumn("_cm", F.explode(F.when(low <= high + F.col("_s") * 1e-6, _on_grid(low, F.greatest(low, high), F.col("_s")))))
    which = lambda i: F.when(F.col("_m") == i, F.col("_cm")).when(F.col("_a") == i, F.col("_ca")).otherwise(F.col("_ck"))
    return out.withColumns({f"_c{c}": which(i) for i, c in enumerate("xyz")}).drop("_m", "_a", "_k", "_s", "_la", "_ha", "_lk", "_hk", "_lm", "_hm", "_ca", "_ck", "_cm")


def patch_segments(faces: DataFrame, planes: DataFrame, on: Sequence[str] = (), tolerance: float = 1e-10) -> DataFrame:
    """The segments in which triangles meet finite planes of any direction, cut to the plane's rectangle.

    ``faces``: mesh_id, face_id, corners ax ... cz. ``planes``: plane_id, p0, ex, ey (arrays), width, height; see with_frame.
    ``on``: columns of both that must be equal, as the mesh that a plane is laid over. Result: the columns ``on``, plane_id,
    mesh_id, face_id, p and q (the uncut segment in space), length (uncut), u0, v0, u1, v1 (cut to the rectangle, in the plane's coordinates). Corners
    within ``tolerance`` times the larger of 1 and the meshes' box lie in the plane; see _cut. Null, infinite and missing numbers match nothing.

    Triangles go to the cells of a grid as fine as themselves (but not finer than CELLS_ACROSS cells across the largest plane),
    planes to the cells of all these grids that their rectangle passes; both meet by cell, and a pair that meets in several cells is
    formed once: in the first of the triangle's cells that the plane passes, which the distinct keys of the few real hits decide.
    """
    framed = written(with_frame(planes.select("plane_id", *on, "p0", "ex", "ey", "width", "height")))
    largest = framed.agg(F.max(F.greatest("width", "height"))).first()[0]
    sound = _sound(faces)
    level = _level(F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in "xyz"]), (largest or 1.0) / CELLS_ACROSS)
    box = sound.agg(*[f(f"_{x}{c}").alias(f"{x}{c}") for x, f in (("l", F.min), ("h", F.max)) for c in "xyz"]).first()
    extent = math.dist([box[f"l{c}"] for c in "xyz"], [box[f"h{c}"] for c in "xyz"]) if box["lx"] is not None else 1.0
    cells = _patch_cells(framed, _levels(sound, level))
    keys = [*on, "_level", "_cx", "_cy", "_cz"]
    spread = _in_cells(sound, level).repartition(shuffle_partitions(faces), "face_id")  # by number: a small mesh is one file
    pairs = lookup_join(spread, cells, keys, F.col("face_id"), "inner")
    n, p0 = ([F.get(c, F.lit(i)) for i in range(3)] for c in ("n", "p0"))
    distance = {w: dot(sub(corner(None, w), p0), n) for w in "abc"}
    ids = [*on, "plane_id", "mesh_id", "face_id"]
    cut = _cut(pairs, distance, F.lit(tolerance * max(extent, 1.0)), [*ids, "p0", "ex", "ey", "width", "height"])
    for k, point in ((0, "p"), (1, "q")):
        away = [F.get(point, F.lit(i)) - F.get("p0", F.lit(i)) for i in range(3)]
        cut = cut.withColumns({f"{c}{k}": dot(away, [F.get(e, F.lit(i)) for i in range(3)]) for c, e in (("u", "ex"), ("v", "ey"))})
    inside = clip_to_rectangle(cut.drop("p0", "ex", "ey"), F.col("width"), F.col("height"))
    return inside.dropDuplicates(ids).drop("width", "height")


def clip_to_rectangle(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rows with u0, v0, u1, v1 cut to 0..width by 0..height; rows of which nothing is left are dropped (Liang-Barsky)."""
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    df = df.withColumns({"_du": du, "_dv": dv})
    start, end, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-F.col("_du"), F.col("u0")), (F.col("_du"), width - F.col("u0")), (-F.col("_dv"), F.col("v0")), (F.col("_dv"), height - F.col("v0"))):
        t = q / F.when(p != 0, p)
        start.append(F.when(p < 0, t).otherwise(0.0))
        end.append(F.when(p > 0, t).otherwise(1.0))
        outside |= (p == 0) & (q < 0)
    df = df.where(~outside).withColumns({"_t0": F.greatest(*start), "_t1": F.least(*end)}).where("_t0 <= _t1")
    cut = {f"{c}{k}": F.col(f"{c}0") + F.col(f"_t{k}") * F.col(f"_d{c}") for c in "uv" for k in (0, 1)}
    return df.withColumns(cut).drop("_du", "_dv", "_t0", "_t1")


def raster(df: DataFrame, columns: int, rows: int, width: Column, height: Column) -> DataFrame:
    """Rows with u0, v0, u1, v1 once for every pixel (``row``, ``col``, from 1) that the segment passes, four samples a pixel."""
    du, dv = width / columns, height / rows
    n = F.greatest(F.lit(2), F.ceil(4 * F.greatest(F.abs(F.col("u1") - F.col("u0")) / du, F.abs(F.col("v1") - F.col("v0")) / dv)) + 1)
    sampled = df.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    t = F.col("_i") / (F.col("_n") - 1)
    pixel = lambda a, b, d, most: F.greatest(F.least(F.floor((F.col(a) + t * (F.col(b) - F.col(a))) / d) + 1, F.lit(most)), F.lit(1)).cast("int")
    return sampled.withColumn("col", pixel("u0", "u1", du, columns)).withColumn("row", pixel("v0", "v1", dv, rows)).drop("_n", "_i").distinct()


def facing_score(normal: Vec, towards: Vec) -> Column:
    """The cosine between a face's normal and a direction; null for a face without area."""
    return dot(normal, towards)


def outward_sign(faces: DataFrame) -> DataFrame:
    """Per mesh: centre (mean of corners, cx, cy, cz), share of the area whose normals point away from it, and sign (-1: turn them; 1 else).

    The centre and the vote are two aggregations with partial sums; a mesh without area has share 1 and sign 1.
    """
    mean = [F.avg((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(f"c_{c}") for c in "xyz"]
    centres = written(faces.groupBy("mesh_id").agg(*mean))
    middle = [(F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 - F.col(f"c_{c}") for c in "xyz"]
    side = dot(face_normal(), middle)
    voted = lookup_join(faces, centres, ["mesh_id"], F.col("face_id"), "inner").groupBy("mesh_id", "c_x", "c_y", "c_z").agg(
        F.sum(F.when(side > 0, face_area()).otherwise(0.0)).alias("_out"), F.sum(F.when(side < 0, face_area()).otherwise(0.0)).alias("_in")
    )
    total = F.col("_out") + F.col("_in")
    share = F.when(total > 0, F.greatest("_out", "_in") / total).otherwise(1.0)
    return voted.select("mesh_id", F.col("c_x").alias("cx"), F.col("c_y").alias("cy"), F.col("c_z").alias("cz"), share.alias("share"), F.when(F.col("_in") > F.col("_out"), -1).otherwise(1).alias("sign"))


def surface_centroid(faces: DataFrame) -> DataFrame:
    """Per mesh: area and the area-weighted centre of its faces (null without area)."""
    area = face_area()
    sums = [F.sum(area * (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(f"_{c}") for c in "xyz"]
    got = faces.groupBy("mesh_id").agg(F.sum(area).alias("area"), *sums)
    return got.select("mesh_id", "area", *[F.when(F.col("area") > 0, F.col(f"_{c}") / F.col("area")).alias(f"c{c}") for c in "xyz"])


def ray_hits(faces: DataFrame, rays: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Where lines through points meet triangles: ray_id, mesh_id, face_id, t (in lengths of the direction, negative behind the origin).

    ``rays``: ray_id, ox, oy, oz and the direction dx, dy, dz, any but 0. The determinant test decides; hits within tolerance of an edge count.

    Triangles go to the cells of a grid as fine as themselves, and rays to the cells of all these grids that they pass inside the
    meshes' box: slab by slab along the axis nearest to their direction. A pair that meets in several cells is formed once.
    """
    sound = _sound(faces)
    box = sound.agg(*[f(f"_{x}{c}").alias(f"{x}{c}") for x, f in (("l", F.min), ("h", F.max)) for c in "xyz"]).first()
    low, high = ([float(box[f"{x}{c}"] or 0.0) for c in "xyz"] for x in "lh")
    level = _level(F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in "xyz"]), max(b - a for a, b in zip(low, high)) / (8 * CELLS_ACROSS) or None)
    levels = F.array(*[F.lit(x) for x in _levels(sound, level)]).cast("array<int>")
    size = [F.abs(F.col(f"d{c}")) for c in "xyz"]
    lines = rays.where(F.greatest(*size) > 0).select("ray_id", F.array(*[F.col(f"o{c}").cast("double") for c in "xyz"]).alias("_o"), F.array(*[F.col(f"d{c}").cast("double") for c in "xyz"]).alias("_d"), F.explode(levels).alias("_level"))
    d = [F.abs(F.get("_d", F.lit(i))) for i in range(3)]
    m = F.when((d[0] >= d[1]) & (d[0] >= d[2]), 0).when(d[1] >= d[2], 1).otherwise(2)
    lines = lines.withColumns({"_m": m, "_s": _cell(F.col("_level"))})
    lows, highs = F.array(*map(F.lit, low)), F.array(*map(F.lit, high))
    lines = lines.withColumn("_cm", F.explode(_on_grid(F.get(lows, F.col("_m")), F.get(highs, F.col("_m")), F.col("_s"))))
    for name, axis in (("_ca", (F.col("_m") + 1) % 3), ("_ck", (F.col("_m") + 2) % 3)):
        ends = [F.get("_o", axis) + F.get("_d", axis) * (((F.col("_cm") + k) * F.col("_s") - F.get("_o", F.col("_m"))) / F.get("_d", F.col("_m"))) for k in (0, 1)]
        lo, hi = F.greatest(F.least(*ends), F.get(lows, axis)), F.least(F.greatest(*ends), F.get(highs, axis))
        lines = lines.withColumn(name, F.explode(F.when(lo <= hi + F.col("_s") * 1e-6, _on_grid(lo, F.greatest(lo, hi), F.col("_s")))))
    which = lambda i: F.when(F.col("_m") == i, F.col("_cm")).when((F.col("_m") + 1) % 3 == i, F.col("_ca")).otherwise(F.col("_ck"))
    lines = lines.select("ray_id", "_o", "_d", "_level", *[which(i).alias(f"_c{c}") for i, c in enumerate("xyz")])
    pairs = _in_cells(sound, level).join(lines, ["_level", "_cx", "_cy", "_cz"])
    a, b, c = (corner(None, w) for w in "abc")
    direction = [F.get("_d", F.lit(i)) for i in range(3)]
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(direction, e2)
    det = dot(e1, h)
    inv = 1 / F.when(F.abs(det) > tolerance, det)
    s = sub([F.get("_o", F.lit(i)) for i in range(3)], a)
    u = dot(s, h) * inv
    q = cross(s, e1)
    v = dot(direction, q) * inv
    hits = pairs.withColumn("t", dot(e2, q) * inv).withColumn("_u", u).withColumn("_v", v)
    inside = (F.col("_u") >= -tolerance) & (F.col("_v") >= -tolerance) & (F.col("_u") + F.col("_v") <= 1 + tolerance)
    return hits.where(inside).select("ray_id", "mesh_id", "face_id", "t").dropDuplicates(["ray_id", "mesh_id", "face_id"])


def facing_segments(segments: DataFrame, faces: DataFrame, planes: DataFrame, on: Sequence[str] = (), degrees: float = 60.0) -> DataFrame:
    """The patch segments whose face looks towards the probe: the angle between its outward normal and -ey is at most ``degrees``; with score, its cosine.

    Normals are turned outward per mesh (see outward_sign). Segments of faces without area are left out.
    """
    signs = outward_sign(faces).select("mesh_id", "sign")
    normals = lookup_join(faces.select("mesh_id", "face_id", F.array(*face_normal()).alias("_n")), written(signs), ["mesh_id"], F.col("face_id"), "inner")
    towards = with_frame(planes).select("plane_id", *on, F.col("ey").alias("_ey"))
    both = segments.join(normals, ["mesh_id", "face_id"]).join(towards, ["plane_id", *on])
    score = -F.col("sign") * dot([F.get("_n", F.lit(i)) for i in range(3)], [F.get("_ey", F.lit(i)) for i in range(3)])
    return both.withColumn("score", score).where(F.col("score") >= math.cos(math.radians(degrees))).drop("_n", "_ey", "sign")


def posed_planes(planes: DataFrame, poses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each plane as each pose of the mesh that it shares ``on`` with sees it: in the mesh's own coordinates, with pose_id.

    ``poses``: pose_id, pose (16 numbers, mesh to plane coordinates) and ``on``. Moving the few planes back, not the many triangles
    forth, leaves the mesh as it is, so that all poses of a generation share its cells.
    """
    both = planes.join(poses.select("pose_id", "pose", *on), list(on))
    back = inverse(matrix(F.col("pose")))
    point = transformed(back, [F.get("p0", F.lit(i)) for i in range(3)])
    turned = {e: F.array(*[dot(back[4 * r : 4 * r + 3], [F.get(e, F.lit(i)) for i in range(3)]) for r in range(3)]) for e in ("ex", "ey")}
    return both.withColumns({"p0": F.array(*point), **turned}).drop("pose")


def distinct_planes(planes: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The finite planes that differ in place, direction, size or ``on``, under the least of their plane_ids; and plane_id with ``shape``, that of its like.

    Planes that repeat, as those of a probe that is held or guided, are laid over a mesh once. ``planes``: written, or cheap.
    """
    same = [*on, "p0", "ex", "ey", "width", "height"]
    shapes = written(planes.groupBy(*same).agg(F.min("plane_id").alias("plane_id")))
    return shapes, planes.join(shapes.withColumnRenamed("plane_id", "shape"), same).select("plane_id", "shape")


def distinct_within(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values of each key that are more than ``tolerance`` above the value before; nulls are left out.

    Equal values are reduced before the shuffle; the rest is ordered in parts of a thousand tolerances.
    """
    once = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    at = indexed(once, keys, [value], F.floor(F.col(value) / (1_000 * tolerance)))
    rows, w = with_neighbours(at, keys, 1, 0)
    near = own(rows.withColumn("_p", F.lag(value).over(w)))
    return near.where(F.col("_p").isNull() | (F.col(value) - F.col("_p") > tolerance)).select(*keys, value)


def lift_pixels(col: Column, row: Column, dx: Column, dy: Column, t) -> list[Column]:
    """A pixel of an image plane as a point: ((col - 1) dx, (row - 1) dy, 0), transformed."""
    u, v = (col - 1) * dx, (row - 1) * dy
    return add(add(scale([t[0], t[4], t[8]], u), scale([t[1], t[5], t[9]], v)), [t[3], t[7], t[11]])
