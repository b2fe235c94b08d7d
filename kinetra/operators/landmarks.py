"""Landmarks of meshes: normals of vertices, cuts, bands, sections along an axis, nearest vertices, points by region, and ordered curves."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions.linalg import Vec, add, cross, dot, norm, scale, sub
from kinetra.operators.common import lookup_join, written
from kinetra.operators.geometry import corner, face_normal, triangles


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vertex_id and normal of every vertex that a face with area has: the unit normal of the last such face (largest face_id)."""
    n = face_normal()
    normals = triangles(vertices, faces).select("mesh_id", "face_id", F.array(*n).alias("_n")).where(F.get("_n", F.lit(0)).isNotNull())
    corners = faces.select("mesh_id", "face_id", F.explode(F.array_distinct(F.array("v1", "v2", "v3"))).alias("vertex_id"))
    return corners.join(normals, ["mesh_id", "face_id"]).groupBy("mesh_id", "vertex_id").agg(F.max_by("_n", "face_id").alias("normal"))


def mesh_faults(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Per mesh: vertices that are finite, faces, faces that name a vertex that isn't there, and whether it is a mesh at all (four finite vertices, a face, no such faces)."""
    finite = F.lit(True)
    for c in "xyz":
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = vertices.groupBy("mesh_id").agg(F.count_if(F.coalesce(finite, F.lit(False))).alias("n_vertices"))
    named = faces.select("mesh_id", "face_id", F.explode(F.array("v1", "v2", "v3")).alias("vertex_id")).join(vertices.select("mesh_id", "vertex_id", F.lit(1).alias("_there")), ["mesh_id", "vertex_id"], "left")
    per_face = named.groupBy("mesh_id", "face_id").agg(F.max(F.col("_there").isNull()).alias("_lost"))
    counts = per_face.groupBy("mesh_id").agg(F.count("*").alias("n_faces"), F.count_if("_lost").alias("n_lost"))
    both = points.join(counts, "mesh_id", "full").fillna(0, ["n_vertices", "n_faces", "n_lost"])
    return both.withColumn("valid", (F.col("n_vertices") >= 4) & (F.col("n_faces") > 0) & (F.col("n_lost") == 0))


def _range(faces: DataFrame, axis: str) -> DataFrame:
    values = [F.col(f"{w}{axis}") for w in "abc"]
    return written(faces.groupBy("mesh_id").agg(F.min(F.least(*values)).alias("_low"), F.max(F.greatest(*values)).alias("_high")))


def cut_by_percent(faces: DataFrame, axis: str, low: float, high: float, whole: bool = True) -> DataFrame:
    """The triangles of each mesh with all corners (``whole``) or any corner between two percentages of its extent along an axis, both included."""
    ranged = lookup_join(faces, _range(faces, axis), ["mesh_id"], F.col("face_id"), "inner")
    edge = [F.col("_low") + (F.col("_high") - F.col("_low")) * p / 100 for p in (low, high)]
    inside = [F.col(f"{w}{axis}").between(*edge) for w in "abc"]
    keep = inside[0] & inside[1] & inside[2] if whole else inside[0] | inside[1] | inside[2]
    return ranged.where(keep).drop("_low", "_high")


def band_centroid(points: DataFrame, keys: Sequence[str], along: Column, low: Column, high: Column, tolerance: float = 0.0) -> DataFrame:
    """Per key the mean (cx, cy, cz) and number of its points (x, y, z) whose place along an axis lies in a band; keys with fewer than three aren't given."""
    held = points.where(along.between(low - tolerance, high + tolerance))
    got = held.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    return got.where("n >= 3")


def sections(points: DataFrame, axis: str, bins: int) -> DataFrame:
    """Per mesh and bin of its extent along an axis (1 to ``bins``, the last closed): n points and the area of the box around them across the axis."""
    u, v = [c for c in "xyz" if c != axis]
    limits = written(points.groupBy("mesh_id").agg(F.min(axis).alias("_low"), F.max(axis).alias("_high")))
    share = F.when(F.col("_high") > F.col("_low"), (F.col(axis) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    binned = lookup_join(points, limits, ["mesh_id"], F.col(axis), "inner").withColumn("bin", F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int"))
    return binned.groupBy("mesh_id", "bin").agg(F.count("*").alias("n"), ((F.max(u) - F.min(u)) * (F.max(v) - F.min(v))).alias("area"))


def widest_section(sectioned: DataFrame) -> DataFrame:
    """Per mesh the widest bin (the first of equals), its area, and the first and last bin with at least half of it."""
    top = sectioned.groupBy("mesh_id").agg(F.max(F.struct("area", -F.col("bin"))).alias("_top"))
    half = sectioned.join(top, "mesh_id").where(F.col("area") >= F.col("_top.area") / 2)
    return half.groupBy("mesh_id", "_top").agg(F.min("bin").alias("first_half"), F.max("bin").alias("last_half")).select("mesh_id", (-F.col("_top")["col2"]).alias("widest"), F.col("_top.area").alias("area"), "first_half", "last_half")


def nearest_along(points: DataFrame, lines: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per line the point nearest to it among those not behind its origin: line_id, vertex_id, t (along), away (from the line); the least vertex_id of equals.

    ``lines``: line_id, ``on`` (as the mesh), o and d (arrays of three, d of length 1). ``points``: ``on``, vertex_id, x, y, z.
    """
    o, d = ([F.get(c, F.lit(i)) for i in range(3)] for c in ("o", "d"))
    both = lookup_join(points, lines, on, F.col("vertex_id"), "inner")
    off = sub([F.col(c) for c in "xyz"], o)
    both = both.withColumn("t", dot(off, d)).where("t >= 0").withColumn("away", norm(cross(off, d)))
    best = both.groupBy("line_id").agg(F.min(F.struct("away", "vertex_id", "t")).alias("_b"))
    return best.select("line_id", "_b.vertex_id", "_b.t", "_b.away")


def angled_directions(x: Vec, z: Vec, degrees: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Directions in the plane of two axes: sin X - cos Z and sin X + cos Z of an angle, and cos X - sin Z along a shaft."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return sub(scale(x, s), scale(z, c)), add(scale(x, s), scale(z, c)), sub(scale(x, c), scale(z, s))


def region_of(group_name: Column) -> Column:
    """The region in a group's name: what stands after its last _, in small letters; mid means the shaft."""
    last = F.lower(F.element_at(F.split(group_name, "_"), -1))
    return F.when(last == "mid", "shaft").otherwise(last)


def with_landmark(points: DataFrame, landmarks: DataFrame, keys: Sequence[str] = ("bone", "region")) -> DataFrame:
    """Every point with the landmark (lx, ly, lz) of its bone and region, and away, the distance; points without one are left out."""
    both = lookup_join(points, landmarks, keys, F.hash("x", "y", "z"), "inner")
    return both.withColumn("away", norm([F.col(c) - F.col(f"l{c}") for c in "xyz"]))


def orthonormalised(matrix: Column) -> Column:
    """Of 16 numbers (rotation with scale): struct of pose (16 numbers, the nearest proper rotation) and scale (the three columns' lengths); null for a wrong length."""

    @F.pandas_udf("pose array<double>, scale array<double>")
    def nearest(matrices: pd.Series) -> pd.DataFrame:
        out = []
        for m in matrices:
            if m is None or len(m) != 16 or not np.isfinite(np.asarray(m, float)).all():
                out.append((None, None))
                continue
            t = np.array(m, float).reshape(4, 4)
            lengths = np.linalg.norm(t[:3, :3], axis=0)
            u, _, vt = np.linalg.svd(t[:3, :3])
            r = u @ vt
            if np.linalg.det(r) < 0:
                r[:, 2] *= -1
            t[:3, :3] = r
            out.append((t.ravel().tolist(), lengths.tolist()))
        return pd.DataFrame(out, columns=["pose", "scale"])

    return nearest(matrix)


def finite_plane(pose: Sequence[Column], columns: Column, rows: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """An image's plane in space: p0 (its first corner), ex, ey, width and height, from its pose (16 numbers) and its pixels' sizes."""
    e = [[pose[4 * r + c] for r in range(3)] for c in (0, 1, 3)]
    return {"p0": F.array(*e[2]), "ex": F.array(*e[0]), "ey": F.array(*e[1]), "width": columns * dx, "height": rows * dy}


def quad_corners(p0: Vec, ex: Vec, ey: Vec, width: Column, height: Column) -> list[list[Column]]:
    """The four corners of a plane's rectangle, in turn."""
    across, down = scale(ex, width), scale(ey, height)
    return [list(p0), add(p0, across), add(add(p0, across), down), add(p0, down)]


def axis_turn(axis: str, degrees: Column) -> list[Column]:
    """The transform (16 numbers) that turns about the x, y or z axis."""
    i = "xyz".index(axis)
    j, k = (i + 1) % 3, (i + 2) % 3
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    m = [[F.lit(1.0 if a == b else 0.0) for b in range(4)] for a in range(4)]
    m[j][j], m[j][k], m[k][j], m[k][k] = c, -s, s, c
    return [x for row in m for x in row]


def masked(pixels: DataFrame, area: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixels that lie in the area of their frame: a semi join on keys, row and col; an area may be of any size."""
    return pixels.join(area.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_semi")


def component_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node and component: the smallest node that edges (keys, a, b) join it with. For graphs of any size.

    Each round every node takes the smallest label among its neighbours, then that label's own label (a jump), until none
    changes; rounds grow with the logarithm of the longest way, and a written table cuts the plan.
    """
    keys = list(keys)
    both = written(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "_near"}), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_low"))
        jump = labels.select(*keys, F.col("node").alias("_low"), F.col("label").alias("_jump"))
        now = written(low.join(jump, [*keys, "_low"]).select(*keys, "node", "_old", F.least("_low", "_jump").alias("label")))
        labels = now.select(*keys, "node", "label")
        if now.where("_old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def order_nodes(points: dict[int, tuple[float, float]], edges: list[tuple[int, int]]) -> list[int]:
    """The nodes of one connected curve in order: from an end (the leftmost; of a closed curve its leftmost node), always on to the straightest neighbour not yet passed."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    ends = [n for n in points if len(near[n]) <= 1] or list(points)
    at = min(ends, key=lambda n: (points[n], n))
    out, before = [at], None
    passed = {at}
    while True:
        free = sorted(near[at] - passed)
        if not free:
            return out
        if before is None:
            nxt = min(free, key=lambda n: (points[n], n))
        else:
            here, come = np.array(points[at]), np.array(points[at]) - np.array(points[before])

            def straight(n: int) -> float:
                go = np.array(points[n]) - here
                size = math.hypot(*come) * math.hypot(*go)
                return float(come @ go / size) if size else -1.0

            nxt = max(free, key=lambda n: (straight(n), -n))
        before, at = at, nxt
        passed.add(at)
        out.append(at)


def ordered_curves(segments: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Points of the curves that segments (u0, v0, u1, v1) of each key, as an image plane, form: keys, curve, place (from 0), u, v.

    Ends in one cell of a grid of ``tolerance`` are one node, at their mean. Curves are connected components (see component_labels), numbered by their
    smallest node; each is put in order by itself (see order_nodes), a group of one curve in one image. Nodes that only a branch reaches are left out.
    """
    keys = list(keys)
    cell = lambda u, v: F.struct(F.round(F.col(u) / tolerance).cast("bigint").alias("i"), F.round(F.col(v) / tolerance).cast("bigint").alias("j"))
    ends = segments.select(*keys, cell("u0", "v0").alias("_a"), cell("u1", "v1").alias("_b"), "u0", "v0", "u1", "v1")
    single = ends.select(*keys, F.col("_a").alias("_c"), F.col("u0").alias("u"), F.col("v0").alias("v")).unionByName(ends.select(*keys, F.col("_b").alias("_c"), F.col("u1").alias("u"), F.col("v1").alias("v")))
    # a cell's number is its place among the cells of its key; an image has as many as its segments at most
    nodes = written(single.groupBy(*keys, "_c").agg(F.avg("u").alias("u"), F.avg("v").alias("v")).withColumn("node", F.row_number().over(Window.partitionBy(*keys).orderBy("_c"))))
    number = nodes.select(*keys, "_c", "node")
    edges = ends.select(*keys, "_a", "_b").distinct().join(number.withColumnsRenamed({"_c": "_a", "node": "a"}), [*keys, "_a"]).join(number.withColumnsRenamed({"_c": "_b", "node": "b"}), [*keys, "_b"]).select(*keys, "a", "b")
    edges = written(edges)
    labels = written(component_labels(edges, keys))
    placed = nodes.join(labels, [*keys, "node"]).select(*keys, "component", "node", "u", "v", F.lit(None).cast("int").alias("b"))
    linked = edges.join(labels.withColumnRenamed("node", "a"), [*keys, "a"]).select(*keys, "component", F.col("a").alias("node"), F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("v"), "b")
    kinds = dict(segments.dtypes)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[pdf.b.isna()]
        points = {int(n): (float(u), float(v)) for n, u, v in zip(at.node, at.u, at.v)}
        way = order_nodes(points, [(int(a), int(b)) for a, b in zip(pdf.node[pdf.b.notna()], pdf.b[pdf.b.notna()])])
        first = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**first, "curve": int(pdf.component.iloc[0]), "place": range(len(way)), "u": [points[n][0] for n in way], "v": [points[n][1] for n in way]})

    return placed.unionByName(linked).groupBy(*keys, "component").applyInPandas(order, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", curve int, place int, u double, v double")


def level_points(curves: DataFrame, keys: Sequence[str], degrees: float) -> DataFrame:
    """Points of ordered curves whose tangent (from the point before to the one after) is within an angle of the horizontal; points without length are left out."""
    w = Window.partitionBy(*keys, "curve").orderBy("place")  # a curve in one image
    du, dv = (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "uv")
    steep = curves.withColumns({"_du": du, "_dv": dv})
    flat = F.abs("_du") >= math.cos(math.radians(degrees)) * F.hypot("_du", "_dv")
    return steep.where(flat & ((F.col("_du") != 0) | (F.col("_dv") != 0))).drop("_du", "_dv")
