"""Queries of landmarks: meshes over the embeddings' first numbers, bodies' places by region, images' planes and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.operators import landmarks as lm
from kinetra.operators import tracks
from kinetra.operators.common import lookup_join
from kinetra.operators.evidence import Evidence, bone_surfaces
from kinetra.operators.geometry import patch_segments
from kinetra.operators.images import Segmentation
from kinetra.operators.ordered_windows import own, with_neighbours
from kinetra.plans.mesh_queries import _CURVES, _faces, _tilted_planes
from kinetra.plans.tables import table


def _mesh(spark, d):
    """Every seventh embedding is a vertex of one mesh, and a face joins it with the next two, which the last ones lack."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("mesh_id"), F.col("vec_id").alias("vertex_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    v = F.col("vertex_id")
    return e, e.select("mesh_id", v.alias("face_id"), v.alias("v1"), (v + 7).alias("v2"), (v + 14).alias("v3"))


def mesh_faults(spark, d):
    """Per mesh: finite vertices, faces, and faces that name a vertex that isn't there."""
    return lm.mesh_faults(*_mesh(spark, d))


def vertex_normals(spark, d):
    """The normal of each vertex: that of the last face that has it."""
    got = lm.vertex_normals(*_mesh(spark, d))
    return got.select("vertex_id", *[F.round(F.get("normal", F.lit(i)), 5).alias(f"n{c}") for i, c in enumerate("xyz")])


def mesh_cut(spark, d):
    """Per mesh: triangles that lie wholly, and in part, between 20 and 60 percent of its height."""
    faces = _faces(spark, d)
    counts = [lm.cut_by_percent(faces, "z", 20.0, 60.0, whole).groupBy("mesh_id").agg(F.count("*").alias(n)) for whole, n in ((True, "whole"), (False, "part"))]
    return counts[0].join(counts[1], "mesh_id", "full").fillna(0)


def shaft_band(spark, d):
    """Per mesh: the middle of its vertices in a band."""
    got = lm.band_centroid(_mesh(spark, d)[0], ["mesh_id"], F.col("z"), F.lit(-0.05), F.lit(0.1), 0.001)
    return got.select("mesh_id", "n", *[F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"])


def mesh_sections(spark, d):
    """Per mesh: its widest of ten sections along z, and where it is at least half as wide."""
    got = lm.widest_section(lm.sections(_mesh(spark, d)[0], "z", 10))
    return got.withColumn("area", F.round("area", 7))


def nearest_vertex_along(spark, d):
    """Per line: the vertex of its mesh that is nearest to it, ahead of its origin."""
    n = F.col("n_nationkey")
    direction = F.array(F.cos(0.5 * n) * 0.8, F.sin(0.5 * n) * 0.8, F.lit(0.6))
    lines = table(spark, d, "nation").select(n.alias("line_id"), (n % 7).cast("bigint").alias("mesh_id"), F.array(F.lit(0.0), F.lit(0.01), F.lit(-0.02)).alias("o"), direction.alias("d"))
    got = lm.nearest_along(_mesh(spark, d)[0], lines, ["mesh_id"])
    return got.select("line_id", "vertex_id", F.round("t", 6).alias("t"), F.round("away", 6).alias("away"))


def points_to_landmarks(spark, d):
    """Per bone and region: places of a body, and their mean distance from the region's landmark, which is their middle."""
    s = table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max(F.upper("bone")).alias("bone"), F.max("group_name").alias("group_name"))
    region = s.select("session_id", "bone", lm.region_of(F.col("group_name")).alias("region"))
    places = [F.col(f"A_F_GTR_t{i}") for i in (1, 2, 3)]
    seen = table(spark, d, "tracking").select("reading_id", "session_id", *[p.alias(c) for p, c in zip(places, "xyz")]).where("not (isnan(x) or isnan(y) or isnan(z)) and x is not null and y is not null and z is not null")
    points = lookup_join(seen.dropDuplicates(["reading_id"]), region, ["session_id"], F.col("reading_id"), "inner")
    marks = points.groupBy("bone", "region").agg(*[F.avg(c).alias(f"l{c}") for c in "xyz"])
    return lm.with_landmark(points, marks).groupBy("bone", "region").agg(F.count("*").alias("n"), F.round(F.avg("away"), 3).alias("mean_away"))


def image_quads(spark, d):
    """The corners of each packet's image in space, half a millimetre a pixel."""
    p = table(spark, d, "packets").where("size(probe_t) = 16 and forall(probe_t, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").dropDuplicates(["packet_id"])
    plane = p.withColumns(lm.finite_plane([F.get("probe_t", F.lit(i)) for i in range(16)], F.col("width"), F.col("height"), F.lit(0.5), F.lit(0.5)))
    corners = lm.quad_corners(*[[F.get(c, F.lit(i)) for i in range(3)] for c in ("p0", "ex", "ey")], F.col("width"), F.col("height"))
    return plane.select("packet_id", *[F.round(x, 4).alias(f"{c}{k}") for k, corner in enumerate(corners, 1) for c, x in zip("xyz", corner)])


def track_gradient(spark, d):
    """The central difference of a coordinate along each session, its border going on outside."""
    have = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", "A_F_MID_t1").where("A_F_MID_t1 is not null and not isnan(A_F_MID_t1)")
    rows, w = with_neighbours(tracks.timed(have, "session_id", "utc_epoch_ms", "reading_id"), ["session_id"], 1, 1)
    v = F.col("A_F_MID_t1")
    ahead, behind = F.coalesce(F.lead(v).over(w), v), F.coalesce(F.lag(v).over(w), v)
    rows = own(rows.withColumns({"_g": (ahead - behind) / 2, "_l": ahead - 2 * v + behind}))
    return rows.select("reading_id", F.round("_g", 6).alias("gradient"), F.round("_l", 6).alias("laplacian"))


def recording_times(spark, d):
    """Per day of recording: weekday, week, files, the first and the last hour, and the minutes between first and last."""
    files = table(spark, d, "qtm_raw").where("file_id is not null").groupBy("file_id").agg(F.min(F.col("recorded_at").cast("timestamp_ntz")).alias("at")).where("at is not null")
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    got = files.groupBy(day).agg(F.count("*").alias("files"), F.min("at").alias("a"), F.max("at").alias("b"))
    return got.select("day", (F.weekday(F.col("day").cast("date")) + 1).alias("weekday"), F.weekofyear(F.col("day").cast("date")).alias("week"), "files", F.hour("a").alias("first_hour"), F.hour("b").alias("last_hour"), F.expr("timestampdiff(MINUTE, a, b)").alias("minutes"))


def image_curves(spark, d):
    """Per tilted plane: curves that the cuts of triangles form in it, and their points."""
    cut = patch_segments(_faces(spark, d), _tilted_planes(spark, d)).select("plane_id", "u0", "v0", "u1", "v1")
    return lm.ordered_curves(cut, ["plane_id"], 1e-9).groupBy("plane_id").agg(F.countDistinct("curve").alias("curves"), F.count("*").alias("points"))


def bone_surface_paths(spark, d):
    """The bone surface in each packet's image: its depth and confidence in every column."""
    images = table(spark, d, "packets").select("packet_id", "width", "height", "image").dropDuplicates(["packet_id"])
    return bone_surfaces(images, "packet_id", 0.5, 0.5, Evidence(least_length=1.0, least_confidence=0.0), Segmentation(min_area=1))


_MODULE = (mesh_faults, vertex_normals, mesh_cut, shaft_band, mesh_sections, nearest_vertex_along, points_to_landmarks, image_quads, track_gradient, recording_times, image_curves, bone_surface_paths)
QUERIES = {f.__name__: f for f in _MODULE}

_E = "e AS (SELECT vec_id % 7 AS mesh_id, vec_id AS vertex_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_F9 = "f AS (SELECT CAST(label AS TEXT) AS mesh_id, embedding[9 * o + 3]::DOUBLE AS z1, embedding[9 * o + 6]::DOUBLE AS z2, embedding[9 * o + 9]::DOUBLE AS z3 FROM embeddings, range(6) r(o))"
_M = [f"probe_t[{i}]" for i in range(1, 17)]
_CORNERS = ", ".join(
    f"round({_M[4 * i + 3]} + {_M[4 * i]} * {a} * 0.5 * width + {_M[4 * i + 1]} * {b} * 0.5 * height, 4) AS {c}{k}"
    for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1)
    for i, c in enumerate("xyz")
)
SQL = {
    "mesh_faults": f"WITH {_E}, f AS (SELECT mesh_id, vertex_id, EXISTS (SELECT 1 FROM e b WHERE b.vertex_id = e.vertex_id + 7) AND EXISTS (SELECT 1 FROM e b WHERE b.vertex_id = e.vertex_id + 14) AS whole FROM e) "
    "SELECT mesh_id, count(*) AS n_vertices, count(*) AS n_faces, count(*) FILTER (NOT whole) AS n_lost, count(*) >= 4 AND count(*) FILTER (NOT whole) = 0 AS valid FROM f GROUP BY 1",
    "vertex_normals": f"WITH {_E}, t AS (SELECT a.vertex_id AS face_id, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS wx, c.y - a.y AS wy, c.z - a.z AS wz FROM e a JOIN e b ON b.vertex_id = a.vertex_id + 7 JOIN e c ON c.vertex_id = a.vertex_id + 14), "
    "n AS (SELECT face_id, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM t), "
    "v AS (SELECT face_id + o AS vertex_id, face_id, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n, (VALUES (0), (7), (14)) k(o)), "
    "m AS (SELECT vertex_id, max(face_id) AS face_id FROM v WHERE l > 0 GROUP BY 1) SELECT vertex_id, round(nx / l, 5) AS nx, round(ny / l, 5) AS ny, round(nz / l, 5) AS nz FROM v JOIN m USING (vertex_id, face_id)",
    "mesh_cut": f"WITH {_F9}, r AS (SELECT mesh_id, min(least(z1, z2, z3)) AS lo, max(greatest(z1, z2, z3)) AS hi FROM f GROUP BY 1), i AS (SELECT mesh_id, "
    + ", ".join(f"(z{k} BETWEEN lo + (hi - lo) * 0.2 AND lo + (hi - lo) * 0.6) AS i{k}" for k in (1, 2, 3))
    + " FROM f JOIN r USING (mesh_id)) SELECT mesh_id, count(*) FILTER (i1 AND i2 AND i3) AS whole, count(*) FILTER (i1 OR i2 OR i3) AS part FROM i GROUP BY 1",
    "shaft_band": f"WITH {_E} SELECT mesh_id, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM e WHERE z BETWEEN -0.051 AND 0.101 GROUP BY 1 HAVING count(*) >= 3",
    "mesh_sections": f"WITH {_E}, r AS (SELECT mesh_id, min(z) AS lo, max(z) AS hi FROM e GROUP BY 1), b AS (SELECT mesh_id, x, y, CAST(least(floor((z - lo) / (hi - lo) * 10) + 1, 10) AS INT) AS bin FROM e JOIN r USING (mesh_id)), "
    "s AS (SELECT mesh_id, bin, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM b GROUP BY 1, 2), t AS (SELECT mesh_id, max(area) AS top FROM s GROUP BY 1) "
    "SELECT mesh_id, min(bin) FILTER (area = top) AS widest, round(max(area), 7) AS area, min(bin) FILTER (area >= top / 2) AS first_half, max(bin) FILTER (area >= top / 2) AS last_half FROM s JOIN t USING (mesh_id) GROUP BY 1",
    "nearest_vertex_along": f"WITH {_E}, l AS (SELECT n_nationkey AS line_id, n_nationkey % 7 AS mesh_id, cos(0.5 * n_nationkey) * 0.8 AS d1, sin(0.5 * n_nationkey) * 0.8 AS d2, 0.6 AS d3 FROM nation), "
    "o AS (SELECT line_id, vertex_id, x AS a, y - 0.01 AS b, z + 0.02 AS c, d1, d2, d3 FROM e JOIN l USING (mesh_id)), t AS (SELECT *, a * d1 + b * d2 + c * d3 AS t, sqrt((b * d3 - c * d2) ** 2 + (c * d1 - a * d3) ** 2 + (a * d2 - b * d1) ** 2) AS away FROM o), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY away, vertex_id) AS k FROM t WHERE t >= 0) SELECT line_id, vertex_id, round(t, 6) AS t, round(away, 6) AS away FROM k WHERE k = 1",
    "points_to_landmarks": "WITH r AS (SELECT DISTINCT ON (reading_id) * FROM tracking ORDER BY reading_id), s AS (SELECT session_id, max(upper(bone)) AS bone, max(group_name) AS g FROM sessions WHERE session_id IS NOT NULL GROUP BY 1), "
    "q AS (SELECT session_id, bone, CASE lower(split_part(g, '_', -1)) WHEN 'mid' THEN 'shaft' ELSE lower(split_part(g, '_', -1)) END AS region FROM s), "
    "p AS (SELECT bone, region, A_F_GTR_t1 AS x, A_F_GTR_t2 AS y, A_F_GTR_t3 AS z FROM r JOIN q USING (session_id) WHERE NOT isnan(A_F_GTR_t1) AND NOT isnan(A_F_GTR_t2) AND NOT isnan(A_F_GTR_t3) AND bone IS NOT NULL AND region IS NOT NULL), "
    "m AS (SELECT bone, region, avg(x) AS a, avg(y) AS b, avg(z) AS c FROM p GROUP BY 1, 2) SELECT bone, region, count(*) AS n, round(avg(sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2)), 3) AS mean_away FROM p JOIN m USING (bone, region) GROUP BY 1, 2",
    "image_quads": f"WITH p AS (SELECT DISTINCT ON (packet_id) * FROM packets WHERE len(probe_t) = 16 AND len(list_filter(probe_t, lambda x: x IS NULL OR NOT isfinite(x))) = 0 ORDER BY packet_id) SELECT packet_id, {_CORNERS} FROM p",
    "track_gradient": "WITH r AS (SELECT DISTINCT ON (reading_id) * FROM tracking ORDER BY reading_id), v AS (SELECT reading_id, A_F_MID_t1 AS v, coalesce(lead(A_F_MID_t1) OVER w, A_F_MID_t1) AS a, coalesce(lag(A_F_MID_t1) OVER w, A_F_MID_t1) AS b FROM r WHERE session_id IS NOT NULL AND A_F_MID_t1 IS NOT NULL AND NOT isnan(A_F_MID_t1) WINDOW w AS (PARTITION BY session_id ORDER BY utc_epoch_ms, reading_id)) "
    "SELECT reading_id, round((a - b) / 2, 6) AS gradient, round(a - 2 * v + b, 6) AS laplacian FROM v",
    "recording_times": "WITH f AS (SELECT file_id, min(recorded_at) AS t FROM qtm_raw WHERE file_id IS NOT NULL GROUP BY 1) SELECT strftime(t, '%Y-%m-%d') AS day, CAST(isodow(any_value(t)) AS INT) AS weekday, CAST(weekofyear(any_value(t)) AS INT) AS week, count(*) AS files, CAST(hour(min(t)) AS INT) AS first_hour, CAST(hour(max(t)) AS INT) AS last_hour, "
    "CAST(floor(epoch(max(t) - min(t)) / 60) AS BIGINT) AS minutes FROM f WHERE t IS NOT NULL GROUP BY 1",
    "image_curves": _CURVES + " SELECT plane_id, count(*) AS curves, 2 * count(*) AS points FROM c GROUP BY 1",
}
