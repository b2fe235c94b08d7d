"""Queries of images, fits and optimisation; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetra.operators.common import written
from kinetra.operators.images import Segmentation, segmented, surfaces
from kinetra.operators.optimise import evolve
from kinetra.operators.registration import plane_fit, principal_axes, robust_rigid_fit, robust_sphere_fit
from kinetra.plans.tables import table


def _once(spark, d, *columns):
    return table(spark, d, "tracking").select("reading_id", *columns).dropDuplicates(["reading_id"])


def _images(spark, d):
    return table(spark, d, "packets").select("packet_id", "width", "height", "image").dropDuplicates(["packet_id"])


def image_segmentation(spark, d):
    """Threshold, pixels, edge and blobs of each packet's image."""
    return segmented(_images(spark, d), "packet_id", Segmentation(min_area=2))


def surface_paths(spark, d):
    """The brightest smooth way through each packet's image."""
    return surfaces(_images(spark, d), "packet_id").select("packet_id", "n_columns", "rows")


def _body(spark, d, body):
    t = [F.when(~F.isnan(f"{body}_t{i}"), F.col(f"{body}_t{i}")).alias(c) for i, c in zip((1, 2, 3), "xyz")]
    return _once(spark, d, "session_id", "station", *[f"{body}_t{i}" for i in (1, 2, 3)]).where("session_id is not null").select("session_id", "station", "reading_id", *t)


def rigid_registration(spark, d):
    """Per session the rigid motion from one body's places to another's, without outliers."""
    from_to = [(f"{b}_t{i}", c) for b, names in (("A_T_MEP", "xyz"), ("B_N_REF", "uvw")) for i, c in zip((1, 2, 3), names)]
    pairs = _once(spark, d, "session_id", *[c for c, _ in from_to]).where("session_id is not null").select("session_id", *[F.when(~F.isnan(c), F.col(c)).alias(n) for c, n in from_to])
    found = robust_rigid_fit(pairs, ["session_id"])
    return found.select("session_id", "n", "inliers", "status", F.round("rmse", 4).alias("rmse"), F.transform("transform", lambda x: F.round(x, 5)).alias("transform"))


def plane_of_track(spark, d):
    """Per session the plane nearest to a body's places: its middle, its normal's sizes along the axes, and the distance from it."""
    got = plane_fit(_body(spark, d, "A_T_MEP"), ["session_id"])
    middle = [F.round(F.get("centre", F.lit(i)), 4).alias(f"c{c}") for i, c in enumerate("xyz")]
    return got.select("session_id", "n", F.round("rms", 2).alias("rms"), *middle, *[F.round(F.abs(F.get("normal", F.lit(i))), 3).alias(f"n{c}") for i, c in enumerate("xyz")])


def sphere_of_track(spark, d):
    """Per station the sphere nearest to a body's places, without outliers."""
    return robust_sphere_fit(_body(spark, d, "A_T_MEP").where("station is not null"), ["station"]).select("station", "n", "inliers", F.round("radius", 2).alias("radius"), F.transform("centre", lambda x: F.round(x, 2)).alias("centre"))


def axes_of_track(spark, d):
    """Per station the spread of a body's places along their axes."""
    return principal_axes(_body(spark, d, "A_T_MEP").where("station is not null"), ["station"]).select("station", "n", *[F.round(F.get("spread", F.lit(i)), 2).alias(f"var{i + 1}") for i in range(3)], *[F.round(F.abs(F.get("axes", F.lit(i))), 3).alias(f"long_{c}") for i, c in enumerate("xyz")])


def median_places(spark, d):
    """Per station the place with the least mean distance to a body's places (its geometric median), by evolution.

    Places are counted on a 10 mm grid first, so that each generation reads cells and not readings.
    """
    half = lambda c: (F.floor(F.col(c) / 10) * 10 + 5).alias(c)
    cells = written(_body(spark, d, "A_F_MID").dropna(subset=["station", "x", "y"]).select("station", half("x"), half("y")).groupBy("station", "x", "y").agg(F.count("*").alias("n")))

    def objective(candidates):
        away = F.sqrt(F.pow(F.get("candidates.x", F.lit(0)) - F.col("cells.x"), 2) + F.pow(F.get("candidates.x", F.lit(1)) - F.col("cells.y"), 2))
        pairs = candidates.withColumn("station", F.substring_index("run", "#", 1)).alias("candidates").join(cells.alias("cells"), F.col("candidates.station") == F.col("cells.station"))
        return pairs.groupBy("candidates.run", "candidates.candidate").agg((F.sum(away * F.col("cells.n")) / F.sum("cells.n")).alias("cost"))

    runs = cells.select(F.col("station").alias("run")).distinct().withColumn("seed", F.lit(7))
    box = cells.agg(*[f(c) for f in (F.min, F.max) for c in "xy"]).first()
    low, high = ([float(x or 0.0) for x in box[k : k + 2]] for k in (0, 2))
    best = evolve(runs, objective, low, [max(a + 1.0, b) for a, b in zip(low, high)], population=10, generations=25)
    return best.select(F.col("run").alias("station"), *[F.round(F.get("best", F.lit(i)), 1).alias(c) for i, c in enumerate("xy")], F.round("best_cost", 1).alias("mean_away"))


_MODULE = (image_segmentation, surface_paths, rigid_registration, plane_of_track, sphere_of_track, axes_of_track, median_places)
QUERIES = {f.__name__: f for f in _MODULE}


def _eigen(key: str) -> str:
    """CTE e: per key n, the means cx ... and the eigenvalues l1 >= l2 >= l3 of the covariance of a body's places, by the closed form."""
    v = ", ".join(f"CASE WHEN NOT isnan(A_T_MEP_t{i}) THEN A_T_MEP_t{i} END AS {c}" for i, c in zip((1, 2, 3), "xyz"))
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return (
        f"r AS (SELECT DISTINCT ON (reading_id) * FROM tracking ORDER BY reading_id), v AS (SELECT {key}, {v} FROM r WHERE session_id IS NOT NULL AND {key} IS NOT NULL), "
        f"p AS (SELECT {key}, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, " + ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in pairs) + " FROM v WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1), "
        "q AS (SELECT *, (xx + yy + zz) / 3 AS t FROM p), g AS (SELECT *, sqrt(((xx - t) ** 2 + (yy - t) ** 2 + (zz - t) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS s FROM q), "
        "h AS (SELECT *, acos(greatest(least((((xx - t) * ((yy - t) * (zz - t) - yz * yz) - xy * (xy * (zz - t) - yz * xz) + xz * (xy * yz - (yy - t) * xz)) / s ** 3) / 2, 1), -1)) / 3 AS phi FROM g), "
        "e AS (SELECT *, t + 2 * s * cos(phi) AS l1, t + 2 * s * cos(phi + 2 * pi() / 3) AS l3, 3 * t - (t + 2 * s * cos(phi)) - (t + 2 * s * cos(phi + 2 * pi() / 3)) AS l2 FROM h)"
    )


def _vector(value: str) -> str:
    """CTE w: the sizes a1, a2, a3 of the eigenvector's parts, from the longest cross product of two rows of the matrix minus the eigenvalue."""
    rows = (("(xx - L)", "xy", "xz"), ("xy", "(yy - L)", "yz"), ("xz", "yz", "(zz - L)"))
    cross = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        a, b = rows[i], rows[j]
        cross.append([f"({a[(k + 1) % 3]} * {b[(k + 2) % 3]} - {a[(k + 2) % 3]} * {b[(k + 1) % 3]})".replace("L", value) for k in range(3)])
    n = [" + ".join(f"{x} ** 2" for x in c) for c in cross]
    pick = lambda k: f"CASE WHEN n1 >= n2 AND n1 >= n3 THEN abs({cross[0][k]}) / sqrt(n1) WHEN n2 >= n3 THEN abs({cross[1][k]}) / sqrt(n2) ELSE abs({cross[2][k]}) / sqrt(n3) END"
    return f"nn AS (SELECT *, {n[0]} AS n1, {n[1]} AS n2, {n[2]} AS n3 FROM e), w AS (SELECT *, {', '.join(f'{pick(k)} AS a{k + 1}' for k in range(3))} FROM nn)"


SQL: dict[str, str] = {
    "plane_of_track": f"WITH {_eigen('session_id')}, {_vector('l3')} SELECT session_id, n, CASE WHEN n >= 3 THEN round(sqrt(greatest(l3, 0)), 2) END AS rms, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz, round(a1, 3) AS nx, round(a2, 3) AS ny, round(a3, 3) AS nz FROM w",
    "axes_of_track": f"WITH {_eigen('station')}, {_vector('l1')} SELECT station, n, round(l1, 2) AS var1, round(l2, 2) AS var2, round(l3, 2) AS var3, round(a1, 3) AS long_x, round(a2, 3) AS long_y, round(a3, 3) AS long_z FROM w",
}
