"""Fits of rigid motions, planes and spheres from sums that Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written

#: Rounds of a robust fit; its bound in median residuals; inlier distance of pairs (mm), of a sphere (share of the extent).
ROUNDS, MEDIANS, PAIR_MM, SPHERE_SHARE = 6, 3.0, 100.0, 0.05


def _moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, means and products about them of the columns: two passes, each with partial sums."""
    columns = list(columns)
    known = df.dropna(subset=columns)
    means = written(known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns]))
    centred = lookup_join(known, means, keys, F.hash(*columns), "inner")
    products = [F.sum((F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}"))).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return centred.groupBy(*keys, "n", *[f"m_{c}" for c in columns]).agg(*products)


def rigid_fit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the rigid motion that takes (x, y, z) nearest to (u, v, w): transform (16 numbers), rmse, n and status.

    Fewer than three pairs, or pairs on a line, are skipped (status skipped, transform null). Each key is one row of sums.
    """
    a, b = ("x", "y", "z"), ("u", "v", "w")
    sums = _moments(pairs, keys, [*a, *b])

    def fit(pdfs):
        for pdf in pdfs:
            transforms, errors, states = [], [], []
            for r in pdf.to_dict("records"):
                get = lambda p, q: r.get(f"p_{p}_{q}", r.get(f"p_{q}_{p}"))  # noqa: E731, B023
                cross = np.array([[get(p, q) for q in b] for p in a])
                spread = np.array([[get(p, q) for q in a] for p in a])
                if r["n"] < 3 or np.linalg.matrix_rank(spread, tol=1e-9 * max(np.trace(spread), 1e-12)) < 2:
                    transforms.append(None), errors.append(None), states.append("skipped")
                    continue
                u, s, vt = np.linalg.svd(cross)
                flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
                rotation = vt.T @ flip @ u.T
                move = np.array([r[f"m_{q}"] for q in b]) - rotation @ np.array([r[f"m_{p}"] for p in a])
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rotation, move
                rest = np.trace(spread) + sum(get(q, q) for q in b) - 2 * (s * np.diag(flip)).sum()
                transforms.append(m.ravel().tolist()), errors.append(float(np.sqrt(max(rest, 0) / r["n"]))), states.append("fitted")
            yield pdf[[*keys, "n"]].assign(transform=transforms, rmse=errors, status=states)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, transform array<double>, rmse double, status string")


def plane_fit(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the plane nearest to (x, y, z): n, centre, normal (largest part positive) and rms distance; null for fewer than three points."""
    sums = _moments(points, keys, ["x", "y", "z"])

    def fit(pdfs):
        for pdf in pdfs:
            m = np.zeros((len(pdf), 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    m[:, i, j] = pdf[f"p_{min(p, q)}_{max(p, q)}"]
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0]
            top = np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1)
            normal = normal * np.where(top < 0, -1, 1)
            enough = pdf["n"].to_numpy() >= 3
            rms = np.sqrt(np.maximum(values[:, 0], 0) / pdf["n"].to_numpy())
            yield pdf[[*keys, "n"]].assign(centre=pdf[["m_x", "m_y", "m_z"]].to_numpy().tolist(), normal=[v.tolist() if e else None for v, e in zip(normal, enough)], rms=[float(v) if e else None for v, e in zip(rms, enough)])

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, centre array<double>, normal array<double>, rms double")


def sphere_fit(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the sphere through (x, y, z) by least squares of squared distances: n, centre, radius; null where the points don't span space."""
    known = points.dropna(subset=["x", "y", "z"]).withColumn("s", F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    sums = _moments(known, keys, ["x", "y", "z", "s"])

    def fit(pdfs):
        for pdf in pdfs:
            centres, radii = [], []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"p_{min(p, q)}_{max(p, q)}"] for q in "xyz"] for p in "xyz"])
                if np.linalg.matrix_rank(a, tol=1e-9 * max(np.trace(a), 1e-12)) < 3:
                    centres.append(None), radii.append(None)
                    continue
                c = np.linalg.solve(2 * a, np.array([r[f"p_{p}_s"] for p in "xyz"]))
                mean = np.array([r[f"m_{p}"] for p in "xyz"])
                centres.append(c.tolist()), radii.append(float(np.sqrt(max(r["m_s"] - 2 * c @ mean + c @ c, 0))))
            yield pdf[[*keys, "n"]].assign(centre=centres, radius=radii)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, centre array<double>, radius double")


def principal_axes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the axes of (x, y, z), longest first: n, centre, axes (9 numbers, an axis a row), spread (variances)."""
    sums = _moments(points, keys, ["x", "y", "z"])

    def fit(pdfs):
        for pdf in pdfs:
            m = np.zeros((len(pdf), 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    m[:, i, j] = pdf[f"p_{min(p, q)}_{max(p, q)}"] / pdf["n"]
            values, vectors = np.linalg.eigh(m)
            axes = np.swapaxes(vectors, 1, 2)[:, ::-1]
            top = np.take_along_axis(axes, np.abs(axes).argmax(2)[:, :, None], 2)
            axes = axes * np.where(top < 0, -1, 1)
            yield pdf[[*keys, "n"]].assign(centre=pdf[["m_x", "m_y", "m_z"]].to_numpy().tolist(), axes=axes.reshape(len(pdf), 9).tolist(), spread=values[:, ::-1].tolist())

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, centre array<double>, axes array<double>, spread array<double>")


def _robust(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], DataFrame], residual: Column, least: Column) -> DataFrame:
    """``fit`` repeated ROUNDS times without the rows that the fit before leaves too far: n (all rows), inliers and the rest of the fit.

    A row is too far if its residual is above ``least`` (an aggregate over the key's rows) and MEDIANS times the key's median
    residual. The first fit takes the rows whose numbers all lie within the range of their deciles, widened by itself on both
    sides. Each round starts from all rows, so that one left out by a poor fit comes back. Rows with an infinite number
    are left out, keys without a fit stay as ``fit`` gives them.
    """
    keys = list(keys)
    known = rows.dropna(subset=list(columns))
    for c in columns:
        known = known.where(F.abs(c) < float("inf"))
    known = written(known.select(*keys, *columns))
    deciles = known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.1, 0.9], 1000).alias(f"_d{c}") for c in columns])
    deciles = written(deciles)
    start = lookup_join(known, deciles, keys, F.hash(*columns))
    for c in columns:
        low, high = F.get(f"_d{c}", F.lit(0)), F.get(f"_d{c}", F.lit(1))
        start = start.where(F.col(c).between(2 * low - high, 2 * high - low))
    found = written(fit(start.select(*keys, *columns), keys))
    for _ in range(ROUNDS):
        away = lookup_join(known, found.drop("n"), keys, F.hash(*columns)).withColumn("_r", residual)
        bound = away.groupBy(*keys).agg(F.greatest(least, MEDIANS * F.percentile_approx("_r", 0.5, 1000)).alias("_bound"))
        near = lookup_join(away, bound, keys, F.hash(*columns)).where("_r is null or _r <= _bound")
        found = written(fit(near.select(*keys, *columns), keys))
    return found.withColumnRenamed("n", "inliers").join(deciles.select(*keys, "n"), keys)


def robust_rigid_fit(pairs: DataFrame, keys: Sequence[str], within: float = PAIR_MM) -> DataFrame:
    """rigid_fit without the pairs that lie more than ``within``, and three median residuals, off; n counts all pairs, inliers (and rmse) those that are left."""
    at = lambda i: F.get("transform", F.lit(i))
    off = [at(4 * i) * F.col("x") + at(4 * i + 1) * F.col("y") + at(4 * i + 2) * F.col("z") + at(4 * i + 3) - F.col(c) for i, c in enumerate("uvw")]
    return _robust(pairs, keys, "xyzuvw", rigid_fit, F.sqrt(sum((d * d for d in off), F.lit(0.0))), F.lit(within))


def robust_sphere_fit(points: DataFrame, keys: Sequence[str], share: float = SPHERE_SHARE) -> DataFrame:
    """sphere_fit without the points that are off the sphere by more than ``share`` of the largest extent, and three median residuals.

    The extent is between the 5th and 95th percentile, so that spikes don't widen it. n counts all points, inliers those that are left.
    """
    off = [F.col(c) - F.get("centre", F.lit(i)) for i, c in enumerate("xyz")]
    extent = F.greatest(*[F.percentile_approx(c, 0.95, 1000) - F.percentile_approx(c, 0.05, 1000) for c in "xyz"])
    return _robust(points, keys, "xyz", sphere_fit, F.abs(F.sqrt(sum((d * d for d in off), F.lit(0.0))) - F.col("radius")), share * extent)
