"""Tracked bodies over time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions import linalg as la
from kinetra.functions.stats import hazen_quantiles, moving_frame, robust_unit
from kinetra.operators.common import lookup_join, made, written
from kinetra.operators.ordered_windows import indexed, own, running_sum, with_neighbours

#: Milliseconds of a part of a source's time that is ordered in one task.
PART_MS = 3_600_000
#: The same in rows, for rows that are numbered anew.
PART_ROWS = 65_536
_FIELD = re.compile(r"^(.+)_([qt])([1-4])$")


def bodies_of(columns: Sequence[str]) -> list[str]:
    """The bodies, sorted, of columns <body>_q1..q4, _t1..t3. A body's name is all before the last _q or _t and a digit."""
    found: dict[str, set[str]] = {}
    for c in columns:
        if m := _FIELD.match(c):
            found.setdefault(m[1], set()).add(m[2] + m[3])
    return sorted(b for b, parts in found.items() if parts >= {"q1", "q2", "q3", "q4", "t1", "t2", "t3"})


def pose_columns(body: str) -> tuple[list[Column], list[Column]]:
    """A body's quaternion and translation; NaN counts as null."""
    part = lambda p: F.when(~F.isnan(F.col(f"{body}_{p}")), F.col(f"{body}_{p}"))
    return [part(f"q{i}") for i in (1, 2, 3, 4)], [part(f"t{i}") for i in (1, 2, 3)]


def long_tracks(wide: DataFrame, keep: Sequence[str], bodies: Sequence[str] | None = None) -> DataFrame:
    """One row per reading and body: the kept columns, body, q (scalar first, as read), t, and seen (all seven numbers are finite)."""
    rows = []
    for b in bodies if bodies is not None else bodies_of(wide.columns):
        q, t = pose_columns(b)
        rows.append(F.struct(F.lit(b).alias("body"), F.array(*q).alias("q"), F.array(*t).alias("t")))
    long = wide.select(*keep, F.inline(F.array(*rows)))
    return long.withColumn("seen", F.forall(F.concat("q", "t"), lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def in_frame(df: DataFrame, probe: str, reference: str, name: str = "pose") -> DataFrame:
    """Rows with the pose of one body in the frame of another (array of 16): inverse of the reference's times the probe's; null where either isn't seen."""
    for b, c in ((probe, "_p"), (reference, "_r")):
        m = la.from_quaternion(*pose_columns(b))
        df = df.withColumn(c, F.array(*m)).withColumn(c, F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c)))
    both = F.col("_p").isNotNull() & F.col("_r").isNotNull()
    return df.withColumn(name, F.when(both, F.array(*la.compose(la.inverse(la.matrix(F.col("_r"))), la.matrix(F.col("_p")))))).drop("_p", "_r")


def timed(readings: DataFrame, source: str, time_ms: str, id_col: str) -> DataFrame:
    """The readings of each source once per id, indexed by (time, id); rows without source, time or id are left out."""
    known = readings.where(F.col(source).isNotNull() & F.col(time_ms).isNotNull() & F.col(id_col).isNotNull())
    return indexed(known, [source], [time_ms, id_col], F.floor(F.col(time_ms) / PART_MS), once=True)


def relative_steps(at: DataFrame, source: str, body: str) -> DataFrame:
    """The indexed rows with step_mm and turn_deg: the move from the body's pose to that of the source's next row; null where either isn't seen."""
    at = at.withColumn("_pose", F.array(*la.from_quaternion(*pose_columns(body))))
    at = at.withColumn("_pose", F.when(F.forall("_pose", lambda x: x.isNotNull()), F.col("_pose")))
    rows, w = with_neighbours(at, [source], 0, 1)
    rows = rows.withColumn("_next", F.lead("_pose").over(w))
    a, b = la.matrix(F.col("_pose")), la.matrix(F.col("_next"))
    return own(rows.withColumn("step_mm", la.translation_error(a, b)).withColumn("turn_deg", la.rotation_error_deg(a, b))).drop("_pose", "_next")


def moving_mean(at: DataFrame, source: str, value: str, k: int, name: str = "mean") -> DataFrame:
    """The indexed rows with the mean of ``value`` over a centred window of k rows, shorter at the ends; nulls don't count."""
    rows, w = with_neighbours(at, [source], k // 2, (k - 1) // 2)
    return own(rows.withColumn(name, F.avg(value).over(moving_frame(w, k))))


def gap_sessions(at: DataFrame, source: str, time_ms: str, gap_ms: int, name: str = "island") -> DataFrame:
    """The indexed rows with the number, from 1, of their stretch without gaps above gap_ms."""
    rows, w = with_neighbours(at, [source], 1, 0)
    starts = own(rows.withColumn("_start", F.coalesce((F.col(time_ms) - F.lag(time_ms).over(w) > gap_ms).cast("bigint"), F.lit(1))))
    return running_sum(starts, [source], F.col("_start"), name).drop("_start")


def second_differences(at: DataFrame, source: str, value: str, name: str = "bend") -> DataFrame:
    """The indexed rows with value before - 2 value + value after; null at the ends."""
    rows, w = with_neighbours(at, [source], 1, 1)
    return own(rows.withColumn(name, F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)))


def path_length(at: DataFrame, source: str, point: Sequence[str], name: str = "path_mm") -> DataFrame:
    """The indexed rows with the length of the way from the source's first row; a step to or from a null point counts 0."""
    rows, w = with_neighbours(at, [source], 1, 0)
    step = la.norm([F.col(c) - F.lag(c).over(w) for c in point])
    return running_sum(own(rows.withColumn("_step", F.coalesce(step, F.lit(0.0)))), [source], F.col("_step"), name).drop("_step")


def moved(at: DataFrame, source: str, point: Sequence[str], tolerance: float) -> DataFrame:
    """The indexed rows whose point lies more than ``tolerance`` from that of the row before; the first row stays."""
    rows, w = with_neighbours(at, [source], 1, 0)
    rows = own(rows.withColumn("_d", la.norm([F.col(c) - F.lag(c).over(w) for c in point])))
    return rows.where((F.col("_at") == 0) | (F.col("_d") > tolerance)).drop("_d")


def trailing(at: DataFrame, source: str, value: str, n: int) -> DataFrame:
    """The indexed rows with mean_last, low_last and high_last over the row and the n - 1 before it."""
    rows, w = with_neighbours(at, [source], n - 1, 0)
    last = w.rowsBetween(-(n - 1), 0)
    return own(rows.withColumns({"mean_last": F.avg(value).over(last), "low_last": F.min(value).over(last), "high_last": F.max(value).over(last)}))


def weighted_following(at: DataFrame, source: str, value: str, start: int, stop: int, sigma: float, name: str = "following") -> DataFrame:
    """The indexed rows with the Gaussian-weighted mean of ``value`` at offsets start..stop after the row, over those that are there."""
    weights = {k: float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(start, stop + 1)}
    rows, w = with_neighbours(at, [source], 0, stop)
    there = {k: F.lead(value, k).over(w) for k in weights}
    total = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in there.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in there.items()), F.lit(0.0))
    return own(rows.withColumn(name, total / F.when(weight > 0, weight)))


def preceding_peak(at: DataFrame, source: str, value: str, n: int, name: str = "peak_back") -> DataFrame:
    """The indexed rows with how many rows back, 0 to n, the largest of the last values lies (of equals the latest)."""
    rows, w = with_neighbours(at, [source], n, 0)
    top = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col("_at")))).over(w.rowsBetween(-n, 0))
    return own(rows.withColumn(name, F.col("_at") - top["_at"]))


def robust_scaled(df: DataFrame, source: str, value: str, low: float = 0.05, high: float = 0.95, name: str = "scaled") -> DataFrame:
    """Rows with ``value`` between the source's low and high midpoint quantiles as 0 to 1; null values stay null."""
    q = hazen_quantiles(df, [source], F.col(value), {"_lo": low, "_hi": high}).drop("n")
    return lookup_join(df, q, [source], F.col(value)).withColumn(name, F.when(F.col(value).isNotNull() & ~F.isnan(value), robust_unit(F.col(value), F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")


def quaternion_moments(df: DataFrame, keys: Sequence[str], q: Column) -> DataFrame:
    """Per key: n and the ten sums of products of the unit quaternions' parts (m11, m12, ... m44); q and -q count the same."""
    parts = [F.get(q, F.lit(i)) for i in range(4)]
    length = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    ok = F.coalesce(length > 0, F.lit(False)) & ~F.isnan(length)
    u = [F.when(ok, p / length) for p in parts]
    sums = [F.sum(u[i] * u[j]).alias(f"m{i + 1}{j + 1}") for i in range(4) for j in range(i, 4)]
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n"), *sums)


def mean_rotation(moments: DataFrame) -> DataFrame:
    """The moments with q: the unit quaternion (scalar part not negative) that is nearest to all; null without any."""
    names = [f"m{i + 1}{j + 1}" for i in range(4) for j in range(i, 4)]

    @F.pandas_udf("array<double>")
    def principal(*sums: pd.Series) -> pd.Series:
        values = np.stack([s.to_numpy(float) for s in sums], 1)
        m = np.zeros((len(values), 4, 4))
        rows, cols = np.triu_indices(4)
        m[:, rows, cols] = m[:, cols, rows] = np.nan_to_num(values)
        q = np.linalg.eigh(m)[1][:, :, -1] if len(m) else np.zeros((0, 4))
        q = np.where(q[:, :1] < 0, -q, q)
        return pd.Series([None if np.isnan(v).any() else list(x) for x, v in zip(q, values)], dtype=object)

    return moments.withColumn("q", principal(*[F.col(n) for n in names]))


def smoothed_spline(df: DataFrame, keys: Sequence[str], time_col: str, value: str, step: Column) -> DataFrame:
    """Missing grid points between neighbouring knots by monotone cubic pieces (Fritsch-Carlson slopes): keys, at, filled.

    Rows are the knots, indexed; of knots at one time the last counts on its right and the first on its left. A piece needs two knots on either side, which a block sees.
    """
    rows, w = with_neighbours(df, keys, 1, 2)
    t, v = F.col(time_col).cast("double"), F.col(value).cast("double")
    for k in (-1, 1, 2):
        rows = rows.withColumn(f"_t{k}", F.lead(time_col, k).over(w) if k > 0 else F.lag(time_col).over(w)).withColumn(f"_v{k}", F.lead(value, k).over(w) if k > 0 else F.lag(value).over(w))
    rows = own(rows).where(F.col("_t1") > t)
    h = F.col("_t1") - t
    d = (F.col("_v1") - v) / h
    hb, ha = (F.when(x > 0, x) for x in (t - F.col("_t-1"), F.col("_t2") - F.col("_t1")))
    db, da = (v - F.col("_v-1")) / hb, (F.col("_v2") - F.col("_v1")) / ha

    def inner(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
        w0, w1 = 2 * h1 + h0, h1 + 2 * h0
        return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)

    def end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(F.signum(s) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)

    first = F.when(hb.isNotNull(), inner(hb, h, db, d)).when(ha.isNotNull(), end(h, ha, d, da)).otherwise(d)
    second = F.when(ha.isNotNull(), inner(h, ha, d, da)).when(hb.isNotNull(), end(h, hb, d, db)).otherwise(d)
    n = F.ceil(h / step) - 1
    rows = rows.withColumns({"_h": h, "_s0": first, "_s1": second, "_step": step}).where(n >= 1).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    x = F.col("_i") * F.col("_step") / F.col("_h")
    hermite = v * (1 + 2 * x) * (1 - x) ** 2 + F.col("_h") * F.col("_s0") * x * (1 - x) ** 2 + F.col("_v1") * x * x * (3 - 2 * x) - F.col("_h") * F.col("_s1") * x * x * (1 - x)
    return rows.select(*keys, (F.col(time_col) + F.col("_i") * F.col("_step")).alias("at"), hermite.alias("filled"))


def chained_poses(at: DataFrame, source: str, steps: Sequence[str], block: int = 8_192) -> DataFrame:
    """The indexed rows with ``pose``: the product of all step transforms (columns of 16 numbers: ``steps[0]``) up to the row.

    A scan by levels: products of blocks, which are again rows that are multiplied by blocks, until a source has one block;
    then down again, each block beginning with what comes before it. A null step counts as no move. No group is larger than a block.
    """
    kind, step = dict(at.dtypes)[source], steps[0]
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    rows = at.select(source, "_at", F.coalesce(F.col(step), eye).alias("_m")).where(F.col(source).isNotNull())

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per row the product before it and with it."""
        pdf = pdf.sort_values("_at")
        acc, before, out = np.array(pdf["_start"].iloc[0], float).reshape(4, 4), [], []
        for m in pdf["_m"]:
            before.append(acc.ravel().tolist())
            acc = acc @ np.array(m, float).reshape(4, 4)
            out.append(acc.ravel().tolist())
        return pd.DataFrame({source: pdf[source], "_at": pdf["_at"], "_before": before, "pose": out})

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.eye(4)
        for m in pdf.sort_values("_at")["_m"]:
            acc = acc @ np.array(m, float).reshape(4, 4)
        return pd.DataFrame({source: pdf[source].iloc[:1], "_at": pdf["_b"].iloc[:1], "_m": [acc.ravel().tolist()]})

    def scanned(level: DataFrame, n: int) -> DataFrame:
        cut = level.withColumn("_b", F.floor(F.col("_at") / block))
        if n <= block:
            begun = cut.withColumn("_start", eye)
        else:
            whole = cut.groupBy(source, "_b").applyInPandas(products, f"{source} {kind}, _at bigint, _m array<double>")
            starts = scanned(written(whole), -(-n // block)).select(source, F.col("_at").alias("_b"), F.col("_before").alias("_start"))
            begun = cut.join(starts, [source, "_b"])
        return begun.groupBy(source, "_b").applyInPandas(chain, f"{source} {kind}, _at bigint, _before array<double>, pose array<double>")

    longest = at.agg(F.max("_at")).first()[0]
    return at.join(scanned(rows, (longest or 0) + 1).drop("_before"), [source, "_at"])


def smoothed_poses(at: DataFrame, source: str, pose: str, k: int, name: str = "smooth") -> DataFrame:
    """The indexed rows that have a ``pose`` (16 numbers), renumbered, with the smooth one: the moves from pose to pose, as twists, are
    averaged over a centred window of k of them, shorter at the ends, and chained again from the first pose.
    """
    kept = written(at.where(F.col(pose).isNotNull()).withColumnRenamed("_at", "_t"))
    placed = indexed(kept, [source], ["_t"], F.floor(F.col("_t") / PART_ROWS)).drop("_t")
    rows, w = with_neighbours(placed, [source], 1, 0)
    # each step refers to the result of the one before: as one expression they take millions of nodes
    move = la.compose(la.inverse(la.matrix(F.col("_prev"))), la.matrix(F.col(pose)))
    rows = made(own(rows.withColumn("_prev", F.lag(pose).over(w))), "_move", F.when(F.col("_prev").isNotNull(), F.array(*move))).drop("_prev")
    move = la.matrix(F.col("_move"))
    rows = made(rows, "_turn", F.array(*la.log_turn(move)))
    rows = made(rows, "_twist", F.array(*la.log_twist(move, la.matrix(F.col("_turn"))[:4]))).drop("_move", "_turn")
    rows, w = with_neighbours(rows, [source], k // 2, (k - 1) // 2)
    rows = own(rows.withColumn("_mean", F.array(*[F.avg(F.get("_twist", F.lit(i))).over(moving_frame(w, k)) for i in range(6)])))
    step = F.when(F.col("_at") == 0, F.col(pose)).otherwise(F.array(*la.exp_map([F.get("_mean", F.lit(i)) for i in range(6)])))
    steps = written(rows.withColumn("_step", step).drop("_twist", "_mean"))
    smooth = chained_poses(steps.select(source, "_at", "_step"), source, ["_step"]).select(source, "_at", F.col("pose").alias(name))
    return steps.drop("_step").join(smooth, [source, "_at"])


def resampled_path(at: DataFrame, source: str, point: Sequence[str], spacing: float) -> DataFrame:
    """Points along each source's way at equal distances from its start, and its end: source, place (from 0), path_mm and the point's columns.

    Steps without length or with a null point are passed over. Every step makes its own points, so a long way is many tasks.
    """
    kept = at.dropna(subset=list(point)).withColumnRenamed("_at", "_t")
    placed = path_length(indexed(kept, [source], ["_t"], F.floor(F.col("_t") / PART_ROWS)), source, point)
    rows, w = with_neighbours(placed, [source], 0, 1)
    ahead = own(rows.withColumns({"_p1": F.lead("path_mm").over(w), **{f"_n_{c}": F.lead(c).over(w) for c in point}}))
    first, last = F.ceil(F.col("path_mm") / spacing).cast("bigint"), (F.ceil(F.col("_p1") / spacing) - 1).cast("bigint")
    inner = ahead.where(F.col("_p1").isNotNull() & (last >= first)).withColumn("place", F.explode(F.sequence(first, last)))
    share = (F.col("place") * spacing - F.col("path_mm")) / (F.col("_p1") - F.col("path_mm"))
    inner = inner.select(source, "place", (F.col("place") * spacing).alias("path_mm"), *[(F.col(c) + share * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in point])
    end = ahead.where("_p1 is null").select(source, F.ceil(F.col("path_mm") / spacing).cast("bigint").alias("place"), "path_mm", *point)
    return inner.unionByName(end)


def tangents(at: DataFrame, source: str, point: Sequence[str]) -> DataFrame:
    """The indexed rows with tangent: the direction from the row before to the row after (from or to the row itself at the ends), null without length."""
    rows, w = with_neighbours(at, [source], 1, 1)
    along = la.unit([F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in point])
    rows = own(rows.withColumn("tangent", F.array(*along)))
    return rows.withColumn("tangent", F.when(F.forall("tangent", lambda x: x.isNotNull()), F.col("tangent")))
