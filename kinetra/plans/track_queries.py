"""Queries over the tracked bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions import linalg as la
from kinetra.functions.stats import hazen_quantiles
from kinetra.operators import tracks
from kinetra.operators.common import lookup_join
from kinetra.operators.matching import exactly_one, same_sets, zipped
from kinetra.operators.plausibility import rigid_violation
from kinetra.plans.tables import table

BODIES = ("A_F_GTR", "A_F_MID", "A_F_MEP", "A_T_MEP", "B_N_REF", "B_N_PRB", "C_F_PRO", "C_T_DIS")
_POINT = ["A_T_MEP_t1", "A_T_MEP_t2", "A_T_MEP_t3"]
SEVEN = ("q1", "q2", "q3", "q4", "t1", "t2", "t3")


def _at(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The readings of each session once, in the order of time; NaN as null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]
    return tracks.timed(table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", *clean), "session_id", "utc_epoch_ms", "reading_id")


def _seen_at(spark: SparkSession, d: str, column: str) -> DataFrame:
    """Only the readings that have the column."""
    have = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", column).where(f"{column} is not null and not isnan({column})")
    return tracks.timed(have, "session_id", "utc_epoch_ms", "reading_id")


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "tracking").select("reading_id", *columns).dropDuplicates(["reading_id"])


def unpivot_tracking(spark, d):
    """Per body: poses, poses seen, and the mean place of the seen ones."""
    wide = _once(spark, d, "session_id", *[f"{b}_{p}" for b in BODIES for p in SEVEN])
    long = tracks.long_tracks(wide, ["reading_id"], BODIES)
    mean = [F.round(F.avg(F.when(F.col("seen"), F.get("t", F.lit(i)))), 4).alias(f"mean_t{i + 1}") for i in range(3)]
    return long.groupBy("body").agg(F.count("*").alias("poses"), F.count_if("seen").alias("seen"), *mean)


def quaternion_to_rotation(spark, d):
    """The rotation of the probe's quaternion, for each reading that sees it."""
    q, t = tracks.pose_columns("B_N_PRB")
    m = la.from_quaternion(q, t)
    rows = _once(spark, d, *[f"B_N_PRB_{p}" for p in SEVEN])
    return rows.select("reading_id", *[F.round(m[4 * r + c], 6).alias(f"r{r + 1}{c + 1}") for r in range(3) for c in range(3)]).where("r11 is not null")


def probe_in_reference(spark, d):
    """The probe's place in the frame of the reference body."""
    rows = tracks.in_frame(_once(spark, d, *[f"{b}_{p}" for b in ("B_N_PRB", "B_N_REF") for p in SEVEN]), "B_N_PRB", "B_N_REF")
    return rows.where("pose is not null").select("reading_id", *[F.round(F.get("pose", F.lit(i)), 4).alias(n) for i, n in ((3, "x"), (7, "y"), (11, "z"))])


def relative_steps(spark, d):
    """Per session: steps of the probe, how far and how much it turned in all."""
    at = _at(spark, d, *[f"B_N_PRB_{p}" for p in SEVEN])
    steps = tracks.relative_steps(at, "session_id", "B_N_PRB")
    return steps.groupBy("session_id").agg(F.count("step_mm").alias("steps"), F.round(F.sum("step_mm"), 3).alias("moved_mm"), F.round(F.max("step_mm"), 4).alias("largest_mm"), F.round(F.sum("turn_deg"), 3).alias("turned_deg"))


def moving_mean(spark, d):
    """The centred mean of five readings."""
    got = tracks.moving_mean(_at(spark, d, "A_F_MID_t1"), "session_id", "A_F_MID_t1", 5)
    return got.select("reading_id", F.round("mean", 7).alias("mean"))


def moving_mean_even(spark, d):
    """The mean of four readings, two before and one after."""
    got = tracks.moving_mean(_at(spark, d, "A_F_MID_t2"), "session_id", "A_F_MID_t2", 4)
    return got.select("reading_id", F.round("mean", 7).alias("mean"))


def roughness(spark, d):
    """Per session the root mean square of second differences."""
    bent = tracks.second_differences(_seen_at(spark, d, "A_F_MID_t3"), "session_id", "A_F_MID_t3")
    return bent.groupBy("session_id").agg(F.count("bend").alias("n"), F.round(F.sqrt(F.avg(F.col("bend") * F.col("bend"))), 4).alias("rms"))


def gap_sessions(spark, d):
    """Per session: stretches without gaps over two seconds, and the longest one's readings."""
    islands = tracks.gap_sessions(_at(spark, d), "session_id", "utc_epoch_ms", 2000)
    sized = islands.groupBy("session_id", "island").agg(F.count("*").alias("n"))
    return sized.groupBy("session_id").agg(F.count("*").alias("stretches"), F.max("n").alias("longest"))


def arc_length(spark, d):
    """The way of a body along each session, at every reading that sees it."""
    point = ["A_T_MEP_t1", "A_T_MEP_t2", "A_T_MEP_t3"]
    seen = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", *point).where(" and ".join(f"{c} is not null and not isnan({c})" for c in point))
    way = tracks.path_length(tracks.timed(seen, "session_id", "utc_epoch_ms", "reading_id"), "session_id", point)
    return way.select("reading_id", F.round("path_mm", 3).alias("path_mm"))


def _places(spark, d):
    """A body's places in each session, those seen."""
    have = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", *_POINT).where(" and ".join(f"{c} is not null and not isnan({c})" for c in _POINT))
    return tracks.timed(have, "session_id", "utc_epoch_ms", "reading_id")


def resampled_path(spark, d):
    """Points along a body's way in each session, every 20 mm, and its end."""
    got = tracks.resampled_path(_places(spark, d), "session_id", _POINT, 20.0)
    return got.select("session_id", "place", *[F.round(c, 3).alias(c) for c in ("path_mm", *_POINT)])


def tangents(spark, d):
    """The direction of a body's way at every reading that sees it."""
    got = tracks.tangents(_places(spark, d), "session_id", _POINT)
    return got.select("reading_id", *[F.round(F.get("tangent", F.lit(i)), 5).alias(f"d{i + 1}") for i in range(3)])


def smoothed_poses(spark, d):
    """Per session: the smooth last pose of a body, and how far smoothing moved its poses at most."""
    q, t = tracks.pose_columns("B_N_REF")
    pose = F.array(*la.from_quaternion(q, t))
    rows = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", *[f"B_N_REF_{p}" for p in SEVEN]).where(F.forall(pose, lambda x: x.isNotNull()))
    at = tracks.timed(rows, "session_id", "utc_epoch_ms", "reading_id").select("session_id", "_at", pose.alias("pose_now"))
    got = tracks.smoothed_poses(at, "session_id", "pose_now", 5)
    away = la.translation_error(la.matrix(F.col("pose_now")), la.matrix(F.col("smooth")))
    last = got.groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("smooth", "_at").alias("_p"), F.round(F.max(away), 3).alias("moved_mm"))
    return last.select("session_id", "n", "moved_mm", *[F.round(F.get("_p", F.lit(i)), 3).alias(c) for i, c in ((3, "x"), (7, "y"), (11, "z"))])


def drop_adjacent_duplicates(spark, d):
    """Per session: readings that remain where a move of a millimetre or less is none."""
    kept = tracks.moved(_seen_at(spark, d, "B_N_REF_t1"), "session_id", ["B_N_REF_t1"], 1.0)
    return kept.groupBy("session_id").agg(F.count("*").alias("kept"))


def trailing_window(spark, d):
    """Mean, least and most of the last ten readings."""
    got = tracks.trailing(_at(spark, d, "B_N_PRB_t3"), "session_id", "B_N_PRB_t3", 10)
    return got.select("reading_id", F.round("mean_last", 7).alias("mean_last"), "low_last", "high_last")


def shadow_weighted_window(spark, d):
    """The Gaussian-weighted mean of the four readings after each."""
    got = tracks.weighted_following(_at(spark, d, "A_F_MID_t1"), "session_id", "A_F_MID_t1", 1, 4, 2.0)
    return got.select("reading_id", F.round("following", 7).alias("following"))


def preceding_argmax(spark, d):
    """How many readings back the largest of the last six lies."""
    return tracks.preceding_peak(_at(spark, d, "A_F_MID_t1"), "session_id", "A_F_MID_t1", 5).select("reading_id", "peak_back")


def every_kth(spark, d):
    """Every tenth reading of each session."""
    return _at(spark, d).where("_at % 10 = 0").select("session_id", "reading_id", F.col("_at").alias("place"))


def robust_normalize(spark, d):
    """Values between their session's 5th and 95th percentiles as 0 to 1."""
    got = tracks.robust_scaled(_once(spark, d, "session_id", "A_T_MEP_t2").where("session_id is not null"), "session_id", "A_T_MEP_t2")
    return got.select("reading_id", F.round("scaled", 5).alias("scaled"))


def quaternion_mean_moments(spark, d):
    """Per session the ten moments of a body's unit quaternions."""
    rows = _once(spark, d, "session_id", *[f"B_N_REF_q{i}" for i in (1, 2, 3, 4)]).where("session_id is not null")
    got = tracks.quaternion_moments(rows, ["session_id"], F.array(*[f"B_N_REF_q{i}" for i in (1, 2, 3, 4)]))
    return got.select("session_id", "n", *[F.round(c, 4).alias(c) for c in got.columns if c.startswith("m")])


def mean_rotation(spark, d):
    """Per session the mean rotation of a body as a quaternion."""
    rows = _once(spark, d, "session_id", *[f"B_N_REF_q{i}" for i in (1, 2, 3, 4)]).where("session_id is not null")
    return tracks.mean_rotation(tracks.quaternion_moments(rows, ["session_id"], F.array(*[f"B_N_REF_q{i}" for i in (1, 2, 3, 4)]))).select("session_id", "n", "q")


def gap_fill_spline(spark, d):
    """Monotone cubic values at every missing half second between readings of a body."""
    return tracks.smoothed_spline(_seen_at(spark, d, "A_T_MEP_t3"), ["session_id"], "utc_epoch_ms", "A_T_MEP_t3", F.lit(500)).select("session_id", "at", F.round("filled", 6).alias("filled"))


def chained_poses(spark, d):
    """Per session: where the chain of the probe's own steps ends, which is its last pose seen from the first."""
    q, t = tracks.pose_columns("B_N_PRB")
    seen = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", F.array(*la.from_quaternion(q, t)).alias("pose_now")).where(F.forall("pose_now", lambda x: x.isNotNull()))
    from kinetra.operators.ordered_windows import own, with_neighbours

    at = tracks.timed(seen, "session_id", "utc_epoch_ms", "reading_id")
    rows, w = with_neighbours(at, ["session_id"], 1, 0)
    before = la.matrix(F.lag("pose_now").over(w))
    step = F.when(F.col("_at") > 0, F.array(*la.compose(la.inverse(before), la.matrix(F.col("pose_now")))))
    chained = tracks.chained_poses(own(rows.withColumn("step", step)), "session_id", ["step"])
    last = chained.groupBy("session_id").agg(F.max_by("pose", "_at").alias("pose"), F.count("*").alias("n"))
    return last.select("session_id", "n", *[F.round(F.get("pose", F.lit(i)), 3).alias(c) for i, c in ((3, "x"), (7, "y"), (11, "z"))])


def track_quantiles(spark, d):
    """Per station the midpoint quartiles of a coordinate."""
    rows = _once(spark, d, "station", "A_F_MID_t2").where("station is not null")
    q = hazen_quantiles(rows, ["station"], F.col("A_F_MID_t2"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.select("station", "n", *[F.round(c, 5).alias(c) for c in ("q25", "median", "q75")])


def rigid_violations(spark, d):
    """Per station: packets, and those whose probe transform isn't rigid."""
    packets = table(spark, d, "packets").dropDuplicates(["packet_id"])
    sessions = table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("station").alias("station"))
    bad = rigid_violation(F.col("probe_t"), F.lit(None).cast("double"))
    return lookup_join(packets, sessions, ["session_id"], F.col("packet_id")).groupBy("station").agg(F.count("*").alias("packets"), F.count_if(bad).alias("violations"))


def status_counts(spark, d):
    """Packets by the state that their status text means."""
    packets = table(spark, d, "packets").dropDuplicates(["packet_id"])
    text = F.upper(F.trim("ProbeToTrackerDeviceTransformStatus"))
    state = F.when(text.isNull(), "unknown").when(text == "", "blank").when(text.isin("OK", "TRUE", "1"), "ok").otherwise("bad")
    return packets.groupBy(state.alias("state"), "ref_ok").agg(F.count("*").alias("n"), F.count_if("image_ok").alias("images"))


def exactly_one_match(spark, d):
    """Packets by whether their session has exactly one row in sessions."""
    packets = table(spark, d, "packets").select("packet_id", "session_id").distinct()
    matched = exactly_one(packets, table(spark, d, "sessions").select("session_id", "bone"), ["session_id"])
    return matched.groupBy("status", "matches").agg(F.count("*").alias("n"))


def setwise_match(spark, d):
    """Per session: whether the frames of packets and those of the header table are the same set."""
    packets = table(spark, d, "packets").select(F.col("session_id").alias("k"), F.col("frame_id").cast("int").alias("frame"))
    frame = F.regexp_extract(F.lower("entity"), r"^\s*seq_frame0*([0-9]{1,9})\s*$", 1)
    fields = table(spark, d, "mha_fields").where(frame != "").select(F.col("sequence_id").alias("k"), frame.cast("int").alias("frame"))
    return same_sets(packets, fields, ["k"], "frame")


def zip_join_identity(spark, d):
    """Per session: frames of packets paired by place with those of the header table, and how many are equal."""
    packets = table(spark, d, "packets").select(F.col("session_id").alias("k"), F.col("frame_id").cast("int").alias("frame")).distinct()
    frame = F.regexp_extract(F.lower("entity"), r"^\s*seq_frame0*([0-9]{1,9})\s*$", 1)
    fields = table(spark, d, "mha_fields").where(frame != "").select(F.col("sequence_id").alias("k"), frame.cast("int").alias("frame")).distinct()
    pairs = zipped(packets, fields, ["k"], "frame", "frame")
    return pairs.groupBy("k").agg(F.count("*").alias("places"), F.count_if(F.col("left_value") == F.col("right_value")).alias("equal"))


def semi_filter(spark, d):
    """Readings by station of the sessions of a femur."""
    femur = table(spark, d, "sessions").where("upper(bone) = 'F'").select("session_id")
    return _once(spark, d, "session_id", "station").join(femur, "session_id", "left_semi").groupBy("station").agg(F.count("*").alias("readings"))


def anti_missing(spark, d):
    """Sessions without packets, by bone."""
    sessions = table(spark, d, "sessions").groupBy("session_id").agg(F.max("bone").alias("bone"))
    return sessions.join(table(spark, d, "packets").select("session_id"), "session_id", "left_anti").groupBy("bone").agg(F.count("*").alias("sessions"))


def name_parsing(spark, d):
    """Per session: parts of the group's name, and the station in the path of its packets."""
    tail = F.lower(F.element_at(F.split("group_name", "_"), -1))
    sessions = table(spark, d, "sessions").distinct().select("session_id", F.upper(F.element_at(F.split("group_name", "_"), 1)).alias("part"), F.when(tail == "mid", "shaft").otherwise(tail).alias("region"))
    paths = table(spark, d, "packets").groupBy("session_id").agg(F.max(F.upper(F.regexp_extract("path", r"rec/([a-z0-9-]+)/", 1))).alias("station"))
    return sessions.join(paths, "session_id", "left")


_MODULE = (
    unpivot_tracking, quaternion_to_rotation, probe_in_reference, relative_steps, moving_mean, moving_mean_even, roughness, gap_sessions, arc_length, resampled_path, tangents, smoothed_poses,
    drop_adjacent_duplicates, trailing_window, shadow_weighted_window, preceding_argmax, every_kth, robust_normalize, quaternion_mean_moments, mean_rotation,
    gap_fill_spline, chained_poses, track_quantiles, rigid_violations, status_counts, exactly_one_match, setwise_match, zip_join_identity, semi_filter, anti_missing, name_parsing,
)
QUERIES = {f.__name__: f for f in _MODULE}


def _n(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


def _rotation(b: str, suffix: str = "") -> str:
    """Columns r11 ... r33 and x, y, z of a body's pose."""
    q = [f"({_n(f'{b}_q{i}')})" for i in (1, 2, 3, 4)]
    norm = f"sqrt({' + '.join(f'{x} * {x}' for x in q)})"
    w, x, y, z = (f"({c} / {norm})" for c in q)
    cells = {
        "r11": f"1 - 2 * ({y} * {y} + {z} * {z})", "r12": f"2 * ({x} * {y} - {w} * {z})", "r13": f"2 * ({x} * {z} + {w} * {y})",
        "r21": f"2 * ({x} * {y} + {w} * {z})", "r22": f"1 - 2 * ({x} * {x} + {z} * {z})", "r23": f"2 * ({y} * {z} - {w} * {x})",
        "r31": f"2 * ({x} * {z} - {w} * {y})", "r32": f"2 * ({y} * {z} + {w} * {x})", "r33": f"1 - 2 * ({x} * {x} + {y} * {y})",
        "x": _n(f"{b}_t1"), "y": _n(f"{b}_t2"), "z": _n(f"{b}_t3"),
    }
    return ", ".join(f"{v} AS {k}{suffix}" for k, v in cells.items())


_R = "r AS (SELECT DISTINCT ON (reading_id) * FROM tracking ORDER BY reading_id)"
_W = "WINDOW w AS (PARTITION BY session_id ORDER BY utc_epoch_ms, reading_id)"
_FRAMES = r"""a AS (SELECT DISTINCT session_id AS k, CAST(frame_id AS INT) AS frame FROM packets),
b AS (SELECT DISTINCT sequence_id AS k, CAST(regexp_extract(lower(entity), '^\s*seq_frame0*([0-9]{1,9})\s*$', 1) AS INT) AS frame FROM mha_fields WHERE regexp_matches(lower(entity), '^\s*seq_frame0*([0-9]{1,9})\s*$'))"""
_HAZEN = "greatest(least(n * {0} + 0.5, n), 1)"


def _quantile(p: float) -> str:
    h = _HAZEN.format(p)
    return f"(l[CAST(floor({h}) AS BIGINT)] + ({h} - floor({h})) * (l[CAST(ceil({h}) AS BIGINT)] - l[CAST(floor({h}) AS BIGINT)]))"


_UNIT = [f"(B_N_REF_q{i} / sqrt(B_N_REF_q1 * B_N_REF_q1 + B_N_REF_q2 * B_N_REF_q2 + B_N_REF_q3 * B_N_REF_q3 + B_N_REF_q4 * B_N_REF_q4))" for i in (1, 2, 3, 4)]
_SEEN = " AND ".join(f"B_N_REF_q{i} IS NOT NULL AND NOT isnan(B_N_REF_q{i})" for i in (1, 2, 3, 4))
_P = [f"probe_t[{i}]" for i in range(1, 17)]
_RIGID = " AND ".join(
    ["len(probe_t) = 16", "len(list_filter(probe_t, lambda x: x IS NULL OR NOT isfinite(x))) = 0"]
    + [f"abs({' + '.join(f'{_P[4 * i + c]} * {_P[4 * j + c]}' for c in range(3))} - {1.0 if i == j else 0.0}) < 2e-3" for i in range(3) for j in range(i, 3)]
    + ["abs(" + " + ".join(f"{_P[i]} * ({_P[4 + (i + 1) % 3]} * {_P[8 + (i + 2) % 3]} - {_P[4 + (i + 2) % 3]} * {_P[8 + (i + 1) % 3]})" for i in range(3)) + " - 1) < 5e-3"]
    + [f"abs({_P[12 + i]} - {x}) < 1e-6" for i, x in enumerate((0.0, 0.0, 0.0, 1.0))]
)
_TURN = " + ".join(f"r{i}{j} * lead(r{i}{j}) OVER w" for i in (1, 2, 3) for j in (1, 2, 3))
_WEIGHTS = {k: f"exp(-0.5 * ({k} / 2.0) * ({k} / 2.0))" for k in (1, 2, 3, 4)}
SQL = {
    "unpivot_tracking": f"WITH {_R} "
    + " UNION ALL ".join(
        f"SELECT '{b}' AS body, count(*) AS poses, count(*) FILTER ({(s := ' AND '.join(f'coalesce(isfinite({b}_{p}), false)' for p in SEVEN))}) AS seen, "
        + ", ".join(f"round(avg({b}_t{i}) FILTER ({s}), 4) AS mean_t{i}" for i in (1, 2, 3))
        + " FROM r"
        for b in BODIES
    ),
    "quaternion_to_rotation": f"WITH {_R}, m AS (SELECT reading_id, {_rotation('B_N_PRB')} FROM r) SELECT reading_id, "
    + ", ".join(f"round(r{i}{j}, 6) AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    + " FROM m WHERE r11 IS NOT NULL",
    "probe_in_reference": f"WITH {_R}, m AS (SELECT reading_id, {_rotation('B_N_PRB', 'p')}, {_rotation('B_N_REF', 'r')} FROM r), d AS (SELECT *, "
    + ", ".join(f"r1{i}r * (xp - xr) + r2{i}r * (yp - yr) + r3{i}r * (zp - zr) AS {c}" for i, c in ((1, "x"), (2, "y"), (3, "z")))
    + " FROM m WHERE r11p IS NOT NULL OR TRUE) SELECT reading_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL",
    "relative_steps": f"WITH {_R}, m AS (SELECT reading_id, session_id, utc_epoch_ms, {_rotation('B_N_PRB')} FROM r), o AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND r11 IS NOT NULL AS ok FROM m), "
    f"n AS (SELECT session_id, CASE WHEN ok AND lead(ok) OVER w THEN sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2 + (lead(z) OVER w - z) ** 2) END AS step, CASE WHEN ok AND lead(ok) OVER w THEN degrees(acos(greatest(least(({_TURN} - 1) / 2, 1), -1))) END AS turn FROM o WHERE session_id IS NOT NULL {_W}) "
    "SELECT session_id, count(step) AS steps, round(sum(step), 3) AS moved_mm, round(max(step), 4) AS largest_mm, round(sum(turn), 3) AS turned_deg FROM n GROUP BY 1",
    "moving_mean": f"WITH {_R} SELECT reading_id, round(avg({_n('A_F_MID_t1')}) OVER (PARTITION BY session_id ORDER BY utc_epoch_ms, reading_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 7) AS mean FROM r WHERE session_id IS NOT NULL",
    "moving_mean_even": f"WITH {_R} SELECT reading_id, round(avg({_n('A_F_MID_t2')}) OVER (PARTITION BY session_id ORDER BY utc_epoch_ms, reading_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 7) AS mean FROM r WHERE session_id IS NOT NULL",
    "roughness": f"WITH {_R}, v AS (SELECT * FROM r WHERE A_F_MID_t3 IS NOT NULL AND NOT isnan(A_F_MID_t3) AND session_id IS NOT NULL), b AS (SELECT session_id, lag(A_F_MID_t3) OVER w - 2 * A_F_MID_t3 + lead(A_F_MID_t3) OVER w AS bend FROM v {_W}) "
    "SELECT session_id, count(bend) AS n, round(sqrt(avg(bend * bend)), 4) AS rms FROM b GROUP BY 1",
    "gap_sessions": f"WITH {_R}, s AS (SELECT session_id, utc_epoch_ms, reading_id, CASE WHEN utc_epoch_ms - lag(utc_epoch_ms) OVER w > 2000 OR lag(utc_epoch_ms) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM r WHERE session_id IS NOT NULL {_W}), "
    f"i AS (SELECT session_id, sum(start) OVER w AS island FROM s {_W}), z AS (SELECT session_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT session_id, count(*) AS stretches, max(n) AS longest FROM z GROUP BY 1",
    "arc_length": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, A_T_MEP_t1 x, A_T_MEP_t2 y, A_T_MEP_t3 z FROM r WHERE session_id IS NOT NULL AND NOT isnan(A_T_MEP_t1) AND NOT isnan(A_T_MEP_t2) AND NOT isnan(A_T_MEP_t3)), "
    f"s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM v {_W}) SELECT reading_id, round(sum(step) OVER w, 3) AS path_mm FROM s {_W}",
    "resampled_path": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, A_T_MEP_t1 x, A_T_MEP_t2 y, A_T_MEP_t3 z FROM r WHERE session_id IS NOT NULL AND NOT isnan(A_T_MEP_t1) AND NOT isnan(A_T_MEP_t2) AND NOT isnan(A_T_MEP_t3)), "
    f"s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM v {_W}), p AS (SELECT *, sum(step) OVER w AS p FROM s {_W}), "
    f"n AS (SELECT *, lead(p) OVER w AS p1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM p {_W}), i AS (SELECT *, unnest(range(CAST(ceil(p / 20) AS BIGINT), CAST(ceil(p1 / 20) AS BIGINT))) AS place FROM n WHERE p1 IS NOT NULL), "
    "a AS (SELECT session_id, place, place * 20.0::DOUBLE AS path, x + (place * 20 - p) / (p1 - p) * (x1 - x) AS x, y + (place * 20 - p) / (p1 - p) * (y1 - y) AS y, z + (place * 20 - p) / (p1 - p) * (z1 - z) AS z FROM i UNION ALL SELECT session_id, CAST(ceil(p / 20) AS BIGINT), p, x, y, z FROM n WHERE p1 IS NULL) "
    "SELECT session_id, place, round(path, 3) AS path_mm, round(x, 3) AS A_T_MEP_t1, round(y, 3) AS A_T_MEP_t2, round(z, 3) AS A_T_MEP_t3 FROM a",
    "tangents": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, A_T_MEP_t1 x, A_T_MEP_t2 y, A_T_MEP_t3 z FROM r WHERE session_id IS NOT NULL AND NOT isnan(A_T_MEP_t1) AND NOT isnan(A_T_MEP_t2) AND NOT isnan(A_T_MEP_t3)), "
    f"s AS (SELECT reading_id, " + ", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS {c}" for c in "xyz") + f" FROM v {_W}), l AS (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM s) "
    "SELECT reading_id, " + ", ".join(f"CASE WHEN l > 0 THEN round({c} / l, 5) END AS d{i}" for i, c in enumerate("xyz", 1)) + " FROM l",
    "drop_adjacent_duplicates": f"WITH {_R}, s AS (SELECT session_id, abs(B_N_REF_t1 - lag(B_N_REF_t1) OVER w) AS d FROM r WHERE session_id IS NOT NULL AND B_N_REF_t1 IS NOT NULL AND NOT isnan(B_N_REF_t1) {_W}) SELECT session_id, count(*) AS kept FROM s WHERE d IS NULL OR d > 1 GROUP BY 1",
    "trailing_window": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, {_n('B_N_PRB_t3')} AS v FROM r WHERE session_id IS NOT NULL) SELECT reading_id, round(avg(v) OVER w, 7) AS mean_last, min(v) OVER w AS low_last, max(v) OVER w AS high_last FROM v WINDOW w AS (PARTITION BY session_id ORDER BY utc_epoch_ms, reading_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "shadow_weighted_window": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, {_n('A_F_MID_t1')} AS v FROM r WHERE session_id IS NOT NULL), s AS (SELECT reading_id, "
    + " + ".join(f"coalesce(lead(v, {k}) OVER w * {e}, 0)" for k, e in _WEIGHTS.items())
    + " AS total, "
    + " + ".join(f"CASE WHEN lead(v, {k}) OVER w IS NOT NULL THEN {e} ELSE 0 END" for k, e in _WEIGHTS.items())
    + f" AS weight FROM v {_W}) SELECT reading_id, round(CASE WHEN weight > 0 THEN total / weight END, 7) AS following FROM s",
    "preceding_argmax": f"WITH {_R}, v AS (SELECT reading_id, session_id, utc_epoch_ms, {_n('A_F_MID_t1')} AS v, row_number() OVER w AS k FROM r WHERE session_id IS NOT NULL {_W}) "
    "SELECT reading_id, k - max(CASE WHEN v IS NOT NULL THEN {'v': v, 'k': k} END) OVER (PARTITION BY session_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW).k AS peak_back FROM v",
    "every_kth": f"WITH {_R}, k AS (SELECT session_id, reading_id, row_number() OVER w - 1 AS place FROM r WHERE session_id IS NOT NULL {_W}) SELECT * FROM k WHERE place % 10 = 0",
    "robust_normalize": f"WITH {_R}, v AS (SELECT reading_id, session_id, {_n('A_T_MEP_t2')} AS v FROM r WHERE session_id IS NOT NULL), g AS (SELECT session_id, list_sort(list(v) FILTER (v IS NOT NULL)) AS l, count(v) AS n FROM v GROUP BY 1), "
    f"q AS (SELECT session_id, {_quantile(0.05)} AS lo, {_quantile(0.95)} AS hi FROM g) SELECT reading_id, round(CASE WHEN v IS NULL THEN NULL WHEN hi > lo THEN greatest(least((v - lo) / (hi - lo), 1), 0) ELSE 0.5 END, 5) AS scaled FROM v LEFT JOIN q USING (session_id)",
    "quaternion_mean_moments": f"WITH {_R} SELECT session_id, count(*) FILTER ({_SEEN}) AS n, "
    + ", ".join(f"round(sum({_UNIT[i]} * {_UNIT[j]}) FILTER ({_SEEN}), 4) AS m{i + 1}{j + 1}" for i in range(4) for j in range(i, 4))
    + " FROM r WHERE session_id IS NOT NULL GROUP BY 1",
    "track_quantiles": f"WITH {_R}, g AS (SELECT station, list_sort(list(A_F_MID_t2)) AS l, count(*) AS n FROM r WHERE station IS NOT NULL AND isfinite(A_F_MID_t2) GROUP BY 1) SELECT station, n, round({_quantile(0.25)}, 5) AS q25, round({_quantile(0.5)}, 5) AS median, round({_quantile(0.75)}, 5) AS q75 FROM g",
    "rigid_violations": f"WITH p AS (SELECT DISTINCT ON (packet_id) * FROM packets ORDER BY packet_id), s AS (SELECT session_id, max(station) AS station FROM sessions GROUP BY 1) SELECT station, count(*) AS packets, count(*) FILTER (NOT coalesce({_RIGID}, false)) AS violations FROM p LEFT JOIN s USING (session_id) GROUP BY 1",
    "status_counts": "WITH p AS (SELECT DISTINCT ON (packet_id) *, upper(trim(ProbeToTrackerDeviceTransformStatus)) AS t FROM packets ORDER BY packet_id) SELECT CASE WHEN t IS NULL THEN 'unknown' WHEN t = '' THEN 'blank' WHEN t IN ('OK', 'TRUE', '1') THEN 'ok' ELSE 'bad' END AS state, ref_ok, count(*) AS n, count(*) FILTER (image_ok) AS images FROM p GROUP BY 1, 2",
    "exactly_one_match": "WITH p AS (SELECT DISTINCT packet_id, session_id FROM packets), c AS (SELECT session_id, count(*) AS matches FROM sessions GROUP BY 1), m AS (SELECT coalesce(matches, 0) AS matches FROM p LEFT JOIN c USING (session_id)) SELECT CASE matches WHEN 1 THEN 'matched' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status, matches, count(*) AS n FROM m GROUP BY 1, 2",
    "setwise_match": f"WITH {_FRAMES}, f AS (SELECT coalesce(a.k, b.k) AS k, a.frame AS l, b.frame AS r FROM a FULL JOIN b ON a.k = b.k AND a.frame = b.frame) SELECT k, count(l) AS n_left, count(r) AS n_right, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NULL OR r IS NULL) = 0 AS equal FROM f GROUP BY 1",
    "zip_join_identity": f"WITH {_FRAMES}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY frame) AS p FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY frame) AS p FROM b) SELECT coalesce(x.k, y.k) AS k, count(*) AS places, count(*) FILTER (x.frame = y.frame) AS equal FROM x FULL JOIN y ON x.k = y.k AND x.p = y.p GROUP BY 1",
    "semi_filter": f"WITH {_R} SELECT station, count(*) AS readings FROM r WHERE session_id IN (SELECT session_id FROM sessions WHERE upper(bone) = 'F') GROUP BY 1",
    "anti_missing": "WITH s AS (SELECT session_id, max(bone) AS bone FROM sessions GROUP BY 1) SELECT bone, count(*) AS sessions FROM s WHERE NOT EXISTS (SELECT 1 FROM packets p WHERE p.session_id = s.session_id) GROUP BY 1",
    "name_parsing": "WITH s AS (SELECT DISTINCT * FROM sessions), p AS (SELECT session_id, max(upper(regexp_extract(path, 'rec/([a-z0-9-]+)/', 1))) AS station FROM packets GROUP BY 1) SELECT session_id, upper(split_part(group_name, '_', 1)) AS part, CASE lower(split_part(group_name, '_', -1)) WHEN 'mid' THEN 'shaft' ELSE lower(split_part(group_name, '_', -1)) END AS region, p.station FROM s LEFT JOIN p USING (session_id)",
}
