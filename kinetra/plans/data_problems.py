"""Queries of the general data problems (1, 2, 3 and 5) over the tracking, header and raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written
from kinetra.operators.plausibility import implausible_readings, implausible_transforms
from kinetra.operators.regular_grid import regular_grid
from kinetra.operators.schema_drift import consistent_readings, schema_drift
from kinetra.operators.wide_table import HEADER_ATTRIBUTES, attribute_kinds, cells, folded, frame_table
from kinetra.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every added, removed, renamed and retyped field of the raw tracker files."""
    return schema_drift(table(spark, d, "qtm_raw")).changes


def p1_readings(spark: SparkSession, d: str) -> DataFrame:
    """All readings of the raw tracker files under consistent names and types; fields that not all campaigns have are in maps by type."""
    lines = table(spark, d, "qtm_raw")
    parts = [f"{b}_{p}" for b in ("A_F_MID", "A_T_MEP") for p in ("q1", "q2", "q3", "q4", "t1", "t2", "t3")]
    return consistent_readings(lines, schema_drift(lines), {"utc_epoch_ms": "ms"} | dict.fromkeys(parts, "double")).drop("others")


def _implausible(spark: SparkSession, d: str) -> DataFrame:
    ranges = table(spark, d, "stations").where("station is not null").groupBy("station").agg(F.max("range_mm").alias("range_mm"))
    sessions = table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("station").alias("station"), F.max("started_epoch_ms").alias("started_epoch_ms"))
    reach = written(lookup_join(sessions, ranges, ["station"], F.col("session_id")).select("session_id", "range_mm", "started_epoch_ms"))
    quaternion = [f"A_F_GTR_q{i}" for i in (1, 2, 3, 4)]
    readings = table(spark, d, "tracking").select("reading_id", "session_id", "utc_epoch_ms", "A_F_GTR_t1", *quaternion)
    readings = lookup_join(readings, reach.drop("started_epoch_ms"), ["session_id"], F.col("utc_epoch_ms"))
    fields = {"A_F_GTR_t1": (F.col("range_mm"), []), "A_F_GTR_q1": (F.lit(1.0), quaternion[1:])}
    found = implausible_readings(readings, "session_id", "utc_epoch_ms", "reading_id", fields)
    status = "ProbeToTrackerDeviceTransformStatus"
    packets = table(spark, d, "packets").where(F.upper(F.trim(status)).isin("OK", "TRUE", "1")).select("packet_id", "session_id", "frame_id", "probe_t", "ts")
    packets = lookup_join(packets, reach, ["session_id"], F.col("packet_id"))
    jumps = implausible_transforms(packets, "session_id", "frame_id", "packet_id", "probe_t", F.col("range_mm"), F.col("started_epoch_ms") + 1000 * F.nanvl("ts", F.lit(None).cast("double")))
    return found.unionByName(jumps.select("record_id", F.lit(status).alias("field_name"), "rule"))


def p1_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Per operation of the edit scripts (rename, move) and number of fields it changes in a file: how many files."""
    per_file = schema_drift(table(spark, d, "qtm_raw")).script.groupBy("file_id", "op").agg(F.count("*").alias("fields"))
    return per_file.groupBy("op", "fields").agg(F.count("*").alias("files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible values of two tracked fields and of the probe's transform, for their session."""
    return _implausible(spark, d).select("record_id", "field_name").distinct()


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many values break each rule."""
    return _implausible(spark, d).groupBy("field_name", "rule").agg(F.count("*").alias("values"))


def _session_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("grid_ms").alias("grid_ms"))


def _tibia_grid(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "tracking").select("session_id", "utc_epoch_ms", "A_T_MEP_t1")
    readings = readings.where("A_T_MEP_t1 is not null and not isnan(A_T_MEP_t1)")
    stepped = lookup_join(readings, _session_steps(spark, d), ["session_id"], F.col("utc_epoch_ms"), "inner")
    return regular_grid(stepped, ["session_id"], "utc_epoch_ms", "A_T_MEP_t1", "grid_ms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a finite A_T_MEP_t1 between a session's first and last one."""
    return _tibia_grid(spark, d).where("state <> 'observed'").select("session_id", "slot_ms")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: each slot's value, and whether it was read, interpolated or lies in a long gap."""
    return _tibia_grid(spark, d).select("session_id", "slot_ms", F.round("value", 6).alias("value"), "state")


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The slots outside the first and last finite A_T_MEP_t1 of a session, where the grid is extended to all its readings."""
    readings = table(spark, d, "tracking").select("session_id", "utc_epoch_ms", "A_T_MEP_t1").where("session_id is not null and utc_epoch_ms is not null")
    bounds = readings.groupBy("session_id").agg(F.min("utc_epoch_ms").alias("from_ms"), F.max("utc_epoch_ms").alias("to_ms"))
    stepped = lookup_join(readings, _session_steps(spark, d), ["session_id"], F.col("utc_epoch_ms"), "inner")
    grid = regular_grid(stepped, ["session_id"], "utc_epoch_ms", "A_T_MEP_t1", "grid_ms", bounds=bounds)
    return grid.where("state = 'outside'").select("session_id", "slot_ms")


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The attributes of frames, listed or not, with the type that fits their values."""
    frames = table(spark, d, "mha_fields").where(folded(F.col("entity")).startswith("seqframe"))
    return attribute_kinds(frames, F.col("attribute"), F.col("attr_value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The non-null cells of the wide table of frames."""
    return cells(frame_table(table(spark, d, "mha_fields")), ["sequence_id", "frame_id"])


def p5_frames(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of frames, each matrix as 16 columns; attributes in blocks of four."""
    wide = frame_table(table(spark, d, "mha_fields"), block=4)
    for name, kind in HEADER_ATTRIBUTES.items():
        if kind == "matrix":
            wide = wide.withColumns({f"{name}_{i + 1}": F.get(name, F.lit(i)) for i in range(16)}).drop(name)
    return wide


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole wide table of frames, matrices as arrays of 16 doubles."""
    return frame_table(table(spark, d, "mha_fields"))


QUERIES = {f.__name__: f for f in (p1_found, p1_readings, p1_scripts, p2_found, p2_rules, p3_found, p3_grid, p3_bounds, p5_attributes, p5_found, p5_frames, p5_table)}

_GRID = """
WITH steps AS (SELECT session_id, max(grid_ms) AS step FROM sessions WHERE session_id IS NOT NULL GROUP BY 1),
slots AS (
  SELECT t.session_id, step, utc_epoch_ms // step * step AS slot, arg_max(A_T_MEP_t1, (utc_epoch_ms, A_T_MEP_t1)) AS v
  FROM tracking t JOIN steps USING (session_id) WHERE isfinite(A_T_MEP_t1) GROUP BY 1, 2, 3),
pairs AS (
  SELECT *, lead(slot) OVER w AS next_slot, lead(v) OVER w AS next_v FROM slots
  WINDOW w AS (PARTITION BY session_id ORDER BY slot)),
missing AS (
  SELECT *, unnest(generate_series(slot + step, next_slot - step, step)) AS at_ms FROM pairs WHERE next_slot > slot + step)
"""
_B = r"[\s\x{00a0}\x{2000}-\x{200b}\x{3000}\x{feff}]"


def _fold(x: str) -> str:
    return f"lower(regexp_replace({x}, '({_B}|[_-])+', '', 'g'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^({_B}|[\"''])+|({_B}|[\"''])+$', '', 'g')"


_NUM = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
_KINDS = ", ".join(f"('{a.lower()}', '{a}', '{k}')" for a, k in HEADER_ATTRIBUTES.items())
_CELLS = rf"""
WITH kinds(folded, attribute, kind) AS (VALUES {_KINDS}),
f AS (SELECT sequence_id, line_no, {_fold("entity")} AS e, {_fold("attribute")} AS a, attr_value FROM mha_fields),
dims AS (
  SELECT sequence_id, try_cast(regexp_split_to_array({_bare("arg_max_null(attr_value, line_no)")}, '{_B}+')[3] AS INT) AS frames
  FROM f WHERE e = 'header' AND a = 'dimsize' GROUP BY 1),
framed AS (
  SELECT f.*, CAST(regexp_extract(e, '^seqframe0*([0-9]{{1,9}})$', 1) AS INT) AS frame_id FROM f
  WHERE regexp_matches(e, '^seqframe0*([0-9]{{1,9}})$')),
standing AS (
  SELECT sequence_id, frame_id, k.attribute, kind, arg_max_null(attr_value, (line_no, coalesce(attr_value, ''))) AS v
  FROM framed LEFT JOIN dims USING (sequence_id) LEFT JOIN kinds k ON k.folded = framed.a
  WHERE frames IS NULL OR frame_id < frames GROUP BY ALL),
bare AS (SELECT *, {_bare("v")} AS b, regexp_replace(v, '{_B}+', '', 'g') = '' AS blank FROM standing),
cells AS (
  SELECT *, CASE WHEN kind = 'double' AND regexp_matches(b, '{_NUM}') THEN try_cast(replace(b, ',', '.') AS DOUBLE) END AS num,
    CASE WHEN kind = 'int' AND regexp_matches(b, '^[0-9]+$') THEN try_cast(b AS INT) END AS whole,
    CASE WHEN kind = 'flag' AND NOT blank THEN upper(b) IN ('OK', 'TRUE', '1') END AS flag,
    CASE WHEN kind = 'string' AND NOT blank THEN v END AS note,
    CASE WHEN kind = 'matrix' AND len(regexp_split_to_array(b, '{_B}+')) = 16
      AND len(list_filter(regexp_split_to_array(b, '{_B}+'), lambda x: NOT regexp_matches(x, '{_NUM}'))) = 0
      THEN list_transform(regexp_split_to_array(b, '{_B}+'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) END AS matrix
  FROM bare)
"""
_WIDE = {
    "double": "max(num) FILTER (attribute = '{0}') AS {0}",
    "int": "max(whole) FILTER (attribute = '{0}') AS {0}",
    "flag": "bool_or(flag) FILTER (attribute = '{0}') AS {0}",
    "string": "max(note) FILTER (attribute = '{0}') AS {0}",
    "matrix": ", ".join(f"max(matrix[{i}]) FILTER (attribute = '{{0}}') AS {{0}}_{i}" for i in range(1, 17)),
}
SQL = {
    "p3_found": _GRID + "SELECT session_id, at_ms AS slot_ms FROM missing",
    "p3_grid": _GRID
    + """SELECT session_id, slot AS slot_ms, round(v, 6) AS value, 'observed' AS state FROM slots UNION ALL
SELECT session_id, at_ms, CASE WHEN (next_slot - slot) // step - 1 <= 5 THEN round(v + (next_v - v) * ((at_ms - slot) / (next_slot - slot)), 6) END,
  CASE WHEN (next_slot - slot) // step - 1 <= 5 THEN 'interpolated' ELSE 'gap' END FROM missing""",
    "p3_bounds": "WITH steps AS (SELECT session_id, max(grid_ms) AS step FROM sessions WHERE session_id IS NOT NULL GROUP BY 1), l AS (SELECT t.session_id, step, min(utc_epoch_ms) // step * step AS a, max(utc_epoch_ms) // step * step AS d, "
    "min(utc_epoch_ms) FILTER (isfinite(A_T_MEP_t1)) // step * step AS b, max(utc_epoch_ms) FILTER (isfinite(A_T_MEP_t1)) // step * step AS c FROM tracking t JOIN steps USING (session_id) GROUP BY 1, 2) "
    "SELECT session_id, unnest(generate_series(a, b - step, step)) AS slot_ms FROM l WHERE a < b UNION ALL SELECT session_id, unnest(generate_series(c + step, d, step)) FROM l WHERE c < d",
    "p5_attributes": rf"""WITH f AS (SELECT {_fold("entity")} AS e, {_fold("attribute")} AS attribute, {_bare("attr_value")} AS b FROM mha_fields WHERE attr_value IS NOT NULL AND regexp_replace(attr_value, '{_B}+', '', 'g') <> ''),
k AS (SELECT attribute, count(*) AS n, count(*) FILTER (regexp_matches(b, '^[0-9]+$') AND try_cast(b AS INT) IS NOT NULL) AS ints, count(*) FILTER (regexp_matches(b, '{_NUM}') AND isfinite(try_cast(replace(b, ',', '.') AS DOUBLE))) AS doubles,
  count(*) FILTER (len(regexp_split_to_array(b, '{_B}+')) = 16 AND len(list_filter(regexp_split_to_array(b, '{_B}+'), lambda x: NOT regexp_matches(x, '{_NUM}'))) = 0) AS matrices FROM f WHERE starts_with(e, 'seqframe') AND attribute IS NOT NULL GROUP BY 1)
SELECT attribute, CASE WHEN ints >= 0.9 * n THEN 'int' WHEN doubles >= 0.9 * n THEN 'double' WHEN matrices >= 0.9 * n THEN 'matrix' ELSE 'string' END AS kind, n FROM k""",
    "p5_found": _CELLS + "SELECT sequence_id, frame_id, attribute FROM cells WHERE coalesce(CAST(num AS TEXT), CAST(whole AS TEXT), CAST(flag AS TEXT), note, CAST(matrix AS TEXT)) IS NOT NULL",
    "p5_frames": _CELLS + "SELECT sequence_id, frame_id, " + ", ".join(_WIDE[k].format(a) for a, k in HEADER_ATTRIBUTES.items()) + " FROM cells GROUP BY 1, 2",
    "p5_table": _CELLS + "SELECT sequence_id, frame_id, " + ", ".join((_WIDE | {"matrix": "max(matrix) FILTER (attribute = '{0}') AS {0}"})[k].format(a) for a, k in HEADER_ATTRIBUTES.items()) + " FROM cells GROUP BY 1, 2",
}
