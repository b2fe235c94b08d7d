"""Matching records by nearest time."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of both sides that one group should hold, on average.
GROUP_ROWS = 100_000

_SQL = """
WITH q AS (SELECT DISTINCT b, id, t FROM lefts),
r AS (SELECT b, t, min(id) AS id FROM rights GROUP BY b, t),
back AS (SELECT q.b, q.id, q.t, r.id AS rid, q.t - r.t AS away FROM q ASOF JOIN r ON q.b = r.b AND q.t >= r.t),
forth AS (SELECT q.b, q.id, q.t, r.id AS rid, r.t - q.t AS away FROM q ASOF JOIN r ON q.b = r.b AND q.t < r.t),
candidates AS (SELECT *, 0 AS side FROM back WHERE away <= $tolerance UNION ALL SELECT *, 1 FROM forth WHERE away <= $tolerance)
SELECT id AS left_id, arg_min(rid, (away, side)) AS right_id, min(away) AS away FROM candidates GROUP BY b, id, t
"""


@functools.cache
def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _match(tolerance: float):
    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"left_id": pa.array([], pa.int64()), "right_id": pa.array([], pa.int64()), "away": pa.array([], pa.float64())})
        con = _connection()
        con.register("lefts", left)
        con.register("rights", right)
        try:
            found = con.sql(_SQL.replace("$tolerance", repr(tolerance))).to_arrow_table()
        finally:
            con.unregister("lefts")
            con.unregister("rights")
        return found.cast(pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("away", pa.float64())]))

    return match


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    left_time: str,
    right_id: str,
    right_time: str,
    tolerance: float,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each left row with the right row of the same keys that is nearest in time, if within ``tolerance``.

    Result: ``left_id``, ``right_id`` (bigint, under those columns' own names) and ``away`` (double, in the times'
    unit). Times are numbers. At equal distances the earlier right row is taken, at equal times the smaller id. Left
    rows repeated at the same time count once. Left rows without a partner are left out. Rows with a null id, time or
    key, or a NaN time, match nothing.

    Time is cut into windows of many tolerances; a right row near a window's edge is also sent to the neighbour, so that
    every window is complete in itself. Windows are hashed to groups of about ``group_rows`` rows, so a hot key is many
    groups; in each group, DuckDB makes one backward and one forward ASOF join over Arrow data.
    """
    keys = list(keys)
    width = tolerance * 600 or 1.0
    n = max(1, -(-(left.count() + right.count()) // group_rows))  # counts of files' footers where nothing is filtered

    def side(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
        t = F.col(time_col).cast("double")
        ok = F.col(id_col).isNotNull() & t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
        for k in keys:
            ok &= F.col(k).isNotNull()
        return df.where(ok).select(F.to_json(F.struct(*keys)).alias("key") if len(keys) > 1 else F.col(keys[0]).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), t.alias("t"))

    def grouped(df: DataFrame, window) -> DataFrame:
        b = F.concat_ws(":", "key", window.cast("string"))
        return df.select(F.pmod(F.xxhash64(b), F.lit(n)).cast("int").alias("g"), b.alias("b"), "id", "t")

    one = F.floor(F.col("t") / width)
    lefts = grouped(side(left, left_id, left_time), one)
    near = side(right, right_id, right_time).withColumn("w", F.explode(F.array_distinct(F.array(F.floor((F.col("t") - tolerance) / width), one, F.floor((F.col("t") + tolerance) / width)))))
    rights = grouped(near, F.col("w"))
    pairs = lefts.groupBy("g").cogroup(rights.groupBy("g")).applyInArrow(_match(float(tolerance)), "left_id bigint, right_id bigint, away double")
    return pairs.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), "away")
