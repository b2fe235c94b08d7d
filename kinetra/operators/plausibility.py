"""Implausible spikes in measurements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written
from kinetra.operators.ordered_windows import numbered, placed

#: Readings on each side that show what a source does around a reading; most readings of an excursion; fewest of a stuck run.
AROUND, EXCURSION, STUCK = 5, 3, 8
#: Fences, in interquartile ranges: of the first look, and of the second, whose neighbours are without what the first found.
FIRST_FENCE, FENCE = 5.0, 6.0
#: The same of the steps of positions; and of readings at the ends of a source, which are seen from one side only.
STEP_FENCE, END_FENCE = 9.0, 12.0
#: Readings of an index block, readings of its neighbours that it sees too, rows of a group of blocks (about).
BLOCK, HALO, GROUP_ROWS = 8_192, 32, 50_000
#: How many values of its own make an hour count as much as all hours of its source together.
HOUR_WEIGHT = 64


def in_blocks(df: DataFrame, n_rows: int, keys: Sequence[str], found: Callable[[pd.DataFrame], pd.DataFrame], schema: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``found`` over groups of whole index blocks; ``_series`` numbers the blocks, ``_own`` is false for rows of the halo.

    A key's rows (``n_rows`` in all) are cut into blocks of BLOCK by ``_at``; rows near a border are also sent to the neighbour. Blocks are
    hashed to groups of a bounded size, so that a hot key is many groups.
    """
    b = F.floor(F.col("_at") / BLOCK)
    m = F.pmod("_at", F.lit(BLOCK))
    copies = F.array_compact(F.array(b, F.when((m < HALO) & (b > 0), b - 1), F.when(m >= BLOCK - HALO, b + 1)))
    n = max(1, -(-n_rows // group_rows))
    rows = df.withColumn("_home", b).withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_home") == F.col("_block")).withColumn("_series", F.xxhash64(*keys, "_block"))
    return rows.drop("_home", "_block").withColumn("_g", F.pmod("_series", F.lit(n))).groupBy("_g").applyInPandas(found, schema)


def fences(values: DataFrame, keys: Sequence[str], hour: Column, value: Column, quantiles: Sequence[float]) -> DataFrame:
    """Keys, ``_hour`` and one column q0, q1 ... per quantile of ``value`` in that hour of the day, drawn towards that of all hours.

    Quantile sketches are built where the rows are, merged per key and hour, and merged again over the hours. The n values of an
    hour weigh n, those of all hours HOUR_WEIGHT. A null hour is a context of its own.
    """
    by_hour = values.groupBy(*keys, hour.alias("_hour")).agg(F.kll_sketch_agg_double(value).alias("_sketch"))
    all_hours = by_hour.groupBy(*keys).agg(F.kll_merge_agg_double("_sketch").alias("_all"))
    n = F.kll_sketch_get_n_double("_sketch")
    at = lambda sketch, q: F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
    drawn = [((n * at("_sketch", q) + HOUR_WEIGHT * at("_all", q)) / (n + HOUR_WEIGHT)).alias(f"q{i}") for i, q in enumerate(quantiles)]
    return by_hour.join(all_hours, list(keys)).select(*keys, "_hour", *drawn)


def _hour_of(ms: Column) -> Column:
    """The hour of the day, -1 where the time isn't known."""
    return F.coalesce(F.pmod(F.floor(ms / 3_600_000), F.lit(24)).cast("int"), F.lit(-1))


def _median_rows(a: np.ndarray) -> np.ndarray:
    """The median of each row's numbers, NaN where it has none."""
    a = np.sort(a, 1)
    n = (~np.isnan(a)).sum(1)
    rows = np.arange(len(a))
    low, high = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, a.shape[1] - 1)
    return (a[rows, low] + a[rows, high]) / 2


def _off(x: np.ndarray, series: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each value lies outside of what the readings before and after it do, and whether they lie on one side only.

    Readings left out are no neighbours. Between the medians of both sides nothing is off, so that steady motion and lasting moves aren't.
    A reading at an end of its source lies between the median of its AROUND neighbours and the line that they make, or is off; with
    fewer neighbours nothing is.
    """
    keep = np.flatnonzero(~left_out)
    kept, of = x[keep], series[keep]
    place = np.cumsum(~left_out) - ~left_out  # kept readings before each
    k = np.arange(AROUND)

    def side(first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The median of the neighbours, what their line says (NaN unless all are there), and whether there is none."""
        if not len(kept):
            return np.full(len(x), np.nan), np.full(len(x), np.nan), np.ones(len(x), bool)
        at = first[:, None] + step * k
        inside = (at >= 0) & (at < len(kept))
        at = np.clip(at, 0, len(kept) - 1)
        values = np.where(inside & (of[at] == series[:, None]), kept[at], np.nan)
        far = np.abs(keep[at[:, 0]] - np.arange(len(x)))
        line = _median_rows(values) + _median_rows(values[:, :-1] - values[:, 1:]) * (far + (AROUND - 1) / 2)
        return _median_rows(values), np.where(np.isnan(values).any(1), np.nan, line), np.isnan(values).all(1)

    (mb, lb, no_b), (ma, la, no_a) = side(place - 1, -1), side(place + ~left_out, 1)
    mb, ma = np.where(no_b, la, mb), np.where(no_a, lb, ma)
    low, high = np.minimum(mb, ma), np.maximum(mb, ma)
    return np.nan_to_num(np.maximum(0, np.maximum(x - high, low - x))), no_b | no_a


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """The length of the run that each element is in; same[i]: element i belongs to the run of element i - 1."""
    if not len(same):
        return np.zeros(0, int)
    start = np.flatnonzero(~same)
    return np.repeat(np.diff([*start, len(same)]), np.diff([*start, len(same)]))


def _joined(series: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], (series[1:] == series[:-1]) & flags[1:] & flags[:-1]])


def _spikes(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_series", "_at"], kind="stable")
    series, raw = pdf["_series"].to_numpy(), pdf.value.to_numpy(float)
    beyond = ~(np.abs(raw) <= np.nan_to_num(pdf._most.to_numpy(float), nan=np.inf))
    stuck = _run_lengths(np.concatenate([[False], (series[1:] == series[:-1]) & (raw[1:] == raw[:-1])])) >= STUCK
    others = pdf[["_o0", "_o1", "_o2"]].to_numpy(float)
    turn = np.sign(np.nan_to_num((others[1:] * others[:-1]).sum(1)))
    turn[(turn == 0) | (series[1:] != series[:-1])] = 1
    x = raw * np.concatenate([[1.0], np.cumprod(turn)])
    fence = pdf._iqr.to_numpy(float)
    usable = fence > 0
    off, _ = _off(x, series, beyond)
    off, end = _off(x, series, beyond | usable & (off > FIRST_FENCE * fence))
    spike = usable & (off > np.where(end, END_FENCE, FENCE) * fence) & ~beyond & ~stuck
    change = series[1:] != series[:-1]
    outermost = np.concatenate([[True], change]) | np.concatenate([change, [True]])
    spike &= _run_lengths(_joined(series, spike)) <= np.where(end, outermost, EXCURSION)
    rules = [("beyond", beyond), ("stuck", stuck), ("spike", spike)]
    own = pdf._own.to_numpy(bool)
    return pd.concat([pd.DataFrame({"record_id": pdf._id.to_numpy()[flag & own], "field_name": pdf.field_name.to_numpy()[flag & own], "rule": rule}) for rule, flag in rules])


def implausible_readings(
    readings: DataFrame,
    source: str,
    time_ms: str,
    id_col: str,
    fields: dict[str, tuple[Column, Sequence[str]]],
) -> DataFrame:
    """(record_id, field_name, rule) of implausible values; a value may break several rules.

    ``fields`` gives, by field, the largest plausible size (null: none) and up to three companion fields; where the
    companions change sign together with the field, as those of a quaternion do, the change of sign is no jump. Rules:

    - ``beyond``: larger in size than plausible, or infinite
    - ``stuck``: one of eight or more readings in a row with exactly the same value
    - ``spike``: one of at most three readings in a row that lie outside what the five readings before and after do, by
      more than FENCE interquartile ranges of the source's usual change. The first or last reading, seen from one side
      only, counts alone and beyond END_FENCE; two that agree there are a move that lasts. That range comes from quantile sketches per source and hour of the day (the range between deciles where the
      quartiles are equal). A source whose usual change is 0 even so has no spikes.

    A source's readings are taken in the order of time, then id; a reading delivered again (same time and id) counts once. Null and NaN values,
    and readings whose source, time or id is null, are left out. Any input may be empty.

    A source's readings are ordered in parts, indexed, and cut into blocks that see HALO readings of their neighbours;
    no rule looks further, so the result doesn't depend on the blocks, and a hot source is many tasks.
    """
    companions = max((len(c) for _, c in fields.values()), default=0)
    if companions > 3:
        raise ValueError("at most three companions")
    per_field = [
        F.struct(
            F.lit(name).alias("field_name"),
            F.col(name).cast("double").alias("value"),
            most.cast("double").alias("_most"),
            *[(F.col(c[i]).cast("double") if i < len(c) else F.lit(1.0)).alias(f"_o{i}") for i in range(3)],
        )
        for name, (most, c) in fields.items()
    ]
    known = F.col(source).isNotNull() & F.col(time_ms).isNotNull() & F.col(id_col).isNotNull()
    long = readings.where(known).select(F.col(source).alias("_source"), F.col(time_ms).cast("bigint").alias("_t"), F.col(id_col).alias("_id"), F.inline(F.array(*per_field)))
    long = long.where("value is not null and not isnan(value)")
    keys = ["_source", "field_name"]

    def change(w: WindowSpec) -> dict[str, Column]:
        """From the value before, turned where the companions turn."""
        dot = sum((F.col(f"_o{i}") * F.lag(f"_o{i}").over(w) for i in range(3)), F.lit(0.0))
        return {"_change": F.col("value") - F.lag("value").over(w) * F.when(dot < 0, -1).otherwise(1)}

    # one pass over the readings; all that follows reads what it wrote
    rows = written(numbered(long, keys, ["_t", "_id"], F.expr("floor(_t / 3600000)"), once=True, extra=change))
    spread = F.when(F.col("q1") > F.col("q0"), F.col("q1") - F.col("q0")).otherwise(F.col("q3") - F.col("q2"))
    changes = rows.where("_change is not null and not isnan(_change)")
    usual = fences(changes, keys, _hour_of(F.col("_t")), F.col("_change"), (0.25, 0.75, 0.1, 0.9)).select(*keys, "_hour", spread.alias("_iqr"))
    known = lookup_join(rows.drop("_change").withColumn("_hour", _hour_of(F.col("_t"))), written(usual), [*keys, "_hour"], F.col("_id")).drop("_hour", "_t")
    return in_blocks(placed(known, keys), rows.count(), keys, _spikes, "record_id bigint, field_name string, rule string")


def _jumps(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_series", "_at"], kind="stable")
    series = pdf["_series"].to_numpy()
    numbers = np.stack([np.asarray(m, float) for m in pdf.matrix]) if len(pdf) else np.zeros((0, 16))
    bad = pdf._bad.to_numpy(bool)
    equal = (numbers[1:] == numbers[:-1]) | (np.isnan(numbers[1:]) & np.isnan(numbers[:-1]))
    stuck = _run_lengths(np.concatenate([[False], (series[1:] == series[:-1]) & equal.all(1)])) >= STUCK
    good = np.flatnonzero(~bad)
    p, of, most = numbers[good][:, [3, 7, 11]], series[good], pdf._fence.to_numpy(float)[good]
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    step = np.concatenate([[np.nan], np.where(of[1:] == of[:-1], step, np.nan), [np.nan]]) if len(good) else np.full(1, np.nan)
    into, out = step[:-1], step[1:]  # NaN: an end
    off = np.fmin(into, out)
    over = np.full(len(p), np.nan)
    if len(p) > 2:
        over[1:-1] = np.linalg.norm(p[2:] - p[:-2], axis=1)
    back = np.isnan(into) | np.isnan(out) | (over < off)
    # beside a jump, an end isn't one
    next_jumps = np.zeros(len(p), bool)
    jump_inside = ~np.isnan(into) & ~np.isnan(out) & (off > most) & back
    next_jumps[:-1] |= jump_inside[1:] & (of[1:] == of[:-1]) if len(p) else False
    next_jumps[1:] |= jump_inside[:-1] & (of[1:] == of[:-1]) if len(p) else False
    end = (np.isnan(into) ^ np.isnan(out)) & (off > most) & ~next_jumps
    jump = np.zeros(len(pdf), bool)
    jump[good] = jump_inside | end
    own = pdf._own.to_numpy(bool)
    return pd.concat([pd.DataFrame({"record_id": pdf._id.to_numpy()[flag & own], "rule": rule}) for rule, flag in (("spike", jump), ("stuck", stuck), ("beyond", bad))])


def rigid_violation(m: Column, most: Column) -> Column:
    """Whether 16 row-major numbers are no rigid transform (rotation to 1e-3, last row 0 0 0 1) or lie beyond ``most`` on an axis; null counts."""
    e = [F.get(m, F.lit(i)) for i in range(16)]
    sound = (F.size(m) == 16) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = [e[0:3], e[4:7], e[8:11]]
    for i in range(3):
        for j in range(i, 3):
            dot = sum((a * b for a, b in zip(rows[i], rows[j])), F.lit(0.0))
            sound &= F.abs(dot - (1.0 if i == j else 0.0)) < 2e-3
    det = sum((rows[0][i] * (rows[1][(i + 1) % 3] * rows[2][(i + 2) % 3] - rows[1][(i + 2) % 3] * rows[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))
    sound &= F.abs(det - 1) < 5e-3
    for i, last in enumerate((0.0, 0.0, 0.0, 1.0)):
        sound &= F.abs(e[12 + i] - last) < 1e-6
    for axis in (3, 7, 11):
        sound &= most.isNull() | (F.abs(e[axis]) <= most)
    return ~F.coalesce(sound, F.lit(False))


def implausible_transforms(packets: DataFrame, source: str, order: str, id_col: str, matrix: str, most: Column, time_ms: Column | None = None) -> DataFrame:
    """(record_id, rule) of implausible transforms (arrays of 16 numbers) of a source in the order of ``order``, then id.

    Rules: ``beyond``: no rigid transform, or beyond ``most`` on an axis; ``stuck``: one of eight or more in a row with the
    same numbers (no variance); ``spike``: a single transform, the steps to and from which are both outside the fence of the source's
    steps, STEP_FENCE interquartile ranges above the upper quartile, while its neighbours lie nearer to each other; at an end one step
    decides. The quartiles come from quantile sketches per source and hour of the day (of ``time_ms``; null: not known). Transforms
    under ``beyond`` are no neighbours. Rows delivered again (same order and id) count once; rows
    with a null source, order or id are left out. Blocks as for implausible_readings.
    """
    known = F.col(source).isNotNull() & F.col(order).isNotNull() & F.col(id_col).isNotNull()
    sixteen = F.when(F.size(matrix) == 16, F.col(matrix).cast("array<double>")).otherwise(F.array_repeat(F.lit(float("nan")), 16))
    hour = _hour_of(F.lit(None).cast("double") if time_ms is None else time_ms)
    rows = packets.where(known).select(F.col(source).alias("_source"), F.col(order).cast("bigint").alias("_t"), F.col(id_col).alias("_id"), hour.alias("_hour"), F.transform(sixteen, lambda x: F.coalesce(x, F.lit(float("nan")))).alias("matrix"), rigid_violation(F.col(matrix).cast("array<double>"), most).alias("_bad"))

    def walk(w: WindowSpec) -> dict[str, Column]:
        """The step from the sound transform before."""
        at = lambda i: F.when(~F.col("_bad"), F.get("matrix", F.lit(i)))
        squares = [F.pow(at(i) - F.last(at(i), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), 2) for i in (3, 7, 11)]
        return {"_walk": F.sqrt(squares[0] + squares[1] + squares[2])}

    rows = written(numbered(rows, ["_source"], ["_t", "_id"], F.expr(f"floor(_t / {BLOCK})"), once=True, extra=walk))
    steps = rows.where("_walk > 0")
    usual = fences(steps, ["_source"], F.col("_hour"), F.col("_walk"), (0.25, 0.75))
    usual = written(usual.select("_source", "_hour", (F.col("q1") + STEP_FENCE * (F.col("q1") - F.col("q0"))).alias("_fence")))
    known = lookup_join(rows.drop("_walk"), usual, ["_source", "_hour"], F.col("_id")).drop("_t", "_hour")
    return in_blocks(placed(known, ["_source"]), rows.count(), ["_source"], _jumps, "record_id bigint, rule string")
